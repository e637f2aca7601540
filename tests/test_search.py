import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import kmer_index, search
from strandlake.operators.products import pair_products
from tests.test_operators import OTHER, scan

LETTERS = "ACGT"


def random_contigs(rng, sizes):
    out = [(f"c{k}", "".join(rng.choices(LETTERS, k=n))) for k, n in enumerate(sizes)]
    return [(c, s[:50] + "NN" + s[52:] if len(s) > 150 else s) for c, s in out]


def cut_primers(rng, contigs, lengths, changes=3):
    found = []
    for _, seq in contigs:
        for n in lengths:
            for at in {0, len(seq) - n, rng.randrange(max(1, len(seq) - n))}:
                p = list(seq[at : at + n])
                if len(p) < n or "N" in p:
                    continue
                for k in rng.sample(range(n), rng.randint(0, changes)):
                    p[k] = rng.choice(LETTERS)
                p = "".join(p)
                found += [p, p.translate(OTHER)[::-1]]
    return sorted(set(found))


def keys(df):
    return [(r.primer, r.chrom, r.start, r.strand, r.mismatches, r.mask) for r in df.collect()]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(21)
    contigs = random_contigs(rng, [400, 260, 30, 12, 0])
    primers = cut_primers(rng, contigs, [14, 20, 27])
    return contigs, primers, spark.createDataFrame(contigs, "chrom string, seq string"), spark.createDataFrame([(p,) for p in primers] + [("ACGN" * 5,), (None,)], "primer string")


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 5])
def test_neighbourhoods_find_every_site_once(case, most):
    contigs, primers, df, ps = case
    got = keys(search.sensitive_search(df, ps, most, 64))
    assert set(got) == scan(contigs, primers, 0, most) and len(got) == len(set(got))


def test_within_one(spark):
    found = spark.sql("select 'ACGT' as s").select(search.within_one(F.col("s")).alias("s")).first()
    want = {"ACGT"[:i] + b + "ACGT"[i + 1 :] for i in range(4) for b in LETTERS}
    assert set(found.s) == want and len(found.s) == 13


def test_cost_counts_the_neighbourhoods(case):
    contigs, primers, df, ps = case
    got = {r.primer: r.n_candidates for r in search.seed_cost(df, ps, 3, 64).collect()}
    want = {}
    for p in primers:
        step = len(p) // 2
        k = min(step, search.MOST_SEED)
        parts = [x[at : at + k] for x in (p, p.translate(OTHER)[::-1]) for at in (0, step)]
        want[p] = sum(sum(a != b for a, b in zip(part, s[i : i + k], strict=True)) <= 1 for part in parts for _, s in contigs for i in range(len(s) - k + 1))
    assert got == want


def test_half_seeds_leave_far_fewer_candidates_than_quarters(spark):
    rng = random.Random(5)
    seq = "".join(rng.choices(LETTERS, k=60_000))
    primers = ["".join(rng.choices(LETTERS, k=20)) for _ in range(40)]
    df, ps = spark.createDataFrame([("c", seq)], "chrom string, seq string"), spark.createDataFrame([(p,) for p in primers], "primer string")
    halves = search.seed_cost(df, ps, 3).agg(F.sum("n_candidates")).first()[0]
    places = {}
    for i in range(len(seq) - 4):
        places[seq[i : i + 5]] = places.get(seq[i : i + 5], 0) + 1
    quarters = sum(places.get(x[at : at + 5], 0) for p in primers for x in (p, p.translate(OTHER)[::-1]) for at in (0, 5, 10, 15))
    print(f"candidates: {halves} by halves, {quarters} by quarters")
    assert 40 * halves < quarters


def test_index_gives_the_anchored_search(case, spark, tmp_path):
    contigs, primers, df, ps = case
    index = kmer_index.write_index(df, kmer_index.Index(str(tmp_path / "index"), k=6, flank=24, prefix=2), size=64)
    for anchor in (6, 8):
        got = keys(kmer_index.indexed_search(spark, index, ps, anchor, 3))
        assert set(got) == scan(contigs, primers, anchor, 3) and len(got) == len(set(got)) and got
    strict = search.strict_search(df, ps, 6, 3)
    found = kmer_index.indexed_search(spark, index, ps, 6, 3)
    assert found.columns == strict.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, strict.collect()))
    with pytest.raises(ValueError, match="anchor"):
        kmer_index.indexed_search(spark, index, ps, 5, 3)
    with pytest.raises(ValueError, match="30 bases"):
        kmer_index.indexed_search(spark, index, spark.createDataFrame([("ACGTA" * 7,)], "primer string"), 6, 3)


def test_a_lookup_reads_its_folders_and_no_contig(spark, tmp_path):
    rng = random.Random(6)
    seq = "".join(rng.choices(LETTERS, k=30_000))
    contigs = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    index = kmer_index.write_index(contigs, kmer_index.Index(str(tmp_path / "index")))
    # One contig is the work of many tasks: many files, none of which holds most rows.
    files = spark.read.parquet(index.path).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 16 and max(r["count"] for r in files) < 3000
    one = spark.createDataFrame([(seq[100:120],)], "primer string")
    found = kmer_index.indexed_search(spark, index, one)
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = kmer_index.indexed_search(spark, index, one)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 1 and "chunk_start" not in plan
    filters = scans[0].split("PartitionFilters")[1]
    assert "part#" in filters.split("PushedFilters")[0] and "Or(EqualTo(kmer," in filters.split("PushedFilters")[1]
    assert (seq[100:120], "c", 100, "+", 0, "." * 20) in keys(found)


def test_pairs_keep_their_products(case, spark):
    contigs, primers, df, _ = case
    rng = random.Random(7)
    rows = [(f"p{i}", *rng.sample(primers, 2)) for i in range(40)] + [("q", primers[0], None), ("r", "NNNN", primers[1])]
    for c, s in contigs[:2]:
        for a in (60, 100):
            rows.append((f"{c}.{a}", s[a : a + 20], s[a + 80 : a + 100].translate(OTHER)[::-1]))
    pairs = spark.createDataFrame(rows, "pair_id string, primer1 string, primer2 string")
    chosen = search.anchors(pairs.where("primer2 is not null"), search.seed_cost(df, pairs.select(F.explode(F.array("primer1", "primer2")).alias("primer"))))
    assert all(r.anchor != r.mate for r in chosen.collect())
    whole = search.sensitive_search(df, pairs.select(F.explode(F.array("primer1", "primer2")).alias("primer")), 3)
    near = search.paired_search(df, pairs, 3, 150)
    got, want = (sorted(map(str, pair_products(pairs, b, 30, 150).collect())) for b in (near, whole))
    assert got == want and got and near.count() <= whole.count()


def test_many_seeds_meet_in_shuffles(case, spark, tmp_path, monkeypatch):
    """The planner takes neighbourhoods for as small as the primers they come from, and would broadcast them whole."""
    contigs, primers, df, _ = case
    df.write.parquet(f"{tmp_path}/contigs")
    spark.createDataFrame([(p,) for p in primers], "primer string").write.parquet(f"{tmp_path}/primers")
    kept, asked = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("contigs", "primers"))
    want = sorted(map(str, search.sensitive_search(kept, asked, 2).collect()))
    cost = sorted(map(str, search.seed_cost(kept, asked, 2).collect()))
    monkeypatch.setattr(search, "BROADCAST_NEAR", 0, raising=False)
    monkeypatch.setattr(search, "BROADCAST_SEEDS", 0)
    found = search.sensitive_search(kept, asked, 2)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(str, found.collect())) == want and want
    assert sorted(map(str, search.seed_cost(kept, asked, 2).collect())) == cost


def test_an_index_is_small_and_its_rows_stay_where_they_are_made(spark, tmp_path):
    rng = random.Random(8)
    contigs = [(f"c{k}", "".join(rng.choices(LETTERS, k=50_000))) for k in range(4)]
    df = spark.createDataFrame(contigs, "chrom string, seq string")
    index = kmer_index.write_index(df, kmer_index.Index(str(tmp_path / "index")))
    rows = kmer_index.indexed_rows(df, index, tasks=4)
    plan = rows.sortWithinPartitions("part", "kmer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Sort") < plan.index("Generate") < plan.index("Exchange")
    assert {n for n, t in rows.dtypes if t == "string"} == {"part", "chrom"}
    size = sum(f.stat().st_size for f in (tmp_path / "index").rglob("*.parquet"))
    assert size < 30 * 200_000 and spark.read.parquet(index.path).count() == 4 * (50_000 - 11)


@pytest.mark.parametrize(("flank", "broadcast"), [(24, 0), (51, 0), (51, 1000), (8, 1000)])
def test_an_index_with_flanks_of_any_length_and_many_seeds(spark, tmp_path, monkeypatch, flank, broadcast):
    """Ns and other letters lie near the sites; flanks take more than one number; many seeds meet the index in a shuffle."""
    rng = random.Random(9)
    contigs = random_contigs(rng, [700, 300, 90, 57, 6, 5, 0])
    contigs = [(c, s[:120] + "r-*" + s[123:200].lower() + s[200:]) for c, s in contigs] + [("none", None)]
    primers = cut_primers(rng, [(c, s.upper()) for c, s in contigs if s and len(s) > 60], [6, 14] if flank == 8 else [6, 20, 30, 31, 45, 57][: 3 if flank == 24 else 6])
    primers = [p for p in primers if set(p) <= set(LETTERS)]
    spark.createDataFrame([(p,) for p in primers], "primer string").write.parquet(f"{tmp_path}/primers")
    df, ps = spark.createDataFrame(contigs, "chrom string, seq string"), spark.read.parquet(f"{tmp_path}/primers")
    index = kmer_index.write_index(df, kmer_index.Index(f"{tmp_path}/index", k=6, flank=flank, prefix=1), size=64)
    monkeypatch.setattr(kmer_index, "BROADCAST_SEEDS", broadcast)
    found = kmer_index.indexed_search(spark, index, ps, 6, 3)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (broadcast > 0)
    want = sorted(map(tuple, search.strict_search(df, ps, 6, 3).collect()))
    assert sorted(map(tuple, found.collect())) == want and len(want) > len(primers) // 2


def test_candidates_are_numbers_and_the_join_looks_at_no_letters(spark, monkeypatch):
    """Long primers take several numbers a side, chunks that were cut before own their starts, and letters come behind the join."""
    rng = random.Random(12)
    contigs = random_contigs(rng, [330, 90])
    primers = cut_primers(rng, contigs, [13, 34, 63])
    df, ps = spark.createDataFrame(contigs, "chrom string, seq string"), spark.createDataFrame([(p,) for p in primers], "primer string")
    cut = search.chunks(df, 63, 100)
    monkeypatch.setattr(search, "BROADCAST_NEAR", 0)
    for found in (search.sensitive_search(df, ps, 3, 100), search.sensitive_search(cut, ps, 3)):
        got = keys(found)
        assert set(got) == scan(contigs, primers, 0, 3) and len(got) == len(set(got))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(line for line in plan if "Join Inner" in line and "differ" not in line)
    assert "bit_count" in join and not any(x in join for x in ("conv(", "translate(", "substring("))
    below = plan[plan.index(join) + 1 :]
    assert next(i for i, x in enumerate(below) if "RepartitionByExpression" in x) > next(i for i, x in enumerate(below) if "Generate explode(sequence" in x)


def test_numbers_within_one(spark):
    one = spark.sql("select 'GATTACA' as s").select("s", search.packed("s").alias("n"))
    found = one.select(search.numbers_within_one(F.col("n"), F.length("s")).alias("n"), search.within_one(F.col("s")).alias("s")).select("s", F.transform("n", lambda n: search.unpacked(n, 7)).alias("n")).first()
    assert found.n[0] == found.s[0] and sorted(found.n) == sorted(found.s)
