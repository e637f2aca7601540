import random

import pytest
from pyspark.sql import functions as F

from strandlake import sql
from strandlake.operators import rules, search
from strandlake.sources import indexed_fasta, readers


def write_fasta(path, records, width=50):
    """A FASTA file and its index."""
    text, index = b"", []
    for name, seq in records:
        text += f">{name} of a test\n".encode()
        index.append(f"{name}\t{len(seq)}\t{len(text)}\t{width}\t{width + 1}")
        text += b"".join(seq[i : i + width].encode() + b"\n" for i in range(0, len(seq), width))
    path.write_bytes(text)
    path.with_name(path.name + ".fai").write_text("\n".join(index) + "\n")


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    rng = random.Random(3)
    records = [(f"c{k}", "".join(rng.choices("ACGTacgtNR", weights=[9] * 4 + [3] * 4 + [1, 1], k=n))) for k, n in enumerate([0, 1, 49, 50, 51, 20_000])]
    path = tmp_path_factory.mktemp("fasta") / "genome.fa"
    write_fasta(path, records)
    return records, str(path)


def test_ranges_give_the_chunks_of_the_whole_file(spark, fasta):
    _, path = fasta
    indexed_fasta.register(spark)
    whole = readers.fasta(spark, path).select(F.col("name").alias("chrom"), "seq")
    for size, reach in ((64, 30), (1000, 1), (1 << 16, 63)):
        got = spark.read.format("strandlake_fasta").option("range", 4000).option("chunk", size).option("overlap", reach - 1).load(path)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.chunks(whole, reach, size).collect()))


def test_one_contig_is_many_tasks_and_names_leave_others_out(spark, fasta):
    records, path = fasta
    indexed_fasta.register(spark)
    read = lambda **more: spark.read.format("strandlake_fasta").options(range=1000, chunk=100, **more).load(path)
    one = read(names="c5")
    assert one.rdd.getNumPartitions() == 20 and read().rdd.getNumPartitions() == 24 and read(names="c1, c3").rdd.getNumPartitions() == 2
    rows = read()
    assert rows.where("chrom = 'c1'").count() == 1 and rows.select("chrom").distinct().count() == 5
    seq = "".join(r.seq[: r.owned] for r in sorted(one.collect(), key=lambda r: r.chunk_start))
    assert seq == "".join(b if b in "ACGT" else "N" for b in records[5][1].upper())


def test_search_takes_the_chunks(spark, fasta):
    records, path = fasta
    indexed_fasta.register(spark)
    seq = "".join(b if b in "ACGT" else "N" for b in records[5][1].upper())
    sites = [seq[i : i + 18] for i in range(0, 19_000, 61) if "N" not in seq[i : i + 18]]
    primers = spark.createDataFrame([(s,) for s in sites], "primer string")
    ranged = spark.read.format("strandlake_fasta").option("range", 3000).option("chunk", 500).load(path)
    whole = readers.fasta(spark, path).select(F.col("name").alias("chrom"), "seq")
    got, want = (sorted(map(tuple, search.strict_search(c, primers, 10, 2).collect())) for c in (ranged, whole))
    assert got == want and len(got) >= len(sites)


def test_an_index_of_another_file_is_an_error(spark, fasta, tmp_path):
    write_fasta(tmp_path / "a.fa", [("x", "ACGT" * 30)])
    (tmp_path / "a.fa.fai").write_text("x\t500\t3\t50\t51\n")
    indexed_fasta.register(spark)
    with pytest.raises(Exception, match="where its index says"):
        spark.read.format("strandlake_fasta").load(str(tmp_path / "a.fa")).collect()
    (tmp_path / "a.fa.fai").write_text("x\t120\t3\t0\t0\n")
    with pytest.raises(Exception, match="no line length"):
        spark.read.format("strandlake_fasta").load(str(tmp_path / "a.fa")).collect()


def test_table_functions(spark):
    sql.register(spark)
    rng = random.Random(4)
    seqs = {"a": "".join(rng.choices("ACGTN", weights=[5, 5, 5, 5, 1], k=233)), "b": "ACG", "c": ""}
    rows = [(k, at, s[at : at + 20]) for k, s in seqs.items() for at in range(0, max(1, len(s)), 20)] + [("d", 0, None)]
    spark.createDataFrame(rows, "chrom string, chunk_start long, seq string").repartition(3).createOrReplaceTempView("parts_of_test")
    got = {tuple(r) for r in spark.sql("SELECT * FROM dna_kmers(TABLE(parts_of_test) PARTITION BY chrom ORDER BY (chunk_start), 25)").collect()}
    assert got == {(k, i, s[i : i + 25]) for k, s in seqs.items() for i in range(len(s) - 24) if "N" not in s[i : i + 25]}
    for size, step in ((30, 7), (10, 45), (50, 50)):
        got = sorted(tuple(r) for r in spark.sql(f"SELECT * FROM dna_windows(TABLE(parts_of_test) PARTITION BY chrom ORDER BY (chunk_start), {size}, {step})").collect())
        want = []
        for k, s in seqs.items():
            for i in range(0, len(s), step):
                w = s[i : i + size]
                want.append((k, i, i + len(w), sum(b in "GC" for b in w), sum(b != "N" for b in w)))
                if len(w) < size:
                    break
        assert got == sorted(want)


def test_evidence_as_variant(spark):
    good = ("CMP-01", "p1", '{"gc":0.5,"last":{"base":"T"},"list":[1,2]}', "{}", "INFO", "")
    bad = [("cmp", *good[1:]), ("CMP-01", " ", *good[2:]), (*good[:4], "BAD", ""), (*good[:2], "{", *good[3:]), (*good[:2], "[1]", *good[3:]), (*good[:2], None, *good[3:]), (*good[:3], "3", *good[4:]), (None,) * 6]
    rows = spark.createDataFrame([good, *bad], "rule string, target string, value string, threshold string, severity string, note string")
    kept, rejected = rules.as_variants(rows)
    assert dict(kept.dtypes)["value"] == "variant"
    row = kept.select(rules.value_of("$.gc", "double").alias("gc"), rules.value_of("$.last.base", "string").alias("base"), rules.value_of("$.list[1]", "int").alias("second"), rules.value_of("$.none", "int").alias("none"), rules.value_of("$.last", "int").alias("other")).collect()
    assert [tuple(r) for r in row] == [(0.5, "T", 2, None, None)]
    assert sorted(r.reason for r in rejected.collect()) == sorted(["rule", "target", "severity", "value", "value", "value", "threshold", "rule"])
    assert rejected.columns == [*rows.columns, "reason"]
