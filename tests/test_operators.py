import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import intervals, ranking, rules, search, sets
from strandlake.operators.products import cross_products, pair_products, primer_owners


def spans(rng, n, keys="ab"):
    out = []
    for i in range(n):
        s = rng.randint(0, 400)
        out.append((rng.choice(keys), i, s, s + rng.choice([0, 1, 5, 20, 90])))
    return out


def test_joins_against_all_pairs(spark):
    rng = random.Random(1)
    a, b = spans(rng, 60), spans(rng, 60)
    schema = "k string, id int, start long, end long"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for width in (7, 64, 1000):
        got = sorted((r.l_id, r.r_id) for r in intervals.overlap_join(x, y, ["k"], width=width).collect())
        assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] < q[3] and p[3] > q[2])
        got = sorted((r.l_id, r.r_id) for r in intervals.containment_join(x, y, ["k"], width=width).collect())
        assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] >= q[2] and p[3] <= q[3])
    for low, high in ((0, 0), (0, 30), (50, 120)):
        got = sorted((r.l_id, r.r_id) for r in intervals.band_join(x, y, ["k"], "start", "end", low, high).collect())
        assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and low <= q[3] - p[2] <= high)
    hit = {r.id for r in intervals.overlapping(x, y, ["k"], width=16).collect()}
    assert hit == {p[1] for p in a for q in b if p[0] == q[0] and p[2] < q[3] and p[3] > q[2]}
    assert {r.id for r in intervals.overlapping(x, y, ["k"], anti=True, width=16).collect()} == {p[1] for p in a} - hit


def test_merge_and_gaps(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 9, 10), ("b", 3, 4), ("a", 1, 2), ("b", None, 4)], "k string, start long, end long")
    got = sorted(tuple(r) for r in intervals.merge_intervals(df, ["k"]).collect())
    assert got == [("a", 0, 8, 3), ("a", 9, 10, 1), ("b", 3, 4, 1)]
    assert sorted(tuple(r) for r in intervals.merge_intervals(df, ["k"], pad=1).collect()) == [("a", 0, 11, 4), ("b", 2, 5, 1)]
    got = {r.k: (r.min_gap, r.n_conflicts) for r in intervals.smallest_gap(df, ["k"], "start", 4).collect()}
    assert got["a"] == (1, 1)


OTHER = str.maketrans("ACGT", "TGCA")


def scan(contigs, primers, anchor, most):
    out = set()
    for chrom, seq in contigs:
        for p in set(primers):
            for at in range(len(seq) - len(p) + 1):
                site = seq[at : at + len(p)]
                if set(site) - set("ACGT"):
                    continue
                for strand, o in (("+", site), ("-", site.translate(OTHER)[::-1])):
                    mm = sum(x != y for x, y in zip(p, o, strict=True))
                    if mm <= most and (not anchor or p[-anchor:] == o[-anchor:]):
                        out.add((p, chrom, at, strand, mm, "".join(".X"[x != y] for x, y in zip(p, o, strict=True))))
    return out


def test_searches_against_a_scan(spark):
    rng = random.Random(2)
    contigs = [(f"c{k}", "".join(rng.choices("ACGT", k=n))) for k, n in enumerate((300, 90, 15, 200))]
    contigs[0] = ("c0", contigs[0][1][:100] + "NNN" + contigs[0][1][103:])
    primers = []
    for chrom, seq in (contigs[0], contigs[3]):
        for n in (14, 20):
            for at in (0, 37, 120, len(seq) - n):
                p = list(seq[at : at + n])
                if "N" in p:
                    continue
                for _ in range(rng.randint(0, 3)):
                    p[rng.randrange(n)] = rng.choice("ACGT")
                p = "".join(p)
                primers += [p, p.translate(OTHER)[::-1]]
    df = spark.createDataFrame(contigs, "chrom string, seq string")
    ps = spark.createDataFrame([(p,) for p in primers] + [("ACGN" * 5,), (None,)], "primer string")
    for chunk in (32, 1 << 16):
        got = {(r.primer, r.chrom, r.start, r.strand, r.mismatches, r.mask) for r in search.strict_search(df, ps, 6, 3, chunk).collect()}
        assert got == scan(contigs, primers, 6, 3) and got
    for most in (0, 2):
        got = [(r.primer, r.chrom, r.start, r.strand, r.mismatches, r.mask) for r in search.sensitive_search(df, ps, most, 64).collect()]
        assert set(got) == scan(contigs, primers, 0, most) and len(got) == len(set(got))
    found = search.strict_search(df, ps, 6, 3)
    assert search.valid_bindings(found, df, 3, 6).where("not ok").count() == 0
    assert search.valid_bindings(found.withColumn("start", F.col("start") + 1), df, 3, 6).where("ok").count() < found.count() / 2


def test_products(spark):
    # Two pairs whose sites cross; windows and overlaps by hand.
    sites = [("F1", 1000, "+"), ("R1", 1200, "-"), ("F2", 1100, "+"), ("R2", 1400, "-")]
    b = spark.createDataFrame([(p, "chr1", s, s + 24, strand, 0, "." * 24) for p, s, strand in sites], "primer string, chrom string, start long, end long, strand string, mismatches int, mask string")
    panel = spark.createDataFrame([("P0", "F1", "R1"), ("P1", "F2", "R2")], "pair_id string, primer1 string, primer2 string")
    assert sorted((r.pair_id, r.start, r.end, r.length) for r in pair_products(panel, b).collect()) == [("P0", 1000, 1224, 224), ("P1", 1100, 1424, 324)]
    cross = sorted((r.left_primer, r.right_primer, r.designed) for r in cross_products(b, panel).collect())
    assert cross == [("F1", "R1", True), ("F1", "R2", False), ("F2", "R1", False), ("F2", "R2", True)]
    assert {r.primer: r.owners for r in primer_owners(panel).collect()}["F1"] == ["P0_F"]


def test_pairs_that_share_a_primer(spark):
    """Sites meet by place, not once for each pair that has their primer; a primer paired with itself has no product."""
    sites = [(p, f"c{i}", s, s + 20, strand, 0, "." * 20) for i in range(30) for p, s, strand in ((f"F{i}", 100, "+"), ("R", 200, "-"), ("S", 100, "+"), ("S", 200, "-"))]
    b = spark.createDataFrame(sites + sites[:4], "primer string, chrom string, start long, end long, strand string, mismatches int, mask string")
    panel = spark.createDataFrame([(f"P{i}", f"F{i}", "R") for i in range(30)] + [("T", "S", "S")], "pair_id string, primer1 string, primer2 string")
    found = pair_products(panel, b, 50, 200)
    assert sorted((r.pair_id, r.chrom, r.start, r.end) for r in found.collect()) == sorted((f"P{i}", f"c{i}", 100, 220) for i in range(30))


def test_pareto_and_skyline(spark):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, (60, 3)).astype(float)
    left, layer, want = set(range(60)), 1, {}
    while left:
        front = {i for i in left if not any((points[j] <= points[i]).all() and (points[j] < points[i]).any() for j in left)}
        want |= dict.fromkeys(front, layer)
        left -= front
        layer += 1
    got = ranking.pareto_layers(points)
    assert all(got[i] == want[i] for i in range(60))
    assert set(ranking.pareto_layers(points, 2)) == {1, 2, 3}
    df = spark.createDataFrame([("g", i, *map(float, p)) for i, p in enumerate(points)], "k string, id int, a double, b double, c double").repartition(3)
    assert {r.id for r in ranking.skyline(df, ["k"], ["a", "b", "c"]).collect()} == {i for i in want if want[i] == 1}
    assert {r.id: r.layer for r in ranking.pareto(df, ["k"], ["a", "b", "c"]).collect()} == want


def test_layers_of_few_objectives_are_found_at_once(spark, monkeypatch):
    """All layers in one round, however many, alike for one to three objectives and with equal rows; rounds give the same."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3):
        points = rng.integers(0, 9, (200, n)).astype(float)
        above = lambda j, i, x=points: (x[j] <= x[i]).all() and (x[j] < x[i]).any()
        want = np.ones(200, int)
        for i in sorted(range(200), key=lambda k, x=points: x[k].sum()):
            want[i] = 1 + max((want[j] for j in range(200) if above(j, i)), default=0)
        assert (ranking.pareto_layers(points) == np.minimum(want, 51)).all() and (ranking.pareto_layers(points, 4) == np.minimum(want, 5)).all()
    rounds = []
    monkeypatch.setattr(ranking, "_fronts", lambda *a, f=ranking._fronts: rounds.append(a[3]) or f(*a))
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(60)], "id int, a double, b double")
    at_once = {r.id: r.layer for r in ranking.pareto(df, [], ["a", "b"]).collect()}
    assert rounds == [50] and at_once == {r.id: r.layer for r in ranking.pareto(df, [], ["a", "b"], at_once=20).collect()} and max(at_once.values()) > 11


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0, "PASS", ""), (2, 50.0, "WARN", "FAIL"), (3, None, None, None)], "id int, v double, x string, y string")
    level = rules.severity(F.col("v") > 40, F.col("v") > 4)
    got = df.select(level.alias("s"), rules.worst(F.col("x"), F.col("y")).alias("w"), rules.first_failing([("A", F.col("v") > 40, F.col("v")), ("B", F.col("v") > 4, F.lit("b"))]).alias("f")).collect()
    assert [r.s for r in got] == ["WARN", "FAIL", "INFO"] and [r.w for r in got] == ["PASS", "FAIL", "PASS"]
    assert [r.f and r.f.rule for r in got] == ["B", "A", None]
    rows = rules.records(df, rules.evidence("R-1", F.col("id"), level, {"v": F.col("v")}), rules.evidence("R-2", F.col("id"), F.lit("INFO"), {"b": F.lit(1), "a": F.col("v")}), digest="d")
    assert rows.where("rule = 'R-2' and target = '1'").first().value == '{"a":5.0,"b":1}'
    assert {r.target: (r.verdict, r.n_warn, r.n_fail) for r in rules.verdicts(rows).collect()} == {"1": ("WARN", 1, 0), "2": ("FAIL", 0, 1), "3": ("PASS", 0, 0)}


def test_sets(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), (None, 1)], "k string, v int")
    p = spark.createDataFrame([("a", 2), ("a", 3), ("c", 1), (None, 1)], "k string, v int")
    m = {r.k: r for r in sets.compare(t, p, ["k", "v"], ["k"]).collect()}
    assert (m["a"].n_truth, m["a"].n_predicted, m["a"].n_both, m["a"].precision, m["a"].recall) == (2, 2, 1, 0.5, 0.5)
    assert m["b"].recall == 0.0 and m["c"].precision == 0.0 and m[None].f1 == 1.0
    assert sets.compare(t, p, ["k", "v"]).first().n_both == 2
    assert sets.differences(t, p, ["k", "v"]).count() == 4
    s = sets.tolerant_comparison(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double"), spark.createDataFrame([("a", 1.05), ("c", 2.0)], "k string, x double"), ["k"], "x", 0.1)
    assert {r.k: r.status for r in s.collect()} == {"a": "MATCH", "b": "MISSING_OTHER", "c": "MISSING_OURS"}


def test_constrained_search_and_labels(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGT", k=900)) for _ in range(2)]
    df = spark.createDataFrame([(f"c{k}", s) for k, s in enumerate(seqs)], "chrom string, seq string")
    first = search.strict_search(df, spark.createDataFrame([(seqs[0][100:120],)], "primer string"), 12, 3)
    mates = spark.createDataFrame([(seqs[0][200:218].translate(OTHER)[::-1],), (seqs[0][700:720],)], "primer string")
    near = {(r.primer, r.chrom, r.start, r.strand) for r in search.constrained_search(df, first, mates, 1, 150).collect()}
    everywhere = {(r.primer, r.chrom, r.start, r.strand) for r in search.profiled(df, mates, "SENSITIVE", 1).collect()}
    assert near < everywhere and {x for x in everywhere if x[1] == "c0" and x[2] < 270} == near and near
    d = search.strategy(search.search_difficulty(df, mates.limit(1)))
    assert d.first().strategy == "candidate"
    assert all(r.n_candidates > 0 for r in search.seed_cost(df, mates, 1).collect())


def test_contigs_and_contracts(spark):
    from strandlake.functions import parameters
    from strandlake.plans import checks

    sites = spark.createDataFrame([("A", "..X"), ("B", "X....")], "primer string, mask string")
    targets = spark.createDataFrame([("A",), ("B",), ("C",)], "primer string")
    assert {r.primer: r.spc08 for r in checks.contig_checks(sites, targets).collect()} == {"A": "WARN", "B": "FAIL", "C": "INFO"}
    got = checks.contract_check(spark.createDataFrame([("anchor", "12"), ("max_mismatches", None)], "field string, value string"), ("anchor", "max_mismatches")).first()
    assert (got.missing, got.spc09) == (["max_mismatches"], "WARN")
    assert parameters.consistency() == []


def test_bins_do_not_show(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), s, s + rng.choice([0, 1, 3, 10, 60, 300])) for s in (rng.randint(0, 900) for _ in range(150))]
    df = spark.createDataFrame(rows, "k string, start long, end long")
    got = [sorted(map(tuple, intervals.merge_intervals(df, ["k"], width=w).collect()), key=str) for w in (1, 7, 64, 1 << 20)]
    want = []
    for k in ("a", "b", None):
        own = sorted((s, e) for x, s, e in rows if x == k)
        for s, e in own:
            if want and want[-1][0] == k and s <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
            else:
                want.append((k, s, e, 1))
    assert all(g == sorted(want, key=str) for g in got)
    gaps = [sorted(map(tuple, intervals.smallest_gap(df, ["k"], "start", 3, width=w).collect()), key=str) for w in (1, 16, 1 << 20)]
    assert gaps[0] == gaps[1] == gaps[2]


def test_rows_with_equal_hashes_or_nulls_are_told_apart(spark):
    left = spark.createDataFrame([("a", 0, 5, None), ("a", 0, 5, None), ("a", 7, 9, "x"), (None, 0, 5, "y")], "k string, start long, end long, n string")
    right = spark.createDataFrame([("a", 4, 6, 1)], "k string, start long, end long, m int")
    assert sorted(tuple(r) for r in intervals.overlapping(left, right, ["k"]).collect()) == [("a", 0, 5, None)] * 2
    assert sorted((tuple(r) for r in intervals.overlapping(left, right, ["k"], anti=True).collect()), key=str) == [("a", 7, 9, "x"), (None, 0, 5, "y")]


def test_zipped(spark):
    import pytest

    one = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y")], "k string, rank int, pair string")
    assert sets.zipped(one, one.withColumnRenamed("k", "k"), ["k"], "rank", ["pair"]).count() == 2
    for other in ([("p", 1, "x"), ("p", 2, "z")], [("p", 1, "x")], [("p", 1, "x"), ("p", 2, "y"), ("p", 3, "w")]):
        with pytest.raises(Exception, match="tables differ"):
            sets.zipped(one, spark.createDataFrame(other, "k string, rank int, pair string"), ["k"], "rank", ["pair"]).collect()


def test_chunks_do_not_show(spark):
    rng = random.Random(4)
    seq = "".join(rng.choices("ACGT", k=5000))
    df = spark.createDataFrame([("c", seq[:2000] + "é" + seq[2001:])], "chrom string, seq string")
    primers = spark.createDataFrame([(seq[at : at + 20],) for at in (0, 1010, 1990, 2500, 4980)], "primer string")
    found = [sorted((r.primer, r.start, r.strand) for r in search.strict_search(df, primers, chunk=c).collect()) for c in (64, 1000, 1 << 16)]
    assert found[0] == found[1] == found[2] and {x[1] for x in found[0]} >= {0, 1010, 2500, 4980} and 1990 not in {x[1] for x in found[0]}
