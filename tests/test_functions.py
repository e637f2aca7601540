import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import dna, masks, parameters, scoring, thermo
from strandlake.operators import sampling
from strandlake.plans import checks, reports, variants

STEPS = parameters.all_steps()
OTHER = str.maketrans("ACGT", "TGCA")


def plain_duplex(s):
    h = math.fsum(STEPS[s[i : i + 2]][0] for i in range(len(s) - 1))
    e = math.fsum(STEPS[s[i : i + 2]][1] for i in range(len(s) - 1))
    for b in (s[0], s[-1]):
        x, y = parameters.END_AT if b in "AT" else parameters.END_GC
        h, e = h + x, e + y
    return h, e - 1.4 * (s == s.translate(OTHER)[::-1])


def oligos(n=40):
    rng = random.Random(9)
    return ["GGGGCCCC", "AT", "GC", "ACGTACGT"] + ["".join(rng.choices("ACGT", k=rng.randint(2, 30))) for _ in range(n)]


def test_duplex_and_identity(spark):
    df = spark.createDataFrame([(s,) for s in oligos()] + [("ACGN",), ("A",), (None,), ("",)], "s string")
    for model in (None, "equal", "self_complementary", "primer_excess"):
        m = thermo.melting("s", concentration=model)
        for r in df.select("s", thermo.duplex("s").alias("d"), m["tm_c"].alias("t"), thermo.bound_fraction(m, m["tm_c"]).alias("half"), thermo.bound_fraction(m, m["tm_c"] - 5).alias("below")).collect():
            if r.s is None or len(r.s) < 2 or "N" in r.s:
                assert r.d is None and r.t is None
            else:
                h, e = plain_duplex(r.s)
                assert math.isclose(r.d.dh, h, abs_tol=1e-9) and math.isclose(r.d.ds, e, abs_tol=1e-9)
                assert r.half is None or abs(r.half - 0.5) < 1e-9 and r.below > 0.5


def test_mismatched_duplex(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(60):
        p = "".join(rng.choices("ACGT", k=rng.randint(6, 20)))
        t = list(p)
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            t[rng.randrange(len(p))] = rng.choice("ACGT")
        rows.append((p, "".join(t)))
    for r in spark.createDataFrame(rows, "p string, t string").select("p", "t", thermo.duplex_with_mismatch("p", "t").alias("d")).collect():
        where = [i for i in range(len(r.p)) if r.p[i] != r.t[i]]
        if len(where) > 1 or where and not 2 <= where[0] < len(r.p) - 2:
            assert r.d is None
            continue
        h, e = plain_duplex(r.p)
        if where:
            bottom, at = r.t.translate(OTHER), where[0]
            for k in (at - 1, at):
                x, y = parameters.MISMATCHES[parameters.mismatch_key(r.p[k : k + 2], bottom[k : k + 2])]
                h, e = h + x - STEPS[r.p[k : k + 2]][0], e + y - STEPS[r.p[k : k + 2]][1]
            e += -1.4 * ((r.p == bottom[::-1]) - (r.p == r.p.translate(OTHER)[::-1]))
        assert math.isclose(r.d.dh, h, abs_tol=1e-9) and math.isclose(r.d.ds, e, abs_tol=1e-9)


def test_three_prime_mismatch_and_allele_check(spark):
    df = spark.createDataFrame([("GACTGACTGA", "GACTGACTGC", "last"), ("GACTGACTGA", "GACTGACTCA", "inner"), ("GACTGACTGA", "GACTGACTGA", "same")], "primer string, other string, id string")
    got = {r.id: r for r in df.select("id", thermo.duplex_with_three_prime_mismatch("primer", "other").alias("d"), checks.allele_check("id").alias("c")).collect()}
    core = plain_duplex("GACTGACTG")
    x, y = parameters.TERMINAL_MISMATCHES["GA/CG"]
    assert math.isclose(got["last"].d.dh, core[0] + x, abs_tol=1e-9) and math.isclose(got["last"].d.ds, core[1] + y, abs_tol=1e-9)
    assert got["inner"].d is not None and got["same"].d is None and got["last"].c.severity in ("INFO", "WARN")


def test_composition(spark):
    def run(s):
        best = n = 0
        for i, c in enumerate(s):
            n = n + 1 if i and s[i - 1] == c else 1
            best = max(best, n)
        return best

    def units(s, u):
        best = 1
        for i in range(len(s) - u):
            n = 1
            while s[i + n * u : i + (n + 1) * u] == s[i : i + u]:
                n += 1
            best = max(best, n)
        return best

    rng = random.Random(11)
    texts = ["".join(rng.choices("ACGT" if k % 2 else "AC", k=rng.randint(1, 30))) for k in range(80)]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for r in df.select("s", dna.longest_homopolymer("s").alias("r"), dna.max_repeat_units("s", 2).alias("u2"), dna.max_repeat_units("s", 3).alias("u3"), dna.gc_fraction("s").alias("gc"), dna.shannon_entropy("s", 2).alias("h"), dna.nearest_cpg_to_three_prime("s").alias("cg"), dna.non_cpg_c("s").alias("c")).collect():
        assert (r.r, r.u2, r.u3) == (run(r.s), units(r.s, 2), units(r.s, 3)), r
        two = [r.s[i : i + 2] for i in range(len(r.s) - 1)]
        assert math.isclose(r.h, -sum(two.count(x) / len(two) * math.log2(two.count(x) / len(two)) for x in set(two)) if two else 0.0, abs_tol=1e-9)
        at = [len(r.s) - 1 - i for i in range(len(r.s) - 1) if r.s[i : i + 2] == "CG"]
        assert r.cg == (min(at) if at else None)
        assert r.c == sum(c == "C" and r.s[i + 1 : i + 2] != "G" for i, c in enumerate(r.s))
    row = spark.sql("SELECT 'ARN' a, 'NC_000023.11' b, 'chr7' c, 'NC_000099.1' d").select(dna.degeneracy("a"), dna.grch38_alias("b"), dna.grch38_alias("c"), dna.grch38_alias("d"), dna.degenerate_three_prime("a")).first()
    assert list(row) == [8.0, "chrX", "chr7", None, True]


def test_masks(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(40):
        p = "".join(rng.choices("ACGT", k=rng.randint(3, 63)))
        rows.append((p, "".join(rng.choice([c, c, c, "ACGT"[rng.randrange(4)]]) for c in p)))
    df = spark.createDataFrame(rows, "p string, s string").withColumn("m", masks.mismatch_mask("p", "s")).withColumn("n", F.length("p"))
    for r in df.select("*", masks.rendered("m", "n").alias("t"), masks.mismatch_features("m", "n").alias("f"), dna.hamming("p", "s").alias("h"), masks.tolerant_terminal("p", "s").alias("tol"), masks.disruptive_terminal("p", "s").alias("dis")).collect():
        x = [i for i in range(r.n) if r.p[i] != r.s[i]]
        assert r.m == sum(1 << i for i in x) and r.t == "".join(".X"[i in x] for i in range(r.n)) and r.h == len(x) == r.f.mismatches
        assert r.f.last5 == sum(i >= r.n - 5 for i in x) and r.f.first5 == sum(i < 5 for i in x)
        assert r.f.nearest_to_3p == (r.n - 1 - max(x) if x else None) and r.f.exact_3p_run == (r.n - 1 - max(x) if x else r.n)
        assert math.isclose(r.f.positional_burden, sum(i + 1 for i in x) / (r.n * (r.n + 1) / 2))
        last = [i for i in x if i >= r.n - 3]
        tol = sum({r.p[i], r.s[i].translate(OTHER)} == {"G", "T"} for i in last)
        assert (r.tol, r.dis) == (tol, len(last) - tol)


def test_scores_and_chemistry(spark):
    df = spark.createDataFrame([(0, 20, 0.0), (1 << 19, 20, 5.0)], "m long, n int, d double")
    c = scoring.risk_components("m", "n", F.col("d"), 10.0)
    got = df.select(scoring.risk_score(c, {"similarity": 1.0, "retention": 1.0}).alias("s"), c["last3"].alias("l")).collect()
    assert [r.s for r in got] == [1.0, pytest.approx((0.95 + 0.5) / 2)] and got[1].l == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        scoring.risk_score(c, {"similarity": 0.0})
    with pytest.raises(ValueError):
        scoring.annealing_temperature("q5", "d", "n")
    one = spark.sql("SELECT 60D t, 21 a, 19 b")
    assert list(one.select(scoring.annealing_temperature("taq", "t", "a"), scoring.annealing_temperature("q5", "t", "a", True), scoring.annealing_temperature("phusion", "t", "a", True), scoring.annealing_temperature("phusion", "t", "b", True)).first()) == [55.0, 63.0, 63.0, 60.0]
    with pytest.raises(Exception, match="exactly 20"):
        spark.sql("SELECT 60D t, 20 a").select(scoring.annealing_temperature("phusion", "t", "a", True)).collect()


def test_sampling(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(40)] + [("b", 0, 1.0)], "k string, i int, v double")
    r = {x.k: x for x in sampling.bootstrap_mean(df, ["k"], "v", ["i"], 500).collect()}
    assert r["a"].mean == 19.5 and r["a"].low < 19.5 < r["a"].high and (r["b"].low, r["b"].high) == (1.0, 1.0)
    picked = sampling.spaced_strata(df.where("k = 'a'"), ["k"], ["v"], 4, 3).collect()
    assert len(picked) == 12 and sorted(x.picked for x in picked) == list(range(12)) and {x.stratum for x in picked} == {1, 2, 3, 4}


def test_variants(spark):
    raw = spark.createDataFrame([("chr22", 1005, "ATTT", "A", 0.02, {"afr": 0.2}), ("22", 1018, "A", "G", 0.0005, {}), ("chr22", 1050, "AC", "A", 0.3, {}), ("chr2", 1005, "A", "T", 0.5, {})], "chrom string, pos long, ref string, alt string, af double, pop_af map<string,double>")
    v = variants.prepared(raw)
    assert sorted((r.start, r.end) for r in v.where("chrom = '22'").collect()) == [(1004, 1008), (1017, 1018), (1049, 1051)]
    sites = spark.createDataFrame([("F", "chr22", 1000, 1020, "+", "A" * 20), ("R", "22", 1100, 1120, "-", "C" * 20)], "site_id string, chrom string, start long, end long, strand string, sequence string")
    hits = variants.site_hits(sites, v)
    got = {r.site_id: r for r in variants.site_checks(sites, hits).collect()}
    f = got["F"]
    assert (f.n_variants, f.n_3p, f.n_indels, f.var01, f.var02, f.var03, f.var06, f.var07) == (2, 1, 1, "WARN", "WARN", "WARN", "FAIL", "WARN")
    assert got["R"].n_variants == 0 and got["R"].var03 == "INFO"
    assert {r.pos: r.distance_3p for r in hits.collect()} == {1005: 15, 1018: 2}
    assert [r.ddg is not None for r in variants.with_energies(hits).orderBy("pos").collect()] == [False, True]
    amp = variants.amplicon_checks(spark.createDataFrame([("P", "chr22", 1000, 1120)], "amplicon_id string, chrom string, start long, end long"), sites, v).first()
    assert (amp.n_inside, amp.n_common_indels, amp.max_length_change, amp.var08) == (1, 1, 1, "WARN")


def test_isoforms_and_reports(spark):
    exons = spark.createDataFrame([("chr1", 100, 200, "G", "T1"), ("chr1", 300, 400, "G", "T1"), ("chr1", 100, 250, "G", "T2")], "chrom string, start long, end long, gene_name string, transcript_id string")
    pairs = spark.createDataFrame([("p", "G", "chr1", 110, 130, 350, 370), ("q", "X", "chr1", 1, 2, 3, 4)], "pair_id string, gene string, chrom string, fwd_start long, fwd_end long, rev_start long, rev_end long")
    got = {r.pair_id: r for r in checks.isoform_coverage(pairs, exons).collect()}
    assert (got["p"].targeted, got["p"].untargeted, got["p"].rt03) == (["T1"], ["T2"], "INFO") and got["q"].n_isoforms == 0
    b = spark.createDataFrame([("ACGTACGTAC", "ACGTTCGTAC", 1, 16), ("ACGTACGTAC", "ACGTACGTAC", 0, 1)], "primer string, oriented string, mismatches int, mask_bits long")
    rows = reports.report(b, {"similarity": 1.0}, 10.0).collect()
    assert [r.consistent for r in rows] == [True, False] and rows[0].mismatch_list[0].from_3p == 5 and rows[0].delta_tm > 0
    assert checks.condition_checks(thermo.Conditions(magnesium=0.0))[1] == ("COND-02", "WARN") and len(parameters.digest()) == 64


def test_structure_tm(spark):
    seq, marks = "GGGCCAAAAGGCCC", "(((((....)))))"
    df = spark.createDataFrame([(seq, (-5.0, marks)), ("AAAA", (0.0, "...."))], "amplicon string, fold struct<mfe:double,structure:string>")
    dh = sum(STEPS[seq[i : i + 2]][0] for i in range(4))
    got = [r[0] for r in df.select(checks.structure_tm(F.col("amplicon"), F.col("fold"))).collect()]
    assert got[0] == pytest.approx(1000 * dh / ((dh + 5.0) * 1000 / 310.15) - 273.15) and got[1] is None


def test_energies_are_sums_of_tenths(spark):
    """Whatever the order of the steps: CMP-07 compares halves whose energies may be 2.0 apart, to the last bit."""
    seqs = oligos(200)
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", thermo.stack_energy("s", 0).alias("h"), thermo.stack_energy("s", 1).alias("e")).collect()
    for r in rows:
        want = [sum(round(STEPS[r.s[i : i + 2]][k] * 10) for i in range(len(r.s) - 1)) / 10 for k in (0, 1)]
        assert [r.h, r.e] == want
