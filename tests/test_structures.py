import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import melting as M
from strandlake.functions import structures as S
from strandlake.functions.parameters import END_AT, END_GC, GAS, LOOPS, MISMATCHES, T37, all_steps, mismatch_key

STEPS, PAIR = all_steps(), dict(zip("ACGT", "TGCA", strict=True))


def plain_dimer(a, b, three_prime, bulge):
    """Every alignment of two segments, energies summed step by step."""
    under, best, bulged = b[::-1], None, None
    end = lambda x: END_AT if x in "AT" else END_GC
    dg = lambda hs: hs[0] - T37 * hs[1] / 1000

    def stacks(lo, hi):
        return np.sum([STEPS[a[k : k + 2]] for k in range(lo, hi - 1)], 0) if hi - lo > 1 else np.zeros(2)

    pairs = lambda lo, hi, off: all(0 <= k < len(a) and 0 <= k - off < len(b) and PAIR[a[k]] == under[k - off] for k in range(lo, hi))
    maximal = lambda lo, hi, off: pairs(lo, hi, off) and not pairs(lo - 1, lo, off) and not pairs(hi, hi + 1, off)
    for off in range(1 - len(b), len(a)):
        for lo, hi in itertools.combinations(range(len(a) + 1), 2):
            terminal = hi == len(a) or lo == off
            if three_prime and not terminal:
                continue
            if hi - lo >= 2 and maximal(lo, hi, off):
                e = dg(stacks(lo, hi) + end(a[lo]) + end(a[hi - 1]))
                best = e if best is None else min(best, e)
            for mid in range(lo + 2, hi - 2):
                inside = 0 <= mid - off < len(b)
                if inside and maximal(lo, mid, off) and maximal(mid + 1, hi, off):
                    e = stacks(lo, mid) + stacks(mid + 1, hi) + end(a[lo]) + end(a[hi - 1])
                    for k in (mid - 1, mid):
                        e = e + MISMATCHES[mismatch_key(a[k : k + 2], under[k - off : k - off + 2])]
                    best = dg(e) if best is None else min(best, dg(e))
        if bulge:
            for on_a in (0, 1):
                other = off + (1 if on_a else -1)
                for lo in range(len(a)):
                    if pairs(lo - 1, lo, off):
                        continue
                    for cut in range(lo + 2, len(a) + 1):
                        right = cut + on_a
                        if not pairs(lo, cut, off) or not pairs(right, right + 2, other):
                            continue
                        hi = right + 2
                        while pairs(hi, hi + 1, other):
                            hi += 1
                        if three_prime and not (hi == len(a) or lo == off):
                            continue
                        e = stacks(lo, cut) + stacks(right, hi) + end(a[lo]) + end(a[hi - 1])
                        e = e + (0, -1000 * (LOOPS["bulge"][1] + 0.5 * ((a[cut - 1] in "AT") + (a[right] in "AT"))) / T37)
                        e = e + STEPS[a[cut - 1 : cut + 1] if not on_a else under[cut - off] + under[cut - 1 - off]]
                        bulged = dg(e) if bulged is None else min(bulged, dg(e))
    return min((x for x in (best, bulged) if x is not None), default=None)


@pytest.mark.parametrize("three_prime", [False, True])
def test_dimers_against_all_alignments(three_prime):
    rng = random.Random(5)
    for _ in range(60):
        a, b = ("".join(rng.choices("ACGT", k=rng.randint(2, 12))) for _ in range(2))
        for bulge in (False, True):
            found, want = S.best_dimer(a, b, three_prime, bulge), plain_dimer(a, b, three_prime, bulge)
            assert (not found.found) if want is None else found.found and math.isclose(found.dg, want, abs_tol=1e-9), (a, b, found, want)


def test_many_dimers_and_folds_at_once():
    """Rows of many lengths in one call, over more than one block, are what each is by itself."""
    rng = random.Random(9)
    a, b = (["".join(rng.choices("ACGT", k=rng.randint(2, 24))) for _ in range(1500)] for _ in range(2))
    for end in (False, True):
        found = S.best_dimers(a, b, end)
        for i in rng.sample(range(1500), 25):
            want = plain_dimer(a[i], b[i], end, True)
            assert found["found"][i] == (want is not None) and (want is None or math.isclose(found["dg"][i], want, abs_tol=1e-9))
            assert {k: v[i] for k, v in found.items()} == vars(S.best_dimer(a[i], b[i], end))
    some = rng.sample(a, 200)
    assert [S.fold(x) for x in some] == S.folds(some)
    assert all(np.allclose(S.unpaired_probabilities(x), y, atol=1e-12) for x, y in zip(some, S.all_unpaired_probabilities(some), strict=True))
    stems = S.hairpin_stems(some)
    assert all({k: v[i] for k, v in stems.items()} == vars(S.hairpin_stem(x)) for i, x in enumerate(some))


def test_dimers_are_symmetric():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choices("ACGT", k=rng.randint(4, 24))) for _ in range(2))
        for end in (False, True):
            assert math.isclose(S.best_dimer(a, b, end).dg, S.best_dimer(b, a, end).dg, abs_tol=1e-9)


def all_structures(seq):
    """Structures without multiloops, as lists of pairs."""
    f = S.Fold(seq)

    def closed(i, j):
        yield [(i, j)], f.hairpin(i, j)
        for p, q in itertools.combinations(range(i + 1, j), 2):
            if f.pairs(p, q) and (p - i - 1) + (j - q - 1) <= f.longest:
                e = f.inner(i, j, p, q)
                if e < math.inf:
                    for rest, energy in closed(p, q):
                        yield [(i, j), *rest], e + energy

    def outside(i):
        if i >= len(seq):
            yield [], 0.0
            return
        yield from outside(i + 1)
        for j in range(i + 4, len(seq)):
            if f.pairs(i, j):
                for inner, e in closed(i, j):
                    for rest, energy in outside(j + 1):
                        yield inner + rest, e + energy

    return list(outside(0))


def test_folds_against_all_structures():
    rng = random.Random(7)
    for _ in range(25):
        seq = "".join(rng.choices("ACGT", weights=[1, 3, 3, 1], k=rng.randint(3, 14)))
        every = all_structures(seq)
        mfe, marks = S.fold(seq)
        assert math.isclose(mfe, min(e for _, e in every), abs_tol=1e-9)
        assert marks.count("(") == marks.count(")") and len(marks) == len(seq)
        weights = [math.exp(-e / (GAS * T37 / 1000)) for _, e in every]
        z, p = S.pair_probabilities(seq)
        assert math.isclose(z, sum(weights), rel_tol=1e-9)
        want = np.zeros((len(seq), len(seq)))
        for (pairs, _), w in zip(every, weights, strict=True):
            for i, j in pairs:
                want[i, j] += w / sum(weights)
        assert np.allclose(p, want, atol=1e-9)


def test_melting_chain_against_all_states():
    seq, t = "GCATGCAA", 62.0
    salt, kelvin = 0.368 * math.log(0.05), t + 273.15
    grow = [math.exp(-(h - kelvin * (s + salt) / 1000) / (GAS * kelvin / 1000)) for h, s in (STEPS[seq[i : i + 2]] for i in range(len(seq) - 1))]
    total = held = 0.0
    for state in itertools.product((0, 1), repeat=len(seq)):
        w = M.SIGMA if state[0] else 1.0
        for i in range(1, len(seq)):
            if state[i]:
                w *= grow[i - 1] * (1.0 if state[i - 1] else M.SIGMA)
        total += w
        held += w * sum(state) / len(seq)
    assert math.isclose(M.helix_fractions(seq, np.array([t]))[0], held / total, rel_tol=1e-9)


def plain_profile(curve, t):
    slope = [0.0] + [-(curve[i + 1] - curve[i - 1]) / (t[i + 1] - t[i - 1]) for i in range(1, len(t) - 1)] + [0.0]
    tops = [i for i in range(2, len(t) - 2) if slope[i - 1] <= slope[i] > slope[i + 1] and slope[i] > 0]
    peaks = [t[i] for i in tops if slope[i] >= 0.15 * max(slope[j] for j in tops)]
    tm = next((t[i] + (curve[i] - 0.5) / (curve[i] - curve[i + 1]) * 0.25 for i in range(len(t) - 1) if curve[i] >= 0.5 > curve[i + 1]), None)
    return tm, peaks, max((b - a for a, b in itertools.pairwise(peaks)), default=0.0)


def test_melting_profiles(spark):
    rng = random.Random(8)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (2, 3, 40, 90, 177, 1500)] + ["AT" * 60 + "GC" * 60, "G" * 50, "A" * 30]
    df = spark.createDataFrame([(s,) for s in [*seqs, None, "A", "ACGN"]], "s string")
    curves = df.withColumn("c", M.theta(F.col("s")))
    found = {r.s: (r.c, r.p) for r in curves.withColumn("p", M.profile(F.col("c"))).collect()}
    t = M.temperatures()
    assert len(t) == 193 and t[-1] == 98.0
    for s in seqs:
        curve, p = found[s]
        assert np.allclose(curve, M.helix_fractions(s, np.array(t)), atol=1e-12)
        tm, peaks, gap = plain_profile(curve, t)
        assert (p.tm is None) == (tm is None) and (tm is None or math.isclose(p.tm, tm, rel_tol=1e-9)) and p.peaks == peaks and p.gap == gap
    assert found["AT" * 60 + "GC" * 60][1].peaks
    assert found[None] == found["A"] == found["ACGN"] == (None, None)


def test_melting_profiles_without_their_curves(spark):
    rng = random.Random(10)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(2, 200))) for _ in range(100)] + ["ACGN", None, "A"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    both = df.select("s", M.melted(F.col("s")).alias("m"), M.profile(M.theta(F.col("s"))).alias("p")).collect()
    assert all(r.m == r.p for r in both) and sum(r.m is None for r in both) == 3
    curves = M.all_helix_fractions(seqs[:100], np.array(M.temperatures()))
    assert all((M.helix_fractions(s, np.array(M.temperatures())) == c).all() for s, c in zip(seqs[:100], curves, strict=True))


def test_programs_of_one_input_meet_it_once(spark):
    df = spark.createDataFrame([("ACGTACGT",), ("GGGGCCCC",)], "a string")
    found = S.all_on_distinct(df, ["a"], {"d": lambda a: S.dimer_udf()(a, a), "f": lambda a: S.fold_udf()(a), "u": lambda a: S.unpaired_udf()(a)})
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r.a: (r.d.found, len(r.u), r.f.mfe) for r in found.collect()} == {s: (True, 8, S.fold(s)[0]) for s in ("ACGTACGT", "GGGGCCCC")}


def test_loops():
    assert S.loop_energy("hairpin", 3) == 3.5 and 4.6 < S.loop_energy("hairpin", 11) < 5.0
    assert S.loop_energy("bulge", 31) > 5.9 and S.loop_energy("internal", 2) == math.inf


def test_udfs(spark):
    df = spark.createDataFrame([("GGGGCCCC", "GGGGCCCC"), ("AAAA", "CCCC"), (None, "A"), ("ACGN", "ACGT")], "a string, b string")
    rows = S.on_distinct(df, ["a", "b"], "d", lambda a, b: S.dimer_udf()(a, b)).collect()
    by = {r.a: r.d for r in rows}
    assert by["GGGGCCCC"].dg < -9 and by["AAAA"].found is False and by[None].found is None and by["ACGN"].found is None
    assert len(S.on_distinct(df, ["a"], "f", lambda a: S.fold_udf()(a)).collect()) == 4


def test_dimers_of_a_panel_are_self_and_pair_dimers(spark):
    """Each primer meets itself (DIM-01, DIM-02) and its partner (DIM-03, DIM-04), in both modes."""
    from strandlake.queries import QUERIES, panel

    sf_dir = "/root/testdata/sf0.001"
    want = set()
    for r in panel(spark, sf_dir).collect():
        for target, a, b, rules in ((f"{r.pair_id}_F", r.primer1, r.primer1, (1, 2)), (f"{r.pair_id}_R", r.primer2, r.primer2, (1, 2)), (r.pair_id, r.primer1, r.primer2, (3, 4))):
            for k, end in zip(rules, (False, True), strict=True):
                d = S.best_dimer(a, b, end)
                fail, warn = (-7, -5) if end else (-9, -6)
                want.add((target, f"DIM-0{k}", "FAIL" if d.found and d.dg < fail else "WARN" if d.found and d.dg < warn else "INFO"))
    got = [(r.target, r.rule, r.severity) for r in QUERIES["dimers"](spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) == 6 * 200
