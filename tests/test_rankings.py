import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import pools, ranking, sampling
from strandlake.plans import multiplex
from strandlake.functions.structures import best_dimer


def test_bootstrap_against_resampling(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(10, 3, 400), "b": rng.exponential(5, 250), None: rng.normal(0, 1, 60)}
    rows = [(k, f"{k}{i}", float(v)) for k, values in groups.items() for i, v in enumerate(values)] + [("a", "null", None), ("empty", "x", None)]
    found = {r.k: r for r in sampling.bootstrap_mean(spark.createDataFrame(rows, "k string, i string, v double").repartition(7), ["k"], "v", ["k", "i"], 2000).collect()}
    for k, values in groups.items():
        means = np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(4000)])
        low, high = np.quantile(means, [0.025, 0.975])
        r, width = found[k], high - low
        assert r.n == len(values) and abs(r.mean - values.mean()) < 1e-9
        assert abs(r.low - low) < 0.12 * width and abs(r.high - high) < 0.12 * width
    assert (found["empty"].n, found["empty"].mean, found["empty"].low) == (0, None, None)


def test_bootstrap_without_keys_and_repeats_by_seed(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "i long, v double")
    one, same, other = (sampling.bootstrap_mean(df, [], "v", ["i"], 100, seed).collect()[0] for seed in (1, 1, 2))
    assert one == same and (one.low, one.high) != (other.low, other.high) and one.low < one.mean < one.high


def layers_of(points):
    left, layer, want = dict(enumerate(points)), 1, {}
    while left:
        front = {i for i, p in left.items() if not any(all(x <= y for x, y in zip(q, p, strict=True)) and q != p for q in left.values())}
        want |= dict.fromkeys(front, layer)
        left = {i: p for i, p in left.items() if i not in front}
        layer += 1
    return want


@pytest.mark.parametrize("at_once,most", [(1, 4), (3, 50), (10, 50), (10, 2)])
def test_pareto_peeling(spark, at_once, most):
    rng = random.Random(6)
    groups = {"g": 120, "h": 30, None: 15}
    points = {k: [tuple(float(rng.randrange(6)) for _ in range(3)) for _ in range(n)] for k, n in groups.items()}
    df = spark.createDataFrame([(k, i, *p) for k, ps in points.items() for i, p in enumerate(ps)], "k string, i int, a double, b double, c double").repartition(5)
    got = {(r.k, r.i): r.layer for r in ranking.pareto(df, ["k"], ["a", "b", "c"], most=most, at_once=at_once).collect()}
    assert got == {(k, i): min(x, most + 1) for k, ps in points.items() for i, x in layers_of(ps).items()}


def test_skyline_of_two_objectives(spark):
    rng = random.Random(7)
    points = {k: [(float(rng.randrange(40)), float(rng.randrange(40))) for _ in range(300)] for k in ("g", None)}
    df = spark.createDataFrame([(k, i, *p) for k, ps in points.items() for i, p in enumerate(ps)], "k string, i int, a double, b double")
    got = {(r.k, r.i) for r in ranking.skyline(df, ["k"], ["a", "b"]).collect()}
    assert got == {(k, i) for k, ps in points.items() for i, x in layers_of(ps).items() if x == 1}


def plain_pool(nodes, conflicts, size=None):
    taken = []
    for i, _ in sorted(nodes, key=lambda n: (n[1], n[0])):
        if (size is None or len(taken) < size) and not any((i, j) in conflicts or (j, i) in conflicts for j in [*taken, i]):
            taken.append(i)
    return set(taken)


def test_greedy_pools(spark):
    rng = random.Random(9)
    nodes = [(g, i, rng.randrange(20)) for g in ("x", "y") for i in range(60)]
    conflicts = [(g, rng.randrange(60), rng.randrange(62)) for g in ("x", "y") for _ in range(150)] + [("x", k, k + 1) for k in range(59)] + [("z", 1, 2)]
    n, c = spark.createDataFrame(nodes, "g string, id int, rank int"), spark.createDataFrame(conflicts, "g string, a int, b int")
    for size in (5, 1000):
        got = {(r.g, r.id) for r in pools.pooled(n, c, ["g"], size).where("in_pool").collect()}
        assert got == {(g, i) for g in ("x", "y") for i in plain_pool([(i, r) for h, i, r in nodes if h == g], {(a, b) for h, a, b in conflicts if h == g}, size)}
    assert pools.greedy(n.where("false"), c, ["g"]).count() == 0
    assert pools.pooled(n, c.where("false"), ["g"], 3).where("in_pool").count() == 6


def test_pool_by_dimers(spark):
    rng = random.Random(10)
    rows = [("p", f"q{k}", k, "".join(rng.choices("ACGT", k=18)), "".join(rng.choices("ACGT", k=18))) for k in range(14)]
    rows.append(("p", "self", 3, "ACGTGACCGGCCGGCC", "ATTGACATTGACTTGA"))
    taken = []
    for _, name, _, x, y in sorted(rows, key=lambda r: (r[2], r[1])):
        own = (x, y)
        if len(taken) < 6 and not any(best_dimer(min(s, t), max(s, t), True).dg < -4.0 for other in [*[t[1] for t in taken], own] for s in own for t in other):
            taken.append((name, own))
    df = spark.createDataFrame(rows, "panel_id string, pair_id string, rank int, primer1 string, primer2 string")
    got = multiplex.greedy_pool(df, ["panel_id"], -4.0, 6)
    assert got.columns == [*df.columns, "in_pool"]
    assert {r.pair_id for r in got.where("in_pool").collect()} == {name for name, _ in taken} and 2 < len(taken)


def test_times_of_words(spark):
    """Digits as text are in the order of their numbers, next to every limit too."""
    words = sorted({min(max(int(p * (1 << 32)) + d, 0), (1 << 32) - 1) for p in (0, *sampling.POISSON, 1) for d in (-1, 0, 1, 2)})
    rows = spark.createDataFrame([(f"{w:08x}", w) for w in words], "h string, w long").select("w", sampling.times(F.col("h")).alias("n")).collect()
    assert {r.w: r.n for r in rows} == {w: next((k for k, p in enumerate(sampling.POISSON) if w / (1 << 32) < p), sampling.MOST_TIMES) for w in words}
