import random

from strandlake.llm.graphs import components


def brute(links):
    comp = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (40, 39), (12, 60)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + k, 101 + k) for k in range(20)]
        df = spark.createDataFrame([*links, (None, 3), (5, 5)], "a long, b long")
        want = brute([x for x in links if x[0] != x[1]])
        assert {r.node: r.component for r in components(df).collect()} == want
        part = {r.node: r.component for r in components(df, 2).collect()}
        assert part.keys() == want.keys() and all(want[part[x]] == want[x] for x in part) and len(components(df, 2).collect()) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
