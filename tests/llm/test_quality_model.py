import math
import random
import zlib

import numpy as np

from strandlake.llm import quality_model as Q


def texts(n=240, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["th", "an", "er", "in", "on", "re", "ed", "st"], k=rng.randint(1, 4)))
    out = []
    for d in range(n):
        good = [word() for _ in range(rng.randint(20, 300))]
        y = d % 3 != 0
        if not y:
            good[len(good) // 4 :] = rng.choice([[w + "###" for w in good], [w.upper() + "!!" for w in good], [good[0]] * 200])
        out.append((d, " ".join(good), int(y)))
    return out


def test_gradients():
    rng = np.random.default_rng(1)
    w = {"e": rng.normal(size=(Q.N_FEATURES, 4)), "eb": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "u": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "cb": rng.normal(size=1)}
    x, start, y = rng.normal(size=(9, Q.N_FEATURES)), np.array([0, 2, 3, 7]), np.array([1.0, 0, 1, 0])

    def loss():
        p = Q._forward(w, x, start)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    found = Q._gradients(w, x, start, y)
    for k, p in w.items():
        flat, g = p.reshape(-1), found[k].reshape(-1)
        for i in rng.integers(0, len(flat), 5):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_held_out_accuracy_and_contract(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "en", "s") for d, t, _ in rows] + [(900, None, "en", "s"), (901, "", "en", "s"), (None, "a b", "en", "s"), (5, rows[5][1], "de", "t")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(d, y, 0) for d, _, y in rows] + [(None, 1, 0), (7777, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in rows) and by[None].held_out is False
    held = [(by[d].predicted, y) for d, _, y in rows if by[d].held_out]
    assert len(held) > 30 and sum(p == y for p, y in held) / len(held) > 0.9


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = texts(60)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    turned = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, _, y in rows]
    a = Q.learn(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int"))
    b = Q.learn(docs, spark.createDataFrame(turned, "doc_id long, quality int"))
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.classify(docs, labels).first().score == 0.5
    assert Q.classify(docs.where("false"), labels).collect() == []
    assert Q.passages("x " * 500).shape == (8, Q.N_FEATURES) and not Q.passages(None).any()


def test_the_sample_is_bounded_by_whole_texts(spark):
    rows = [(1, "junk### " * 100, 0), (2, "good word " * 200, 1), (3, "x " * 64 * 500, 1)] + texts(20)[4:]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(k, 1) for k in range(5000, 5100)], "doc_id long, quality int")
    seen = []
    old = Q.fit
    try:
        Q.fit = lambda bags, labels: seen.append(sorted(map(len, bags))) or old(bags, labels, 1)
        Q.learn(docs, labels)
        Q.learn(docs, labels, sample=5)
        Q.learn(docs, labels, sample_passages=20)
    finally:
        Q.fit = old
    every = sorted(len(Q.passages(t)) for d, t, _ in rows if zlib.crc32(str(d).encode()) % 4 != 2)
    assert seen[0] == every and 500 in every and len(seen[1]) == 5 and sum(seen[2]) <= 20


def plain_score(model, bag):
    """One text's score, passage by passage, number by number."""
    w = model.weights
    sig = lambda v: 1 / (1 + math.exp(-v))
    codes, attention = [], []
    for row in bag.tolist():
        x = [(v - m) / s for v, m, s in zip(row, model.mean.tolist(), model.scale.tolist(), strict=True)]
        h = [math.tanh(sum(v * w["e"][i][j] for i, v in enumerate(x)) + w["eb"][j]) for j in range(len(w["eb"]))]
        gated = [math.tanh(sum(v * w["v"][i][j] for i, v in enumerate(h))) * sig(sum(v * w["u"][i][j] for i, v in enumerate(h))) for j in range(len(w["a"]))]
        codes.append(h)
        attention.append(sum(a * b for a, b in zip(gated, w["a"], strict=True)))
    weights = [math.exp(a - max(attention)) for a in attention]
    whole = [sum(a * h[j] for a, h in zip(weights, codes, strict=True)) / sum(weights) for j in range(len(w["c"]))]
    return sig(sum(a * b for a, b in zip(whole, w["c"], strict=True)) + w["cb"][0])


def test_scores_equal_plain_loops(spark):
    rows = texts(60)
    rows += [(500, rows[1][1] * 40, 1), (501, "", 0), (502, "one", 0)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    model = Q.learn(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int"))
    for at_once in (1, 7, 4096):
        got = {r.doc_id: r.score for r in Q.score(docs, model, at_once=at_once).collect()}
        assert all(abs(got[d] - plain_score(model, Q.passages(t))) < 1e-9 for d, t, _ in rows)


def test_a_text_beyond_the_sample_is_passed_over(spark):
    rows = [(d, t, y) for d, t, y in texts(90)]
    docs = spark.createDataFrame([(d, t * 2000 if d == 0 else t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int")
    model = Q.learn(docs, labels, sample_passages=600)
    got = {r.doc_id: r.predicted for r in Q.score(docs.where("doc_id > 0"), model).collect()}
    assert sum(got[d] == y for d, _, y in rows[1:]) > 80
