import random

from strandlake.llm.jaccard import jaccard_components, one_of_each, shingles


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, percent=75):
    sets = [shingle_set(t) for _, t in docs]
    comp = list(range(len(docs)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= percent * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def corpus(seed, n=80, vocab=300):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéA", k=rng.randint(2, 7))) for _ in range(vocab)]
    base = [rng.choices(words, k=rng.choice([3, 4, 5, 9, 30, 60, 120])) for _ in range(12)]
    common = rng.choices(words, k=20)
    docs = []
    for i in range(n):
        t = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(words, k=rng.randint(1, 80)) + common
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, rng.choice([" ", "\n", "  "]).join(t)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, docs[0][1]), (4, docs[4][1]), (None, docs[1][1]), (n + 5, docs[2][1].upper())]
    rng.shuffle(docs)
    return docs


def test_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs), key=str)


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(300)]
    docs = [(100 - k, " ".join(words[4 * k : 4 * k + 100])) for k in range(40)]
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {61}


def test_empty_and_one_of_each(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f", "n"), (2, "a b c d e f", "m"), (3, None, "x"), (4, "", "y")], "doc_id long, text string, n string")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_shingles_of_short_texts():
    assert len(shingles("a b")) == 1 and len(shingles(" \t")) == 0 and len(shingles(None)) == 0
    assert (shingles("A b") == shingles("a\nb")).all()


def test_similar_but_unlinked_documents(spark):
    # One base text of which each document keeps about 85 %: most pairs are at 0.5 to 0.74, a few link, and copies do.
    rng = random.Random(11)
    base = [f"w{i}" for i in range(160)]
    docs = []
    for i in range(140):
        t = list(base)
        for k in rng.sample(range(160), rng.choice([1, 3, 4, 5])):
            t[k] = f"x{i}.{k}"
        docs.append((i, " ".join(t)))
    docs += [(200 + i, docs[i][1] + " tail") for i in range(0, 140, 9)]
    rng.shuffle(docs)
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs))


def test_very_long_texts_at_the_threshold(spark):
    # With this many shingles some share a tag. The second text of a pair keeps just enough, or just too few, of the first's.
    docs, n = [], 60_000
    for pair, extra in enumerate([0, 1]):
        words = [f"{pair}.{i}" for i in range(n + 4)]
        same = -(-n * 75 // 100) - extra
        docs += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(words[: same + 4]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: (n, 0), 1: (45_000, 0), 2: (n, 2), 3: (44_999, 3)}


def test_folded_tokens_are_counted(spark):
    from strandlake.llm import jaccard

    text = " ".join(f"w{i}" for i in range(200_000))
    row = jaccard._surveyed(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("doc_id = 1").first()
    s = shingles(text)
    assert row.folds == len(s) - len({int(x) & 0xFFFFFFFF for x in s}) and row.n == len(s)
