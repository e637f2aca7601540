import hashlib
import random

from strandlake.llm import suffixes
from strandlake.llm.suffixes import LENGTH, LoserTree, common, remove_repeats


def brute(docs):
    low = {}
    for d, t in docs:
        data = (t or "").encode()
        if d is not None:
            for i in range(len(data) - LENGTH + 1):
                s = data[i : i + LENGTH]
                low[s] = min(low.get(s, d), d)
    out = []
    for d, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        if d is not None:
            for i in range(len(data) - LENGTH + 1):
                if low[data[i : i + LENGTH]] < d:
                    gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, docs, **more):
    df = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), **more)
    return [tuple(r)[:5] for r in df.collect()]


def key(rows):
    return sorted(rows, key=str)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(40)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    shared = [text(rng.randint(5, 40)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[rng.randint(0, 9) :], text(rng.randint(0, 10))]
        docs.append((i, " ".join(parts)))
    docs += [(n + k, docs[k][1]) for k in range(5)]
    docs += [(n + 10, None), (n + 11, ""), (n + 12, "x" * 49), (n + 13, "ab" * 200), (n + 14, "ab" * 90), (n + 15, "a\0" * 60), (n + 16, "a\0" * 40), (None, docs[0][1]), (3, docs[3][1])]
    rng.shuffle(docs)
    return docs


def test_brute_force(spark):
    docs = corpus()
    assert key(run(spark, docs)) == key(brute(docs))


def test_many_buckets(spark):
    docs = corpus(2, 40)
    assert key(run(spark, docs, task_bytes=2000)) == key(brute(docs))


def test_blocks_batches_and_runs_in_process(monkeypatch):
    rng = random.Random(4)
    data = bytes(rng.choices(b"abc ", k=3000))
    whole = [[list(map(int, c)) for c in zip(*a, strict=True)] for a in suffixes.anchors(data)]
    monkeypatch.setattr(suffixes, "BLOCK", 64)
    parts = [[list(map(int, c)) for c in zip(*a, strict=True)] for a in suffixes.anchors(data)]
    window = lambda blocks: {w: (h, m) for block in blocks for h, m, p, q in block for w in range(p, q + 1)}
    assert window(whole) == window(parts) and len(window(whole)) == 3000 - LENGTH + 1


def test_empty_table_and_extra_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a" * 60, "x"), (2, "a" * 60, "y")], "doc_id long, text string, bucket string")
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(df).collect()) == [(1, 0), (2, 60)]


def test_loser_tree():
    rng = random.Random(3)
    runs = [sorted("".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(7)]
    coded = [iter([(common(a, b), b, None) for a, b in zip([b"", *r], r, strict=False)]) for r in runs]
    merged = list(LoserTree(coded))
    assert [m[1] for m in merged] == sorted(x for r in runs for x in r)
    assert all(m[0] == common(a[1], m[1]) for a, m in zip(merged, merged[1:], strict=False))
    assert list(LoserTree([])) == []
