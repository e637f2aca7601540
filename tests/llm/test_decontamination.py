import random
from collections import Counter

from strandlake.llm.decontamination import RADIUS, _fingerprints, _met, _pairs_within_radius, clean_documents, contaminated


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def bag(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words_of(t)
        for i, s in items:
            x = words_of(s)
            if not x:
                continue
            width = min(5, len(x))
            b = bag(x, width)
            best = 0
            for at in range(max(1, len(w) - len(x) + 1)):
                a = bag(w[at : at + len(x)], width)
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.75:
                out[(d, i)] = round(best, 9)
    return out


def test_brute_force(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeéA", k=rng.randint(1, 6))) for _ in range(80)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 4, 5, 8, 20, 35, 60])))) for k in range(25)]
    items += [(25, None), (26, ""), (27, "x x x x x x x x x x x x"), (28, items[9][1]), (None, items[8][1])]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 2)):
            x = (rng.choice(items)[1] or "").split(" ")
            if rng.random() < 0.4:
                x[rng.randrange(len(x))] = rng.choice(vocab)
            if rng.random() < 0.3:
                x = x[rng.randint(0, 4) : len(x) - rng.randint(0, 4)]
            parts += [" ".join(x), "\n" + " ".join(rng.choices(vocab, k=rng.randint(0, 30)))]
        docs.append((d, " ".join(parts)))
    docs += [(60, None), (61, ""), (62, "x " * 40), (63, items[20][1]), (63, items[20][1]), (None, items[21][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in contaminated(df, bench).collect()}
    assert found == brute(docs, items) and len(found) > 30
    shuffled = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in contaminated(df, bench, broadcast_rows=0).collect()}
    assert shuffled == found
    kept = sorted((r.doc_id for r in clean_documents(df, bench).collect()), key=str)
    assert kept == sorted((d for d, t in docs if not any(k[0] == d for k in found)), key=str)


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, "A b c d e f", 2)], "item_id long, text string, doc_id int")
    assert [(r.doc_id, r.item_id, r.similarity) for r in contaminated(docs, bench).collect()] == [(1, 7, 1.0)]
    assert contaminated(docs.where("false"), bench).collect() == []
    assert contaminated(docs, bench.where("false")).collect() == []
    assert clean_documents(docs, bench).columns == docs.columns


def test_all_within_the_radius(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(i, 5, 10, signed(x)) for i, x in enumerate(base)]
    windows = []
    for i in range(300):
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 30)):
            x ^= 1 << b
        windows.append((i, 5, 10, signed(x)))
    got = _pairs_within_radius(spark.createDataFrame(windows, "sid long, width int, m int, fp long"), spark.createDataFrame(items, "item long, width int, m int, fp long")).collect()
    want = {(w[0], i[0]) for w in windows for i in items if ((w[3] ^ i[3]) & (2**64 - 1)).bit_count() <= RADIUS}
    assert {(r.sid, r.item) for r in got} == want


def test_fingerprint_is_the_majority(spark):
    rng = random.Random(2)
    sets = [(i, [rng.getrandbits(63) - rng.getrandbits(63) for _ in range(n)]) for i, n in enumerate((1, 2, 7, 500))]
    for field in (16, 32):
        got = {r.id: r.fp & (2**64 - 1) for r in _fingerprints(spark.createDataFrame(sets, "id int, s array<bigint>"), ["id"], field).collect()}
        for i, s in sets:
            assert got[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s) > len(s))


def test_chance_and_recall_of_the_blocks(spark):
    rng = random.Random(3)
    fresh = lambda: rng.getrandbits(63) - rng.getrandbits(63)
    # Chance: windows against items of their size that they share nothing with.
    table = lambda name, n: spark.createDataFrame([(i, 5, 30, fresh()) for i in range(n)], f"{name} long, width int, m int, fp long")
    windows, items = table("sid", 200), table("item", 100)
    assert _met(windows, items).count() < 0.2 * 200 * 100
    assert _pairs_within_radius(windows, items).count() < 0.003 * 200 * 100
    # Recall at the threshold itself: 6 of 7 shingles in common is a similarity of 0.75.
    sets = []
    for k in range(400):
        m = 7 * rng.randint(2, 12)
        own = [fresh() for _ in range(m)]
        sets += [(k, own), (k + 1000, own[: 6 * m // 7] + [fresh() for _ in range(m // 7)])]
    fp = {r.id: r.fp & (2**64 - 1) for r in _fingerprints(spark.createDataFrame(sets, "id int, s array<bigint>"), ["id"]).collect()}
    assert sum((fp[k] ^ fp[k + 1000]).bit_count() <= RADIUS for k in range(400)) >= 392
