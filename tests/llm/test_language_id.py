import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import language_id as L


def words(lang, n, rng):
    parts = {"en": ["th", "he", "ing", "and", "er"], "de": ["sch", "ung", "ein", "ü", "keit"], "fr": ["eau", "é", "tion", "ou", "que"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def texts(n=150, seed=4, longest=60):
    rng = random.Random(seed)
    return [(d, words(("en", "de", "fr")[d % 3], rng.randint(3, longest), rng), ("en", "de", "fr")[d % 3]) for d in range(n)]


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())


def plain_trees(rows, order):
    """lang -> context -> counts of the bytes that came after it."""
    trees = {}
    for _, text, lang in rows:
        data, tree = lowered(text), trees.setdefault(lang, {})
        for i in range(len(data)):
            for k in range(min(order, i) + 1):
                tree.setdefault(data[i - k : i], Counter())[data[i]] += 1
    return trees


def plain_bits(tree, data, order):
    bits = 0.0
    for i, byte in enumerate(data):
        for k in range(min(order, i), -1, -1):
            counts = tree.get(data[i - k : i])
            if counts is None:
                continue
            whole = sum(counts.values()) + len(counts)
            if counts[byte]:
                bits += math.log2(whole / counts[byte])
                break
            bits += math.log2(whole / len(counts))
        else:
            bits += 8
    return bits


def of_rows(rows, order):
    counts = {}
    for lang in {r[2] for r in rows}:
        for k in range(order + 1):
            all_grams = np.concatenate([L.grams(np.frombuffer(lowered(t), np.uint8), k) for _, t, at in rows if at == lang])
            counts[lang, k] = np.unique(all_grams, return_counts=True)
    return L.frozen(counts, order)


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_equal_plain_trees(order):
    rows = texts(60)
    model, trees = of_rows(rows, order), plain_trees(rows, order)
    for text in ["", "t", "The", "und die Scheune", "çà et là", "\x00\x01 ?", "the " * 500, *(t for _, t, _ in texts(9, 8))]:
        found = model.code_lengths(text.encode())
        for lang, bits in zip(model.langs, found, strict=True):
            want = plain_bits(trees[lang], lowered(text), order)
            assert abs(bits - want) <= 1e-5 * max(1, want), (lang, text)


def test_blocks_of_a_long_text(monkeypatch):
    model, text = of_rows(texts(60), 4), words("de", 3000, random.Random(1)).encode()
    whole = model.code_lengths(text)
    monkeypatch.setattr(L, "BLOCK", 100)
    assert np.allclose(whole, model.code_lengths(text), rtol=1e-9)


def test_spark_counts_equal_plain_counts(spark):
    rows = texts(90)
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = of_rows([r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1], L.ORDER)
    assert model.langs == want.langs
    for a, b in ((model.seen, want.seen), (model.costs, want.costs), (model.contexts, want.contexts), (model.escapes, want.escapes)):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_held_out_accuracy_and_contract(spark):
    rows = texts(240)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 .,!", "de"), (None, "the thing and", "en"), (3, rows[3][1], "fr"), (1003, "keitung schein", None), (1004, "the ing " * 100_000, "en")]
    got = L.identified(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "de" and by[None].lang_pred == by[1004].lang_pred == "en"
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, _, _ in rows) and by[None].held_out is False
    held = [by[d].lang_pred == lang for d, _, lang in rows if by[d].held_out]
    assert len(held) > 50 and sum(held) / len(held) > 0.95


def test_held_out_languages_are_not_read(spark):
    rows = texts(90)
    turned = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 3 == 1 else lang) for d, t, lang in rows]
    a, b = (sorted(map(tuple, L.identified(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect())) for r in (rows, turned))
    assert a == b


def test_sample_is_bounded(spark):
    rows = texts(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = L.learn(docs, sample_bytes=3000)
    first = small.contexts[0]
    assert len(first) == 1 and small.langs == ["de", "en", "fr"]
    assert len(small.seen[4]) < len(L.learn(docs).seen[4])


def test_nothing_to_learn_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string"
    assert L.identified(spark.createDataFrame([], schema)).count() == 0
    assert [r.lang_pred for r in L.identified(spark.createDataFrame([(1, "the", None), (2, "a", None)], schema)).collect()] == ["und", "und"]
    rows = texts(60)
    wide = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema + ", size int, total int, gram int, n int")
    plain = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, L.identified(wide).collect())) == sorted(map(tuple, L.identified(plain).collect()))
