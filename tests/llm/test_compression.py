import random

import pytest

from strandlake.llm.compression import BANDS, CHUNK_BAND, LAST_BAND, Bands, Rules, duplicate_lines, kept_documents, quality_rules, repeated_words


SYLLABLES = [a + b for a in "bcdfghklmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "er")]


def words_of(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    w = words_of(text)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), failed


def brute_kept(text):
    """The verdict, from the bands' figures alone."""
    import zstandard

    data = (text or "").encode()
    ratio = lambda part: len(zstandard.compress(part, 3)) / len(part)
    if brute(text)[5]:
        return False
    limits = [(low, high) for start, low, high in BANDS if start <= len(data)][-1]
    judged = [(data, limits)]
    if len(data) > 2048:
        judged += [(data[i : i + 2048], CHUNK_BAND) for i in range(0, len(data) - 2047, 2048)]
        rest = data[len(data) // 2048 * 2048 :]
        judged += [(rest, LAST_BAND)] * (len(rest) >= 1024)
    return all(low <= ratio(part) <= high for part, (low, high) in judged)


def texts():
    rng = random.Random(3)
    vocab = ["a", "bé", "cc#", "d|d", "the", " x"] + ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    out = [None, "", " \n\t", "a b c a b c", "x\nx\n\nx", "same " * 300, "\n".join(["one two three"] * 40)]
    for _ in range(60):
        w = rng.choices(vocab[: rng.choice([6, 30, 206])], k=rng.randint(0, 150))
        out.append("".join(x + rng.choice([" ", "\n", "\t", "  "]) for x in w))
    return out


def test_base_counts(spark):
    given = list(enumerate(texts())) + [(None, "a b")]
    got = quality_rules(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert [tuple(r)[1:7] for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == [brute(t) for _, t in given]
    assert not any(r.kept and r.base_failed for r in got)


def test_kept_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    given = [prose(n) for n in (49, 50, 60, 120, 300, 700, 1500)] + [prose(200) + " " + "x" * n for n in (100, 1000, 1500, 4000)] + [f"{prose(150)} {prose(40)} " * 3, "é" * 900 + prose(80)]
    given += ["".join(chr(rng.randint(33, 126)) + " " * (rng.random() < 0.2) for _ in range(n)) for n in (300, 900, 5000)] + [prose(rng.randint(50, 900)) for _ in range(20)]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).collect()}
    want = {k: brute_kept(t) for k, t in enumerate(given)}
    assert got == want and 5 < sum(want.values()) < len(want) - 5


def test_bands():
    rng = random.Random(1)
    prose = " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(900))
    noise = "".join(chr(rng.randint(33, 0x2FF)) for _ in range(3000))
    bands = Bands()
    assert bands.within(prose.encode()) and bands.within(b"")
    assert not bands.within(b"word " * 500) and not bands.within(noise.encode())
    assert not bands.within((prose + "x" * 2500).encode())  # one chunk is repetitive


def test_kept_documents(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(300))
    docs = spark.createDataFrame([(1, prose, "x"), (2, "word " * 300, "y"), (3, None, "z"), (None, prose, None)], "doc_id long, text string, kept string")
    out = kept_documents(docs)
    assert out.dtypes == docs.dtypes
    assert sorted((r.kept or "" for r in out.collect())) == ["", "x"]
    assert kept_documents(docs.where("false")).collect() == [] == quality_rules(docs.where("false")).collect()


@pytest.mark.parametrize("text", ["", "a", "a\na", "a\n \na\nb"])
def test_lines_and_words(text):
    assert duplicate_lines(text) == brute(text)[3] and repeated_words(words_of(text)) == brute(text)[4]


def test_long_clean_texts():
    rng = random.Random(2)
    vocab = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(8000)]
    prose = " ".join(rng.choices(vocab, [1 / (k + 2) for k in range(len(vocab))], k=500_000)).encode()
    bands = Bands()
    for n in (100_000, 500_000, 1_500_000, len(prose)):
        assert bands.within(prose[:n]), (n, bands.size(prose[:n]) / n)
    assert len(prose) > 2_500_000 and bands.size(prose) < 0.375 * len(prose)
    assert not bands.within(prose[:500_000] * 5) and not bands.within(prose[:40_000] * 2)


PARTS = {
    "de": "en er ch ie sch un ein be st ver ge au tz heit ung keit lich pf ö ü ä ß zu ach",
    "en": "th he in er an re on at nd st es en of te ed or ti hi as to ing ion ent ly ble",
    "es": "ción os as ar ado es ta ra en la qu ie mente do ó ñ ga rr co mi el ja no ez",
    "fr": "eau é è tion ou que en re le ai an er ment on eux pa ç ê ier elle oi vi aux ch",
}


@pytest.mark.parametrize("lang", sorted(PARTS))
def test_long_clean_texts_of_each_language(lang):
    rng = random.Random(lang)
    parts = PARTS[lang].split()
    word = lambda: "".join(rng.choices(parts, k=rng.choice([1, 2, 2, 3, 3, 4])))
    common = [word() for _ in range(12)]
    sentence = lambda: " ".join(rng.choice(common) if rng.random() < 0.25 else word() for _ in range(rng.randint(4, 18))).capitalize() + rng.choice("..?!")
    text = "\n".join(" ".join(sentence() for _ in range(rng.randint(2, 6))) for _ in range(9000))
    assert len(text) > 2_000_000
    rules = Rules()
    for n in (40_000, 100_000, 400_000, 1_100_000, len(text)):
        assert rules.judge(text[:n])[-1], (lang, n)
    assert not rules.judge(text[:200_000] * 4)[-1]
