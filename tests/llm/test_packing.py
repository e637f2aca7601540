import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm.packing import BestFit, MODEL, pack_documents, pieces, pretoken_ids, sequences


def texts():
    rng = random.Random(4)
    alphabet = ["the", "don't", "'s", " ", "  ", "\n", "\t", "é", "ß", "日本", " ", "😀", "<|endoftext|>", "12", "²", "_", "#*", "’", "’s", "…"]
    return [None, "", " ", "word " * 3000, "x" * 5000] + ["".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(80)]


def test_ids_are_the_tokenizers():
    path = public_tokenizers.path(MODEL)
    tok, known = Tokenizer.from_file(path), pretoken_ids(path)
    for t in texts():
        t = t or ""
        assert np.frombuffer(known.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(spark):
    given = list(enumerate(texts())) + [(None, "null id"), (1, "")]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("offset", F.lit("x"))
    got = pack_documents(docs).collect()
    tok = Tokenizer.from_file(public_tokenizers.path(MODEL))
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in given}
    by = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, x in ids.items():
        mine = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == d)
        if d != 1:
            assert sum(m[2] for m in mine) == len(x) and [m[0] for m in mine] == list(range(len(mine))) and all(m[2] == 1024 for m in mine[1:])
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    # Within one window the pieces come longest first; the plain scan below finds the same bins.
    assert len(by) == len(plain(sorted((r.length for r in got), reverse=True), 1024, 1024))


def plain(lengths, capacity, most):
    """Best fit with at most so many open bins, by looking at all of them: the lengths of each bin."""
    bins, open_now = [], []
    for n in lengths:
        fitting = [b for b in open_now if sum(bins[b]) + n <= capacity]
        if fitting:
            b = max(fitting, key=lambda b: (sum(bins[b]), 0))
        else:
            if len(open_now) >= most:
                open_now.remove(max(open_now, key=lambda b: sum(bins[b])))
            b = len(bins)
            bins.append([])
            open_now.append(b)
        bins[b].append(n)
        if sum(bins[b]) == capacity:
            open_now.remove(b)
    return bins


def test_as_many_bins_as_a_plain_scan_and_near_the_floor():
    rng = random.Random(8)
    lengths = [min(1024, int(rng.lognormvariate(5.5, 1))) or 1 for _ in range(3000)]
    for most in (4, 64, 1024):
        fit = BestFit(1024, most)
        for n in lengths:
            fit.put(n)
        # Bins with equal space are alike, so their number is the same whichever is taken.
        assert fit.made == len(plain(lengths, 1024, most))
    fit = BestFit(1024, 128)
    for at in range(0, len(lengths), 256):
        for n in sorted(lengths[at : at + 256], reverse=True):
            fit.put(n)
    assert fit.closed > 100 and fit.made <= 1.02 * sum(lengths) / 1024


def test_empty_and_sequences(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert pack_documents(docs.where("false")).collect() == []
    cut = pieces(docs, with_ids=True)
    where = pack_documents(docs).select("doc_id", "piece", "sequence_id", "offset")
    got = sequences(cut.join(where, ["doc_id", "piece"])).collect()
    assert sorted(len(r.ids) for r in got) == [5]


def test_best_fit():
    fit = BestFit(10, 2)
    assert fit.put(6) == (0, 0) and fit.put(7) == (1, 0)
    assert fit.put(3) == (1, 7)  # the fullest that holds it
    assert fit.put(5) == (2, 0) and fit.put(4) == (0, 6)
    fit = BestFit(10, 2)
    for n in (6, 7, 8):
        fit.put(n)
    assert fit.made == 3 and fit.open == 2 and fit.put(3) == (0, 6)  # bin 1, the fullest then, had closed


def test_never_more_than_the_open_bins():
    rng = random.Random(1)
    fit, left = BestFit(100, 8), {}
    for _ in range(2000):
        n = rng.randint(1, 100)
        b, at = fit.put(n)
        assert left.get(b, 0) == at and at + n <= 100 and fit.open <= 8
        left[b] = at + n
