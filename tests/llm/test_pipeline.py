import itertools
import random
import struct
import zlib

import public_tokenizers
import test_compression
import test_decontamination
import test_jaccard
import test_lines
from tokenizers import Tokenizer

import corpus_pipeline

SYLLABLES = [a + b for a in "bcdfghklmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "er")]


tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def tables():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, items = prose(14), [(k, prose(rng.randint(12, 40))) for k in range(6)]
    docs = []
    for d in range(40):
        text = "\n".join(prose(rng.randint(20, 60)) for _ in range(rng.randint(2, 5)))
        if d % 5 == 0:
            text = f"{line}{'x' * (d % 3)}\n{text}"
        if d % 7 == 0:
            text += "\n" + prose(3) + " " + rng.choice(items)[1] + " " + prose(4)
        docs.append((d, text))
    docs += [(40, "word " * 200), (41, None), (42, ""), (43, docs[3][1]), (44, docs[4][1] + " " + word()), (45, "short text")]
    return docs, items


def brute(docs, items):
    docs = [x for x in docs if test_compression.brute_kept(x[1])]
    docs = test_lines.brute(docs)
    named = {d: c for d, _, c in test_jaccard.brute(docs)}
    docs = [x for x in docs if named[x[0]] == x[0]]
    leaks = {d for d, _ in test_decontamination.brute(docs, items)}
    return [x for x in docs if x[0] not in leaks]


def test_run_against_brute_force(spark, tmp_path):
    docs, items = tables()
    rows = [(d, t, "en", f"src{d % 3}", None if t is None else len(t)) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = brute(docs, items)
    assert 10 < len(kept) < len(docs) - 8
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == corpus_pipeline.COLUMNS
    assert sorted((r.doc_id, r.text, r.n_chars) for r in at.collect()) == sorted((d, t, len(t)) for d, t in kept)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {d: [*tokens.encode(t, add_special_tokens=False).ids, 2] for d, t in kept}
    places = {d: sorted((r.start, r.length) for r in got if r.doc_id == d) for d in ids}
    assert {r.doc_id for r in got} == set(ids)
    for d, pieces in places.items():
        assert [a for a, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces)][:-1] and sum(n for _, n in pieces) == len(ids[d])
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
    assert len(corpus_pipeline.STAGES) == 5


def test_repeated_rows_nulls_and_empty_tables(spark, tmp_path):
    docs, items = tables()
    rows = [(d, t, "en", None, None if t is None else len(t), "x") for d, t in docs[:9] + docs[2:4] + [(None, docs[5][1]), (99, None)]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, piece string"
    given = spark.createDataFrame(rows, schema)
    spark.createDataFrame(items[:2] + [(None, None), (7, "")], "item_id long, text string").write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    given.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    # Rows that repeat stay as often, a row without an id stays too: neither names another document.
    assert sum(r.doc_id == 2 and r.piece == 0 for r in got) == 2 and any(r.doc_id is None for r in got) and not any(r.doc_id == 99 for r in got)
    given.where("false").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []
