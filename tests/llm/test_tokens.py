import random

import numpy as np
import public_tokenizers
import pytest

from strandlake.llm.tokens import MODEL, SegmentCounts, token_counts


@pytest.fixture(scope="module")
def counts():
    return SegmentCounts(public_tokenizers.path(MODEL))


def texts():
    rng = random.Random(2)
    alphabet = ["the", "ing", " ", "  ", "\n", "\t", "\r", "▁", "▁▁", "é", "ß", "日本", " ", "😀", "<s>", "</s>", "<0x0A>", "\x00", "Z", "9", "-", "     "]
    return ["", " ", "\n", "▁", "a", " a", "a ", "\na", "x" * 5000, " " * 100] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(500)]


def test_counts_are_the_models(counts):
    for t in texts():
        assert counts.count(t) == len(counts.model.encode(t)), repr(t)


def test_proven_strings_are_one_token(counts):
    from strandlake.llm.tokens import SegmentCounts

    fresh = SegmentCounts(public_tokenizers.path(MODEL))
    assert 20_000 < fresh.proven == len(fresh) and all(v == 1 for v in fresh.values())


def test_query(spark):
    docs = spark.createDataFrame([(1, "Hello é", "x"), (2, None, "y"), (2, "", "y"), (None, "a " * 5000, "z")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(docs).collect()), key=str)
    assert (2, 0, 0, False) in got and len(got) == 4
    assert [r for r in got if r[0] is None][0][3] is True
    assert [r for r in got if r[0] == 1][0][1] == 8
    assert token_counts(docs.where("false")).collect() == []
    assert np.all([r[1] >= 0 for r in got])
