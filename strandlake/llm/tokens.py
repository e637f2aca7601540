"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come back as one token are proven and cost one. Texts are
cut where no merge can cross (before a space mark that follows another character, and around characters that no piece
holds); segments that are proven strings are counted directly, and only the rest goes through the merges.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame

from .common import arrow_rows

MODEL = "piece_bpe_32k.model"
#: Counts of merged segments that a worker keeps, and the longest segment kept.
KEPT_SEGMENTS, KEPT_LENGTH = 1_000_000, 64
MARK = "▁"


class SegmentCounts(dict):
    """Tokens of a segment (with " " for the space mark): proven strings at once, others by merging."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece of this model crosses the cuts")
        texts = [p.replace(MARK, " ") for p in pieces]
        super().__init__({t: 1 for t in texts if self.merged(t) == 1})
        self.proven = len(self)
        self.spare = KEPT_SEGMENTS

    def merged(self, segment: str) -> int:
        # The line feed is no part of any piece, so the segment is merged as inside a text; two tokens stand before it.
        return len(self.model.encode("\n" + segment)) - 2

    def __missing__(self, segment: str) -> int:
        n = self.merged(segment)
        if self.spare > 0 and len(segment) <= KEPT_LENGTH:
            self[segment] = n
            self.spare -= 1
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, SEGMENT.findall(" " + text.replace(MARK, " "))))


SEGMENT = re.compile(r" *[^ \n]+| +|\n")


@functools.cache
def segment_counts(path: str) -> SegmentCounts:
    """One for each Python worker."""
    return SegmentCounts(path)


def token_counts(docs: DataFrame, limit: int = 4096, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat are each counted; a null id stays null. Other columns
    of docs are not read, so their names cannot clash. Very long texts are cut into segments, never truncated.
    """
    path = path or public_tokenizers.path(MODEL)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        counts = segment_counts(path)
        for doc_id, text in it:
            text = text or ""
            n = counts.count(text)
            yield doc_id, len(text.encode()), n, n > limit

    return arrow_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", rows)
