"""Quality rules: base counts, and zstandard ratios of whole documents and of fixed chunks within length-specific bands."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import WORD, arrow_rows

LEVEL, CHUNK = 3, 2048
#: Bytes from which a band holds; lowest and highest ratio of compressed to plain bytes for a whole text of that length.
#: Clean text's ratio falls with its length, up to the compressor's window of 2 MB: the least of de, en, es and fr was 0.370 at
#: 64 KB, 0.365 at 256 KB, 0.355 at 1.3 MB, and did not fall further up to 20 MB. The lower limits lie about 0.035 below.
BANDS = [
    (0, 0.0, 99.0),
    (256, 0.45, 0.90),
    (512, 0.45, 0.80),
    (1024, 0.43, 0.72),
    (2048, 0.425, 0.66),
    (4096, 0.405, 0.62),
    (8192, 0.39, 0.60),
    (16384, 0.375, 0.60),
    (32768, 0.345, 0.60),
    (65536, 0.335, 0.60),
    (262144, 0.33, 0.60),
    (1048576, 0.32, 0.60),
]
#: The same for chunks of CHUNK bytes, and for a last chunk of at least half that. A shorter rest isn't judged by itself.
CHUNK_BAND, LAST_BAND = (0.25, 0.75), (0.25, 0.85)

_WORDS, _SYMBOLS = re.compile(WORD), re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, n, upto = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            n += at + 3 - max(at, upto)
            upto = at + 3
    return n


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(lines) - len(set(lines))


class Bands:
    """The verdict of the compression bands on a text's bytes."""

    def __init__(self, level: int = LEVEL, chunk: int = CHUNK):
        import zstandard

        self.size = lambda data, z=zstandard.ZstdCompressor(level=level): len(z.compress(data))
        self.chunk, self.starts = chunk, [b[0] for b in BANDS]

    def within(self, data: bytes) -> bool:
        n = len(data)
        if not n:
            return True
        _, low, high = BANDS[bisect_right(self.starts, n) - 1]
        if not low <= self.size(data) / n <= high:
            return False
        if n > self.chunk:
            for at in range(0, n, self.chunk):
                part = data[at : at + self.chunk]
                if 2 * len(part) >= self.chunk:
                    low, high = CHUNK_BAND if len(part) == self.chunk else LAST_BAND
                    if not low <= self.size(part) / len(part) <= high:
                        return False
        return True


class Rules:
    """The counts and verdicts of a text."""

    def __init__(self) -> None:
        self.bands = Bands()

    def judge(self, text: str | None) -> tuple[int, int, int, int, int, bool, bool]:
        text = text or ""
        words = _WORDS.findall(text)
        repeated = repeated_words(words)
        failed = len(words) < 50 or 100 * repeated > 50 * len(words)
        kept = not failed and self.bands.within(text.encode())
        return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), duplicate_lines(text), repeated, failed, kept


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every whole text.

    A null text counts as empty: all counts 0, base_failed true, kept false. Rows that repeat are each judged; a null id
    stays null. Other columns of docs are not read. One document is judged at a time, however long.
    """

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        rules = Rules()
        for doc_id, text in it:
            yield doc_id, *rules.judge(text)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return arrow_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), schema, rows)


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text the rules keep."""
    at = docs.columns.index(text_col)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        rules = Rules()
        return (row for row in it if rules.judge(row[at])[-1])

    return arrow_rows(docs, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), rows, out_batch=256)
