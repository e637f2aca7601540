"""Bounded-space online best-fit packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

MODEL, CAPACITY, END_ID = "byte_bpe_50k.json", 1024, 2
#: Bins that are open at once, pieces that arrive together (the long ones are placed first), and pieces that one task packs at most.
OPEN_BINS, WINDOW, PIECES_A_TASK = 1024, 2048, 100_000
KEPT_PRETOKENS, KEPT_LENGTH = 1_000_000, 64
#: Texts with other characters than these go to the tokenizer whole: the two Unicode tables might differ on them.
UNUSUAL = re.compile("[^\t\n\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]|<\\|")
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class PretokenIds(dict):
    """The ids of a pre-token as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.spare = KEPT_PRETOKENS

    def merged(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, token: str) -> bytes:
        ids = self.merged(token)
        if self.spare > 0 and len(token) <= KEPT_LENGTH:
            self[token] = ids
            self.spare -= 1
        return ids

    def ids(self, text: str) -> bytes:
        if UNUSUAL.search(text):
            return self.merged(text)
        return b"".join(map(self.__getitem__, PRETOKEN.findall(text)))


@functools.cache
def pretoken_ids(path: str) -> PretokenIds:
    """One for each Python worker."""
    return PretokenIds(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document; with_ids adds the ids as an array.

    A null or empty text is the end id alone. Documents over the capacity are cut into pieces of exactly the capacity, the
    first one shorter if the length asks for it. Rows that repeat are each cut.
    """
    path = path or public_tokenizers.path(MODEL)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        known, end, width = pretoken_ids(path), np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for doc_id, text in it:
            ids = known.ids(text or "") + end
            cuts = [0, *range(len(ids) % width or width, len(ids) + 1, width)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                row = doc_id, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])
                yield (*row, np.frombuffer(ids[a:b], "<u4").tolist()) if with_ids else row

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return arrow_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), schema, rows)


class BestFit:
    """Open bins by free space: bit f of the set says that an open bin has f places free.

    A piece goes to the open bin with the least free space that holds it. Where a new bin would be one too many, the
    fullest open bin closes first.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.set, self.open, self.made, self.closed = 0, 0, 0, 0

    def take(self, free: int) -> int:
        held = self.bins[free]
        number = held.pop()
        if not held:
            self.set &= ~(1 << free)
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """The bin's number, and the place in it."""
        if fits := self.set >> length:
            free = length + (fits & -fits).bit_length() - 1
            number = self.take(free)
        else:
            if self.open >= self.most:
                self.take((self.set & -self.set).bit_length() - 1)
                self.closed += 1
            number, free = self.made, self.capacity
            self.made += 1
        if left := free - length:
            self.bins[left].append(number)
            self.set |= 1 << left
            self.open += 1
        return number, self.capacity - free


def placed(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    fit = BestFit(capacity, open_bins)
    return map(fit.put, lengths)


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK, n_rows: int | None = None) -> DataFrame:
    """cut (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    The pieces are dealt by a hash of all their columns over as many tasks as their number asks for, and arrive in the order
    of another; each task packs its own as they come, window by window, in memory bounded by open_bins and WINDOW. A piece
    never moves between tasks and the order is fixed, so a task that is lost is packed again alike. n_rows: how many rows
    there are at most; counted where it isn't given.
    """
    tasks = max(1, -(-(cut.count() if n_rows is None else n_rows) // pieces_a_task))
    dealt = cut.repartition(tasks, *cut.columns).sortWithinPartitions(F.xxhash64(F.lit(1), *cut.columns), *cut.columns)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        first, fit = TaskContext.get().partitionId() << 32, BestFit(capacity, open_bins)
        for window in batched(it, WINDOW):
            for row in sorted(window, key=lambda row: -row[3]):
                number, offset = fit.put(row[3])
                yield *row, first + number, offset

    return arrow_rows(dealt, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", rows)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, path: str | None = None) -> DataFrame:
    """Every document cut and packed; an empty table gives none. Other columns of docs are not read."""
    # A token has a byte at least, so there are no more pieces than this.
    n_docs, n_bytes = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return pack(pieces(docs, capacity, path), capacity, open_bins, n_rows=n_docs + (n_bytes or 0) // capacity)


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """The training sequences themselves: sequence_id, ids. A sequence holds at most the capacity."""
    order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(order, lambda x: x["ids"])).alias("ids"))
