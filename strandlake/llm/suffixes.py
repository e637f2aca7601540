"""Suffix-array dedup: a common-prefix-aware distributed merge sort of the suffixes that can repeat.

A string of LENGTH bytes that two documents share holds, at the same place in both, the same anchor: its smallest K-gram by
a hash. So suffixes are taken at anchors only, and of these only at anchors that texts of different content share. Tasks
sort their suffixes, settle what repeats among their own documents, and exchange the rest as front-coded sorted runs, dealt
by anchor. A loser tree merges a bucket's runs; it knows each head's common prefix with the last winner, and never compares
bytes before it. Common prefixes of neighbours to the right of the anchor, and of sorted contexts to its left, then tell
exactly which strings are equal, and the smallest document of each.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows
from .sharing import groups, shared_tags, tagged

LENGTH, K = 50, 20
SPAN = LENGTH - K + 1
#: Windows hashed at once, suffixes that a task holds before it sends a run, and suffixes that are settled at once.
BLOCK, HELD_SUFFIXES, BATCH = 1 << 20, 150_000, 60_000
#: Text bytes for each task and bucket.
TASK_BYTES = 24 << 20

_P = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each K-gram, by doubling."""
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    h = h16[: len(data) - K + 1] * _power(4) + h4[16 : 16 + len(data) - K + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block of windows of LENGTH bytes: the anchors' hashes and places, and the first and last window of each."""
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(whole) - LENGTH + 1, BLOCK):
        part = whole[start : start + BLOCK + LENGTH - 1]
        h = kgram_hashes(part)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes counts
        width = 1
        while width < SPAN:
            step = min(width, SPAN - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        at = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        place = at[first]
        yield h[place], place + start, first + start, last + start


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix of a and b, of which known bytes are known."""
    n = min(len(a), len(b))
    if known >= n:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def neighbours(texts: list[bytes], width: int) -> np.ndarray:
    """The common prefix of each text, none over width, with the one before."""
    flat = np.frombuffer(b"".join([t.ljust(width, b"\0") for t in texts]), np.uint8).reshape(-1, width)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    same = flat[1:] == flat[:-1]
    return np.append(0, np.minimum(np.where(same.all(1), width, same.argmin(1)), np.minimum(n[1:], n[:-1])))


class LoserTree:
    """Merges sorted sources of (prefix shared with the source's last item, bytes, payload).

    Yields (prefix shared with the last item yielded, bytes, payload). At every node the loser keeps its common prefix
    with the item that beat it, so a match between unlike prefixes is decided without the bytes, and one between like
    prefixes looks at the bytes behind them only.
    """

    def __init__(self, sources: list[Iterator[tuple[int, bytes, object]]]):
        self.sources, n = sources, len(sources)
        self.head: list = [None] * n
        self.prefix = [0] * n
        self.tree: list[int | None] = [None] * max(1, n)
        for s in range(n):
            self.advance(s)
            self.prefix[s] = min(self.prefix[s], 0)
            self.climb(s)

    def advance(self, s: int) -> None:
        item = next(self.sources[s], None)
        self.head[s] = item
        self.prefix[s] = item[0] if item else -1

    def climb(self, s: int) -> None:
        """s plays its way up; where a place is still free, it waits there."""
        tree, head, prefix, n = self.tree, self.head, self.prefix, len(self.sources)
        node = (s + n) >> 1
        while node > 0:
            other = tree[node]
            if other is None:
                tree[node] = s
                return
            p, q = prefix[s], prefix[other]
            if p < q:  # the longer known prefix comes first; an ended source has -1
                tree[node], s = s, other
            elif p == q and p >= 0:
                a, b = head[s][1], head[other][1]
                k = common(a, b, p)
                if k == len(a) or (k < len(b) and a[k] < b[k]):
                    prefix[other] = k
                else:
                    prefix[s] = k
                    tree[node], s = s, other
            node >>= 1
        tree[0] = s

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.sources:
            s = self.tree[0]
            if self.head[s] is None:
                return
            yield self.prefix[s], self.head[s][1], self.head[s][2]
            self.advance(s)
            self.climb(s)


def repeats(prefix: np.ndarray | list[int], suffixes: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted suffixes (bytes, (left context from the anchor on, doc, place, least, most)) and their common prefixes with
    the one before: windows by suffix and offset of the anchor in it; which there are, and which a smaller document has too.
    """
    n = len(suffixes)
    least, most = (np.array([x[1][k] for x in suffixes], np.int64) for k in (3, 4))
    there = (least[:, None] <= np.arange(SPAN)) & (np.arange(SPAN) <= most[:, None])
    gone = np.zeros((n, SPAN), bool)
    right = np.array(prefix, np.int64)
    right[0] = 0
    meets = right >= K
    some = np.flatnonzero(meets | np.append(meets[1:], False))  # an anchor that no other suffix has is done
    if not len(some):
        return there, gone
    left = [suffixes[k][1][0] for k in some.tolist()]
    doc = np.array([suffixes[k][1][1] for k in some.tolist()], np.int64)
    right, now = right[some], there[some]
    order = sorted(range(len(some)), key=left.__getitem__)
    near = neighbours([left[k] for k in order], SPAN)
    rank = np.empty(len(some), np.int64)
    for o in range(SPAN):
        active = np.flatnonzero(now[:, o])
        if len(active) < 2:
            continue
        rank[order] = np.cumsum(near < o)
        key = np.cumsum(right < LENGTH - o)[active] * n + rank[active]
        by = np.lexsort((doc[active], key))
        start, end = groups(key[by])
        first = np.repeat(doc[active][by][start], end - start)
        gone[some[active[by]], o] = doc[active][by] > first
    return there, gone


def _gone_spans(suffixes: list[tuple], gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and byte ranges of removed windows that follow each other: the start times 256, and the length."""
    at, o = np.nonzero(gone)
    rows = np.flatnonzero(gone.any(1)).tolist()
    place, doc = np.zeros(len(gone), np.int64), np.zeros(len(gone), np.int64)
    doc[rows], place[rows] = [suffixes[k][1][1] for k in rows], [suffixes[k][1][2] for k in rows]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (o[1:] != o[:-1] + 1))[: len(at)])
    last = np.append(first[1:], len(at))[: len(first)] - 1
    start = place[at[first]] - o[last]
    return doc[at[first]], start * 256 + (o[last] - o[first] + LENGTH)


_RUN = "bucket int, docs_gone binary, spans binary, prefix binary, length binary, rest binary, left_length binary, lefts binary, docs binary, places binary, least binary"


def _run(bucket: int, suffixes: list[tuple]) -> tuple:
    """A front-coded sorted run."""
    prefix = neighbours([x[0] for x in suffixes], LENGTH).tolist()
    columns = list(zip(*(x[1] for x in suffixes), strict=True))
    return (
        bucket, None, None, bytes(prefix), bytes(len(x[0]) for x in suffixes), b"".join(x[0][p:] for x, p in zip(suffixes, prefix, strict=True)), bytes(map(len, columns[0])), b"".join(columns[0]),
        np.array(columns[1], np.int64).tobytes(), np.array(columns[2], np.int64).tobytes(), bytes(columns[3]),
    )


def _unrun(run: dict) -> Iterator[tuple[int, bytes, tuple]]:
    docs, places, rest, lefts = np.frombuffer(run["docs"], np.int64).tolist(), np.frombuffer(run["places"], np.int64).tolist(), run["rest"], run["lefts"]
    last, at, begin = b"", 0, 0
    for prefix, length, n_left, doc, place, least in zip(run["prefix"], run["length"], run["left_length"], docs, places, run["least"], strict=True):
        last = last[:prefix] + rest[at : at + length - prefix]
        at += length - prefix
        yield prefix, last, (lefts[begin : begin + n_left], doc, place, least, n_left)
        begin += n_left


def _suffix_runs(docs: DataFrame, buckets: int) -> DataFrame:
    def flush(held: list[tuple]) -> Iterator[tuple]:
        held.sort(key=itemgetter(0))
        there, gone = repeats(neighbours([x[0] for x in held], LENGTH), held)
        docs_gone, spans = _gone_spans(held, gone)
        yield len(held) % buckets, docs_gone.tobytes(), spans.tobytes(), *[None] * 8
        ask = there & ~gone
        least, most = ask.argmax(1), SPAN - 1 - ask[:, ::-1].argmax(1)
        by: dict[int, list] = {}
        for x, some, lo, hi in zip(held, ask.any(1).tolist(), least.tolist(), most.tolist(), strict=True):
            if some:
                text, (left, doc, place, _, _), bucket = x
                by.setdefault(bucket, []).append((text[: LENGTH - lo], (left[:hi], doc, place, lo, hi)))
        for bucket, suffixes in by.items():
            suffixes.sort(key=lambda x: x[0])
            yield _run(bucket, suffixes)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        gc.disable()  # hundreds of thousands of tuples, and no circles among them
        held: list[tuple] = []
        for doc_id, data, tags in it:
            if not tags:
                continue
            known = np.unique(np.array(tags, np.int64)).view(np.uint64)
            for h, place, first, last in anchors(data):
                tag = tagged(h, buckets)
                hit = known[np.minimum(np.searchsorted(known, tag), len(known) - 1)] == tag
                bucket = (tag[hit] >> np.uint64(32)).astype(np.int64)
                for m, p, q, b in zip(place[hit].tolist(), first[hit].tolist(), last[hit].tolist(), bucket.tolist(), strict=True):
                    held.append((data[m : q + LENGTH], (data[p:m][::-1], doc_id, m, m - q, m - p), b))
            if len(held) >= HELD_SUFFIXES:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    return arrow_rows(docs, _RUN, rows, out_batch=32)


def _merged(found: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    prefix, held, runs = [], [], found.to_pylist()
    yield from ((np.frombuffer(r["docs_gone"], np.int64), np.frombuffer(r["spans"], np.int64)) for r in runs if r["spans"] is not None)
    for shared, text, payload in LoserTree([_unrun(r) for r in runs if r["spans"] is None]):
        if shared < K and len(held) >= BATCH:
            yield _gone_spans(held, repeats(prefix, held)[1])
            prefix, held = [], []
        prefix.append(shared)
        held.append((text, payload))
    if held:
        yield _gone_spans(held, repeats(prefix, held)[1])


def _merged_table(key: tuple, found: pa.Table) -> pa.Table:
    gc.disable()
    docs, spans = zip(*_merged(found), strict=True)
    return pa.table({"doc_id": np.concatenate(docs), "span": np.concatenate(spans)})


def _cleaned(docs: DataFrame, with_kept: bool) -> DataFrame:
    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, data, whole, lists in it:
            n, removed, kept = len(data), [], []
            if whole:
                removed = [[0, n]]
            elif lists:
                for span in sorted(lists):
                    a, b = span >> 8, (span >> 8) + (span & 255)
                    if removed and a <= removed[-1][1]:
                        removed[-1][1] = max(b, removed[-1][1])
                    else:
                        removed.append([a, b])
            at = 0
            for a, b in removed:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            row = doc_id, n, n - len(kept), len(removed), hashlib.sha256(kept).hexdigest()
            yield (*row, kept) if with_kept else row

    return arrow_rows(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept, rows, out_batch=256)


def _anchor_tags(buckets: int):
    def tags_of(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, data in it:
            if doc_id is not None and len(data) >= LENGTH:
                same = np.uint64(xxhash.xxh64_intdigest(data))
                for h, _, _, _ in anchors(data):
                    yield doc_id, same, np.unique(tagged(h, buckets))

    return tags_of


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_kept, kept (the bytes left) of every document.

    Bytes go that are covered by a string of LENGTH bytes which also starts in a document with a smaller doc_id. Null texts
    are empty; texts under LENGTH bytes stay. A doc_id names one text; rows that repeat are treated alike, and are no smaller
    than each other. A row with a null id stays whole, and no other is compared with it. An empty table gives none. Other
    columns of docs are not read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8").alias("data"))
    size = docs.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(1, -(-size // task_bytes))
    tags = shared_tags(docs, _anchor_tags(buckets), buckets).groupBy("doc_id").agg(F.collect_list("tag").alias("tags"))

    # Equal texts: the smallest doc_id stands for all, the others go whole.
    copies = docs.where(f"doc_id is not null and length(data) >= {LENGTH}").select("doc_id", F.sha2("data", 256).alias("sha"))
    firsts = copies.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    whole = copies.join(firsts, "sha").where("doc_id > first").select("doc_id", F.lit(None).cast("long").alias("span"), F.lit(True).alias("whole"))

    # Both joins ask for the same deal of docs, which is made once.
    runs = _suffix_runs(docs.join(tags, "doc_id", "left").select("doc_id", "data", "tags"), buckets)
    merged = runs.groupBy("bucket").applyInArrow(_merged_table, "doc_id long, span long").withColumn("whole", F.lit(False))
    verdicts = merged.union(whole).groupBy("doc_id").agg(F.max("whole").alias("whole"), F.collect_list("span").alias("lists"))
    given = docs.join(verdicts, "doc_id", "left").select("doc_id", "data", F.coalesce("whole", F.lit(False)).alias("whole"), "lists")
    return _cleaned(given, with_kept)
