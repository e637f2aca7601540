"""Which tags (hashes) documents of different content share: a compact exchange of sorted arrays instead of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows

#: Tags that a task holds before it sends them.
HELD = 1 << 20
_MANY = np.iinfo(np.int64).max


def tagged(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a 64-bit hash, and 32 bits of its rest. Buckets grow with the input, and so do the bits in use."""
    return (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal sorted keys."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return start, np.append(start[1:], len(keys))


def _by_doc(docs: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    for a, b in zip(*groups(docs), strict=True):
        yield int(docs[a]), np.unique(values[a:b]).tobytes()


def _first_of_content(tags: np.ndarray, content: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by tag; of a tag's equal contents only the smallest document stays."""
    order = np.lexsort((docs, content, tags))
    tags, content, docs = tags[order], content[order], docs[order]
    keep = np.append(True, (tags[1:] != tags[:-1]) | (content[1:] != content[:-1]))[: len(tags)]
    return tags[keep], content[keep], docs[keep]


def _sent(tags: np.ndarray, content: np.ndarray, ids: np.ndarray, turn: int) -> Iterator[tuple]:
    """One entry for each tag; tags that are shared here already come back by document, on any bucket's way."""
    tag, same, doc = _first_of_content(tags, content, ids)
    start, end = groups(tag)
    many = np.repeat(end - start > 1, end - start)
    yield from (((turn + k), doc_id, data, None, None, None) for k, (doc_id, data) in enumerate(_by_doc(doc[many], tag[many])))
    doc, same, tag = np.where(many, _MANY, doc)[start], np.where(many, 0, same)[start], tag[start]
    bucket = (tag >> np.uint64(32)).astype(np.int64)
    for a, b in zip(*groups(bucket), strict=True):
        ids, first, at = np.unique(doc[a:b], return_index=True, return_inverse=True)
        order = np.argsort(at, kind="stable")
        yield int(bucket[a]), None, tag[a:b][order].astype(np.uint32).tobytes(), at[order].astype(np.uint32).tobytes(), ids.tobytes(), same[a:b][first].tobytes()


def _met(bucket: int, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The documents and their tags that are shared: those that come back, and those that meet here."""
    none, ids_none = np.empty(0, np.uint64), np.empty(0, np.int64)
    tags, content, docs, many, back, back_ids = [none], [none], [ids_none], [none], [none], [ids_none]
    for doc_id, tag, at, ids, same in zip(*(found[c].to_pylist() for c in ("doc_id", "tags", "at", "ids", "content")), strict=True):
        if doc_id is not None:
            back.append(np.frombuffer(tag, np.uint64))
            back_ids.append(np.full(len(back[-1]), doc_id, np.int64))
            continue
        tag = np.frombuffer(tag, np.uint32).astype(np.uint64) | (np.uint64(bucket) << np.uint64(32))
        at = np.frombuffer(at, np.uint32)
        doc = np.frombuffer(ids, np.int64)[at]
        some = doc == _MANY
        many.append(tag[some])
        tags.append(tag[~some])
        docs.append(doc[~some])
        content.append(np.frombuffer(same, np.uint64)[at][~some])
    tag, _, doc = _first_of_content(*map(np.concatenate, (tags, content, docs)))
    start, end = groups(tag)
    shared = np.repeat(end - start > 1, end - start) | np.isin(tag, np.unique(np.concatenate(many)))
    return np.concatenate([*back_ids, doc[shared]]), np.concatenate([*back, tag[shared]])


def shared_tags(docs: DataFrame, tags_of: Callable[[Iterator[tuple]], Iterable[tuple[int, np.uint64, np.ndarray]]], buckets: int) -> DataFrame:
    """doc_id, tag: those that other contents have too.

    tags_of makes (doc_id, hash of the content, distinct tags) of a partition's rows. Documents of equal content do not
    count as sharing; the smallest comes back, at times others too. A task sends a tag once, however many of its documents
    have it, so that no bucket gets more of a tag than there are tasks.
    """

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        tags, content, ids, held, turn = [], [], [], 0, 0
        for doc_id, same, found in tags_of(it):
            tags.append(found)
            content.append(np.full(len(found), same, np.uint64))
            ids.append(np.full(len(found), doc_id, np.int64))
            held += len(found)
            if held >= HELD:
                yield from ((r[0] % buckets, *r[1:]) for r in _sent(np.concatenate(tags), np.concatenate(content), np.concatenate(ids), turn))
                tags, content, ids, held, turn = [], [], [], 0, turn + 1
        if held:
            yield from ((r[0] % buckets, *r[1:]) for r in _sent(np.concatenate(tags), np.concatenate(content), np.concatenate(ids), turn))

    sent = arrow_rows(docs, "bucket int, doc_id long, tags binary, at binary, ids binary, content binary", rows, out_batch=64)

    def met(key: tuple, found: pa.Table) -> pa.Table:
        docs, tags = _met(key[0].as_py(), found)
        return pa.table({"doc_id": docs, "tag": tags.view(np.int64)})

    return sent.groupBy("bucket").applyInArrow(met, "doc_id long, tag long")
