"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes. A byte costs -log2 of its probability in the longest context
that the language's tree holds; where it was never seen there, the context's escape is paid and the next shorter context asked,
down to all 256 bytes alike. With n the bytes seen in a context and d the different ones, a byte seen k times has k / (n + d)
and the escape d / (n + d). A text's code length is the sum over its bytes; the language with the shortest code is predicted.

The trees are counted once, on a bounded sample of labelled texts, and frozen. What a byte costs in its context then is a number
for each language, so the frozen trees become one table: a gram (context and byte) that any tree holds has its whole costs,
escapes included, and a context has the costs of its escapes, for a byte that no tree holds there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

#: Bytes of the longest context; bytes of text a language learns from (as expected by a hash of the id), the most bytes times
#: languages of the whole sample (the table has a number for each gram and language), and the longest text that is learned from.
#: All texts are scored, whatever their length.
ORDER, SAMPLE_BYTES, CELLS, LONGEST = 4, 1_000_000, 64_000_000, 50_000
FOLDS, HELD_OUT = 3, 1
#: Bytes that are scored at once, and languages up to which their sums are broadcast.
BLOCK, BROADCAST_LANGS = 1 << 18, 100_000
UNKNOWN = "und"
#: Any letter of any script.
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """The k + 1 bytes that end at each byte from the k-th on, as one number; the last byte is the lowest."""
    n = len(data) - k
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k + 1):
        out = (out << np.uint64(8)) | data[j : j + len(out)].astype(np.uint64)
    return out


def found_at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Model:
    """langs; for each order the grams that some language saw with their costs in bits (a column a language), and the contexts
    with what their escape costs."""

    langs: list[str]
    seen: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of the whole of data in each language. The first bytes have as long a context as there is."""
        whole = np.frombuffer(data.translate(_LOWER), np.uint8)
        total = np.zeros(len(self.langs))
        order = len(self.seen) - 1
        for k in range(min(order, len(whole))):
            total += self._bits(grams(whole[: k + 1], k), k)
        for at in range(order, len(whole), BLOCK):
            total += self._bits(grams(whole[at - order : at + BLOCK], order), order)
        return total

    def _bits(self, keys: np.ndarray, k: int) -> np.ndarray:
        total = np.zeros(len(self.langs))
        while len(keys):
            at, there = found_at(self.seen[k], keys)
            total += self.costs[k][at[there]].sum(0, dtype=np.float64)
            keys = keys[~there]
            if k == 0:
                return total + 8 * len(keys) + len(keys) * self.escapes[0][0]
            at, there = found_at(self.contexts[k], keys >> np.uint64(8))
            total += self.escapes[k][at[there]].sum(0, dtype=np.float64)
            k, keys = k - 1, keys & np.uint64((1 << (8 * k)) - 1)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the shortest code and its share of 2 ** -bits; und and 0 without a letter."""
        if not self.langs or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        bits = self.code_lengths(text.encode())
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def frozen(counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """The model of counts: for a language and an order k, sorted grams of k + 1 bytes and how often they came."""
    langs = sorted({lang for lang, _ in counts})
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    model = Model(langs, [], [], [], [])
    for k in range(order + 1):
        own = [counts.get((lang, k), none) for lang in langs]
        seen = np.unique(np.concatenate([g for g, _ in own])) if own else none[0]
        contexts = np.unique(seen >> np.uint64(8)) if k else np.zeros(1, np.uint64)
        costs, escapes = np.zeros((len(seen), len(langs)), np.float64), np.zeros((len(contexts), len(langs)), np.float64)
        for j, (g, n) in enumerate(own):
            place = np.searchsorted(contexts, g >> np.uint64(8)) if k else np.zeros(len(g), np.int64)
            total = np.bincount(place, n, len(contexts))
            different = np.bincount(place, minlength=len(contexts))
            held = different > 0
            escapes[held, j] = np.log2((total + different)[held] / different[held])
            # The escape and the shorter context for all, then the bytes that this tree holds here.
            up = np.searchsorted(contexts, seen >> np.uint64(8)) if k else np.zeros(len(seen), np.int64)
            costs[:, j] = escapes[up, j] + (model.costs[k - 1][np.searchsorted(model.seen[k - 1], seen & np.uint64((1 << (8 * k)) - 1)), j] if k else 8)
            costs[np.searchsorted(seen, g), j] = np.log2((total + different)[place] / n)
        for kept, part in zip((model.seen, model.costs, model.contexts, model.escapes), (seen, costs.astype(np.float32), contexts, escapes.astype(np.float32)), strict=True):
            kept.append(part)
    return model


def _held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From texts with a language outside the held-out fold. Of each language whole texts of at most LONGEST bytes, whose
    hash of the id lies below the share that makes sample_bytes of it, or fewer where CELLS bounds very many languages. Their
    grams are counted where they are; the counts, no more than the sample has bytes an order, go to the driver.

    Texts without a letter and rows without an id teach nothing.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    able = own.where("lang is not null and doc_id is not null").where(~_held_out(F.col("doc_id"))).withColumn("size", F.octet_length("text")).where(F.col("size").between(1, LONGEST))
    totals = able.groupBy("lang").agg(F.sum("size").alias("total"))
    n_langs = totals.count()
    each = min(sample_bytes, CELLS // max(1, n_langs) ** 2)
    share = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 30)) / float(1 << 30)
    chosen = able.join(F.broadcast(totals) if n_langs <= BROADCAST_LANGS else totals, "lang").where(share * F.col("total") < each)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        def counted() -> Iterator[tuple]:
            for (lang, k), parts in held.items():
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                yield from ((lang, k, g, c) for g, c in zip(found.view(np.int64).tolist(), n.tolist(), strict=True))

        held: dict[tuple[str, int], list[np.ndarray]] = {}
        size = 0
        for lang, text in it:
            if not _LETTER.search(text):
                continue
            data = np.frombuffer(text.encode().translate(_LOWER), np.uint8)
            for k in range(order + 1):
                held.setdefault((lang, k), []).append(grams(data, k))
            size += len(data)
            if size > BLOCK:
                yield from counted()
                held, size = {}, 0
        yield from counted()

    each_task = arrow_rows(chosen.select("lang", "text"), "lang string, k int, gram long, n long", rows)
    table = each_task.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas()
    found = {}
    for (lang, k), part in table.groupby(["lang", "k"]):
        g, n = part["gram"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.int64)
        order_of = np.argsort(g)
        found[lang, int(k)] = g[order_of], n[order_of]
    return frozen(found, order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    A null text and one without a letter is "und" with a score of 0, and so is every text where nothing was learned. Rows that
    repeat are each predicted; a null id stays null and is not held out. Other columns are not read.
    """
    frozen_model = docs.sparkSession.sparkContext.broadcast(model)  # grows with the sample, not with docs

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, out, text in it:
            yield doc_id, out, *frozen_model.value.predict(text)

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return arrow_rows(texts.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"), "doc_id long, held_out boolean, lang_pred string, score double", rows)


def identified(docs: DataFrame) -> DataFrame:
    """Every document by what the documents outside the held-out fold teach."""
    return identify(docs, learn(docs))
