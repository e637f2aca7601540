"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded, a gated attention learned from the labels of whole texts weighs the
codes, and their weighted sum is scored. The model is trained on the driver from all passages of a bounded sample of labelled
texts, and applied to every passage of every text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

#: Words of a passage; labelled texts to learn from, and the passages of all of them together: the sample ends where the next
#: text would be one too many of either. A text in the sample gives all its passages.
PASSAGE, SAMPLE, SAMPLE_PASSAGES = 64, 3000, 200_000
#: Counters into which words are hashed.
HASHED = 64
CODE, GATE, ROUNDS, RATE, DECAY, SEED = 16, 8, 250, 0.02, 1e-4, 7
THRESHOLD, FOLDS, HELD_OUT = 0.7, 4, 2

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", ";:", "!?", "#*$%&", "|", "<>/\\{}[]()", "\"'`", "-_=+~^@", "\t\r\v\f"]


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 2), np.float32)
    for k, chars in enumerate(_CLASSES):
        for c in chars.encode():
            table[c, k] = 1
    table[128:, -2] = 1
    table[table.sum(1) == 0, -1] = 1
    return table


_TABLE = _class_table()
N_FEATURES = _TABLE.shape[1] + 11 + HASHED


def passages(text: str | None, words: int = PASSAGE) -> np.ndarray:
    """A row of features for each passage of the whole text; an empty text is one passage of zeros."""
    data = (text or "").encode()
    found = data.split()
    if not found:
        return np.zeros((1, N_FEATURES), np.float32)
    # The words joined by blanks; the text's own white space counts by the whole text.
    total = max(1, len(data))
    lines = data.count(b"\n") / total * 100
    rows, seen = [], set()
    for at in range(0, len(found), words):
        part = found[at : at + words]
        n = len(part)
        joined = b" ".join(part)
        share = np.bincount(np.frombuffer(joined, np.uint8), minlength=256).astype(np.float32) @ _TABLE / len(joined)
        windows = set(zip(part, part[1:], part[2:], strict=False))
        again = len(windows & seen) / max(1, len(windows))
        seen |= windows
        kinds = set(part)
        same = sum(map(bytes.__eq__, part, part[1:])) / n
        marked = sum(w[-1] in b"#*$%&|!" for w in part) / n
        ended = sum(w[-1] in b".,;:?" for w in part) / n
        upper = sum(w.isupper() and len(w) > 1 for w in part) / n
        title = sum(65 <= w[0] <= 90 for w in part) / n
        hashed = np.bincount([zlib.crc32(w) % HASHED for w in part], minlength=HASHED) / n
        rows.append([*share, *hashed, len(kinds) / n, len(windows) / max(1, n - 2), again, same, marked, ended, upper, title, (len(joined) - n + 1) / n / 10, min(lines, 5), math.log(n) / 4])
    return np.array(rows, np.float32)


@dataclass
class Model:
    """The weights; see scores()."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of bags whose passages stand one after another in x, from the starts on."""
        return _forward(self.weights, (x - self.mean) / self.scale, start)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    n = np.diff(np.append(start, len(x)))
    h = np.tanh(x @ w["e"] + w["eb"])
    t, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    a = (t * g) @ w["a"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, start), n))
    a = a / np.repeat(np.add.reduceat(a, start), n)
    z = np.add.reduceat(h * a[:, None], start)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "n": n, "p": _sigmoid(z @ w["c"] + w["cb"])}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, start)
    d = (f["p"] - y) / len(y)
    dz = np.repeat(d[:, None] * w["c"], f["n"], 0)
    da = (dz * f["h"]).sum(1)
    ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, start), f["n"]))
    dt = ds[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
    dg = ds[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = dz * f["a"][:, None] + dt @ w["v"].T + dg @ w["u"].T
    de = dh * (1 - f["h"] ** 2)
    return {"e": x.T @ de, "eb": de.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ d, "cb": d.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: list[int], rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Adam on the whole sample; no labelled text gives a model that scores one half."""
    rng = np.random.default_rng(seed)
    size = lambda *s: rng.normal(0, 1 / math.sqrt(s[0]), s)
    w = {"e": size(N_FEATURES, CODE), "eb": np.zeros(CODE), "v": size(CODE, GATE), "u": size(CODE, GATE), "a": size(GATE), "c": np.zeros(CODE), "cb": np.zeros(1)}
    if not bags:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), w)
    x, y = np.concatenate(bags).astype(np.float64), np.array(labels, np.float64)
    start = np.cumsum([0, *map(len, bags[:-1])])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        rate = RATE * 0.5 * (1 + math.cos(math.pi * t / rounds))
        for k, g in _gradients(w, x, start, y).items():
            g = g + DECAY * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w)


def _held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_passages: int = SAMPLE_PASSAGES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """From labelled texts outside the held-out fold, in the order of a hash of the id, as many as sample allows, without those
    that sample_passages has no room for; these go to the driver. Labels without a document, or other than 0 and 1, are passed over."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~_held_out(F.col("doc_id")))
    there = docs.select(docs[id_col].cast("long").alias("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(known), "doc_id")  # sample rows of two numbers
    # Passages are counted first, where the texts are, so that no more than the bound leaves for the driver.
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "))
    sizes = texts.select("doc_id", F.ceil(words / PASSAGE).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.xxhash64("doc_id").alias("o"))
    chosen, total = [], 0
    for doc_id, n, _ in sizes.orderBy("o", "doc_id").collect():  # sample rows of three numbers
        if total + n > sample_passages:
            continue  # a very long text is left out, and those behind it are still learned from
        total += n
        chosen.append((doc_id,))
    if not chosen:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long")

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, y, text in it:
            yield doc_id, y, passages(text).tobytes()

    found = sorted(map(tuple, arrow_rows(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text"), "doc_id long, y int, x binary", rows, out_batch=64).collect()))
    return fit([np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for _, _, x in found], [y for _, y, _ in found])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", at_once: int = 4096) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts get a score as well. Rows that repeat are each scored; a null id stays null, and is not held out.
    Only the text is an input. Other columns are not read. Texts are scored together up to about at_once passages.
    """

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        def scored(held: list[tuple]) -> Iterator[tuple]:
            start = np.cumsum([0, *(len(x) for *_, x in held[:-1])])
            for (doc_id, out, _), p in zip(held, model.scores(np.concatenate([x for *_, x in held]), start).tolist(), strict=True):
                yield doc_id, out, p, int(p >= threshold)

        held, size = [], 0
        for doc_id, out, text in it:
            held.append((doc_id, out, passages(text)))
            size += len(held[-1][2])
            if size >= at_once:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return arrow_rows(texts.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"), "doc_id long, held_out boolean, score double, predicted int", rows)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The model learned from labels, applied to every document."""
    return score(docs, learn(docs, labels, sample), threshold)
