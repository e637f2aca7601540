"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

DataFrame functions only. Windows are taken where they can reach the similarity at all: a window and an item of equal
size that are similar enough share so many shingles, so a window holds as many shingles of items of its size, and it can
start at one of these. Equal windows are fingerprinted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, let, lowered, words_of, written

WORDS, PERCENT = 5, 75
#: Fingerprints of 64 bits in four blocks. Within the radius, one block at least differs in ERRORS bits at most. A window meets
#: an item of its size by chance in 0.15 blocks (2,517 of 65,536 values each), and lies in its radius with a probability of 7e-4.
BLOCKS, BLOCK_BITS, ERRORS = 4, 16, 4
RADIUS = BLOCKS * (ERRORS + 1) - 1
#: Bits of a counter in a packed sum, and the shingles up to which these do; beyond, 32 bits.
FIELD, SMALL = 16, (1 << 15) - 1
#: Benchmark shingles up to which they are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000


def _shingles(words: Column, width: int) -> Column:
    """The hashes of all runs of width words, in order."""

    def of(w: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
        return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), at)).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def _fingerprints(sets: DataFrame, key: list[str], field: int = FIELD) -> DataFrame:
    """key, fp: the majority of each bit over the shingles (column s, an array, repeats counting)."""
    a_long = 64 // field
    longs = [
        F.sum(sum((F.shiftright("h", a_long * k + j).bitwiseAND(F.lit(1)) * F.lit(1 << (field * j)) for j in range(1, a_long)), F.shiftright("h", a_long * k).bitwiseAND(F.lit(1)))).alias(f"c{k}")
        for k in range(64 // a_long)
    ]
    sums = sets.select(*key, F.explode("s").alias("h")).groupBy(*key).agg(F.count("*").alias("n"), *longs)
    bit = lambda b: F.when(2 * F.shiftrightunsigned(f"c{b // a_long}", field * (b % a_long)).bitwiseAND(F.lit((1 << field) - 1)) > F.col("n"), F.lit(-(1 << 63) if b == 63 else 1 << b)).otherwise(F.lit(0).cast("long"))
    fp = bit(0)
    for b in range(1, 64):
        fp = fp.bitwiseOR(bit(b))
    return sums.select(*key, fp.alias("fp"))


def _blocks(fp: str) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value")) for k in range(BLOCKS)])


def _near(value: Column) -> Column:
    """The block values within ERRORS bits."""
    masks = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << BLOCK_BITS) - 1).cast("long")), lambda m: F.bit_count(m) <= ERRORS)
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _met(windows: DataFrame, items: DataFrame) -> DataFrame:
    """sid, fp, item, item_fp of windows and items of equal width and size, once for each block that brings them together."""
    probes = windows.select("sid", "width", "m", "fp", F.inline(_blocks("fp")))
    index = items.select("item", "width", "m", F.col("fp").alias("item_fp"), F.inline(_blocks("fp"))).withColumn("value", F.explode(_near(F.col("value"))))
    # Merged: an item has thousands of index rows, which Spark would not see coming and might broadcast.
    return probes.join(index.hint("merge"), ["width", "m", "block", "value"]).select("sid", "fp", "item", "item_fp")


def _pairs_within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """sid, item of equal width and size whose fingerprints differ in RADIUS bits at most; all of them."""
    return _met(windows, items).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("sid", "item").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, item_id, similarity: documents that hold a window of the size of an item (in words; A-Z lowered)
    with similarity of at least percent / 100. A document with fewer words than the item is one window.

    The similarity is the weighted Jaccard index of the two bags of shingles; similarity is the highest of the windows'.
    Shingles are as many words as given, or all words of a shorter item. Items without words match nothing, nor do null,
    empty or blank texts. A null doc_id or item_id is kept as such. Rows that repeat give one row. Empty tables give none.
    Other columns are not read. The tables on the way are deleted; what comes back is a written table.
    """
    given = docs.select(docs[doc_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), words_of(lowered(docs[text_col])).alias("w"))
    items = benchmark.select(benchmark[item_col].alias("item_id"), words_of(lowered(benchmark[text_col])).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("width", F.least(F.size("w"), F.lit(words)))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # as many as words at most
    by_width = lambda df: [df.select("*", F.lit(k).alias("width"), _shingles(F.col("w"), k).alias("s")).drop("w") for k in widths]
    none = F.array().cast("array<bigint>")
    shingled = F.lit(None).cast("array<bigint>")
    for k in widths:
        shingled = F.when(F.col("width") == k, _shingles(F.col("w"), k)).otherwise(shingled)
    items = written(items.select("item_id", "width", F.coalesce(shingled, none).alias("s")).select("item_id", "width", "s", F.size("s").alias("m"), F.xxhash64("item_id", "width", "s").alias("item")), "items")
    field = FIELD if (items.agg(F.max("m")).first()[0] or 0) <= SMALL else 32
    known = items.select("width", "m", F.explode("s").alias("h")).distinct()
    if known.count() <= broadcast_rows:
        known = F.broadcast(known)

    def union(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.union(p)
        return whole

    if not widths:
        forget(items)
        return given.select("doc_id", "text_hash", F.lit(None).cast(dict(benchmark.dtypes)[item_col]).alias("item_id"), F.lit(0.0).alias("similarity")).where("false")
    texts = union(by_width(given))
    each = texts.select("doc_id", "text_hash", "width", F.size("s").alias("n"), F.posexplode("s").alias("at", "h"))
    hits = each.join(known, ["width", "h"]).groupBy("doc_id", "text_hash", "width", "n", "m").agg(F.sort_array(F.collect_set("at")).alias("at"))

    # Where a window can start: so many known shingles lie in the m from there on. Windows end with the document.
    least = F.ceil(2 * percent * F.col("m") / F.lit(100.0 + percent) - 1e-9).cast("int")
    most = F.col("n") - F.col("m")
    fitting = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("least")), lambda i: F.get("at", i + F.col("least") - 1) < F.get("at", i) + F.col("m"))
    starts = F.array_distinct(F.transform(fitting, lambda i: F.least(F.get("at", i), most)))
    last = F.when(F.get("at", F.size("at") - F.col("least")) >= most, F.array(most)).otherwise(F.array().cast("array<int>"))
    starts = F.when(most >= 0, F.when(F.size("at") >= F.col("least"), F.array_union(starts, last))).when((100 + percent) * F.size("at") >= percent * (F.col("m") + F.col("n")), F.array(F.lit(0)))
    windows = hits.withColumn("least", F.greatest(least, F.lit(1))).select("doc_id", "text_hash", "width", "n", "m", starts.alias("starts")).where(F.size("starts") > 0)
    windows = written(windows, "windows")

    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("doc_id", "text_hash", "width")]
    cut = texts.alias("t").join(windows.alias("v"), same).select("t.doc_id", "t.text_hash", "t.width", "v.m", "t.s", F.explode("v.starts").alias("from"))
    cut = cut.select("doc_id", "text_hash", "width", "m", F.expr("slice(s, from + 1, least(m, size(s)))").alias("s")).withColumn("sid", F.xxhash64("width", "m", "s"))
    cut = written(cut, "cut")
    kinds = cut.groupBy("sid").agg(F.first("width").alias("width"), F.first("m").alias("m"), F.first("s").alias("s"))
    kinds = written(kinds.join(_fingerprints(kinds.select("sid", "s"), ["sid"], field), "sid"), "kinds")
    item_kinds = items.groupBy("item").agg(F.first("width").alias("width"), F.first("m").alias("m"), F.first("s").alias("s"))
    item_kinds = item_kinds.join(_fingerprints(item_kinds.select("item", "s"), ["item"], field), "item")
    pairs = written(_pairs_within_radius(kinds, item_kinds), "pairs")

    bag = lambda df, key, c: df.select(key, F.explode("s").alias("h")).groupBy(key, "h").agg(F.count("*").alias(c))
    shared = pairs.join(bag(kinds, "sid", "c"), "sid").join(bag(item_kinds, "item", "d"), ["item", "h"]).groupBy("sid", "item").agg(F.sum(F.least("c", "d")).alias("both"))
    sized = shared.join(kinds.select("sid", "m", F.size("s").alias("k")), "sid")
    passed = sized.where(100 * F.col("both") >= percent * (F.col("m") + F.col("k") - F.col("both"))).select("sid", "item", (F.col("both") / (F.col("m") + F.col("k") - F.col("both"))).alias("similarity"))
    named = cut.select("doc_id", "text_hash", "sid").distinct().join(passed, "sid").join(items.select("item", "item_id"), "item")
    found = written(named.groupBy("doc_id", "text_hash", "item_id").agg(F.max("similarity").alias("similarity")), "leaks")
    forget(items, windows, cut, kinds, pairs)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item."""
    found = contaminated(docs, benchmark).select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(found["text_hash"])
    return docs.join(found, same, "left_anti")
