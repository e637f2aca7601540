"""Interval operators. Intervals are half open; a band or overlap join is an equi-join on bins with a residual predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import settled


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keys else f"{prefix}{c}") for c in df.columns])


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, low: int, high: int, left_prefix: str = "l_", right_prefix: str = "r_") -> DataFrame:
    """Rows of left and right with equal keys whose distance right.end - left.start lies in [low, high].

    A left row has one bin, a right row two, so a pair meets once. Columns but the keys get the prefixes. Nulls match nothing.
    """
    if low < 0 or low > high:
        raise ValueError("a band needs 0 <= low <= high")
    width = max(1, high)
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width))
    a = _renamed(left, keys, left_prefix).withColumn("_bin", bin_of(f"{left_prefix}{start}"))
    b = _renamed(right, keys, right_prefix).withColumn("_bin", F.explode(F.array(bin_of(f"{right_prefix}{end}"), bin_of(f"{right_prefix}{end}") - 1)))
    distance = F.col(f"{right_prefix}{end}") - F.col(f"{left_prefix}{start}")
    return a.join(b, [*keys, "_bin"]).where(distance.between(low, high)).drop("_bin")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int = 1 << 14, left_prefix: str = "l_", right_prefix: str = "r_") -> DataFrame:
    """Pairs with equal keys where left.start < right.end and left.end > right.start.

    Each side is dealt to all bins it touches; a pair is taken in the bin where the later of the two starts, so it comes
    once and needs no distinct. width should be about the usual length. Empty intervals overlap what they lie inside of.
    """
    def binned(df: DataFrame, prefix: str) -> DataFrame:
        named = _renamed(df, keys, prefix)
        s, e = F.col(f"{prefix}{start}"), F.col(f"{prefix}{end}")
        return named.where(s.isNotNull() & (e >= s)).withColumn("_bin", F.explode(F.sequence(F.floor(s / width), F.floor(F.greatest(s, e - 1) / width))))

    a, b = binned(left, left_prefix), binned(right, right_prefix)
    ls, le, rs, re = (F.col(f"{p}{c}") for p in (left_prefix, right_prefix) for c in (start, end))
    return a.join(b, [*keys, "_bin"]).where((ls < re) & (le > rs) & (F.col("_bin") == F.floor(F.greatest(ls, rs) / width))).drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", anti: bool = False, width: int = 1 << 14) -> DataFrame:
    """The rows of left that overlap any of right; with anti, those that overlap none. Rows are told apart by all columns."""
    found = overlap_join(left, right.select(*keys, start, end), keys, start, end, width, "", "_r_").select(*left.columns).distinct()
    a, b = left.alias("a"), found.alias("b")
    same = F.lit(True)
    for c in left.columns:
        same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return a.join(b, same, "left_anti" if anti else "left_semi").select(left.columns)


def containment_join(inner: DataFrame, outer: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int = 1 << 14, left_prefix: str = "l_", right_prefix: str = "r_") -> DataFrame:
    """Pairs with equal keys where inner lies wholly in outer."""
    a = _renamed(inner, keys, left_prefix).withColumn("_bin", F.floor(F.col(f"{left_prefix}{start}") / width))
    b = _renamed(outer, keys, right_prefix)
    s, e = F.col(f"{right_prefix}{start}"), F.col(f"{right_prefix}{end}")
    b = b.where(s.isNotNull() & (e >= s)).withColumn("_bin", F.explode(F.sequence(F.floor(s / width), F.floor(e / width))))
    return a.join(b, [*keys, "_bin"]).where((F.col(f"{left_prefix}{start}") >= s) & (F.col(f"{left_prefix}{end}") <= e)).drop("_bin")


def _per_bin(df: DataFrame, bins: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """df with the columns of bins, by keys (null ones too) and _bin."""
    same = F.col("a._bin").eqNullSafe(F.col("b._bin"))
    for k in keys:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return df.alias("a").join(bins.alias("b"), same).select("a.*", *[f"b.{c}" for c in columns])


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", pad: int = 0, width: int = 1 << 20) -> DataFrame:
    """keys, start, end, n of the unions of intervals that overlap or touch, each grown by pad on both sides first (not below 0).

    Intervals are merged within bins of their starts. What no other bin touches is final; of the rest each bin has two rows at
    most (what earlier bins reach into, and what reaches on), and these are stitched key by key. Nulls take no part. What the
    bins hold is computed once and kept, as it is looked at four times.
    """
    grown = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.greatest(F.col(start) - pad, F.lit(0)).alias(start) if pad else F.col(start), (F.col(end) + pad).alias(end))
    ahead = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)

    def islands(rows: DataFrame, by: list[str], n: Column) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(start, end)
        reach = F.max(end).over(ahead(order))
        marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order))
        return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), n.alias("n")).drop("_island")

    local = settled(islands(grown.withColumn("_bin", F.floor(F.col(start) / width)), [*keys, "_bin"], F.count("*")))
    bins = local.groupBy(*keys, "_bin").agg(F.max(end).alias("_reach")).withColumn("_ahead", F.max("_reach").over(ahead(Window.partitionBy(*keys).orderBy("_bin"))))
    placed = _per_bin(local, bins, keys, "_ahead").withColumn("_in", F.coalesce(F.col(start) <= F.col("_ahead"), F.lit(False)))
    alone = ~F.col("_in") & (F.col(end) < (F.col("_bin") + 1) * width)
    rest = placed.where(~alone).groupBy(*keys, "_bin", "_in").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("_bin", "_in")
    columns = [*keys, start, end, "n"]
    return placed.where(alone).select(columns).union(islands(rest, list(keys), F.sum("n")).select(columns))


def smallest_gap(df: DataFrame, keys: Sequence[str], value: str, below: float, width: int = 1 << 20) -> DataFrame:
    """keys, min_gap, n_conflicts: the smallest distance of neighbours in order of value, and how many lie below the limit.

    Neighbours within bins of the value meet bin by bin; then each bin's first meets the last of the bin before it.
    """
    binned = df.select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_bin"))
    inner = binned.withColumn("_gap", F.col("_v") - F.lag("_v").over(Window.partitionBy(*keys, "_bin").orderBy("_v")))
    bins = inner.groupBy(*keys, "_bin").agg(F.min("_gap").alias("_inner"), F.count_if(F.col("_gap") < below).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    outer = bins.withColumn("_outer", F.col("_low") - F.lag("_high").over(Window.partitionBy(*keys).orderBy("_bin")))
    return outer.groupBy(*keys).agg(F.min(F.least("_inner", "_outer")).alias("min_gap"), (F.sum("_n") + F.count_if(F.col("_outer") < below)).alias("n_conflicts"))


def distance_to(start: str, end: str, at: Column) -> Column:
    """0 inside an interval, else how far outside."""
    return F.greatest(F.col(start) - at, at - F.col(end) + 1, F.lit(0))
