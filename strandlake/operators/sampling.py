"""Bootstrap intervals by weights of a hash, and evenly spaced selections from quantile strata."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Resamples that one digest serves: four numbers of 32 bits.
A_DIGEST = 4
#: How often a row comes in a resample is Poisson distributed; up to so many times are told apart (one more has 1e-11).
MOST_TIMES = 12
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(MOST_TIMES)]


def times(word: Column) -> Column:
    """How often a row comes in a resample, by eight hexadecimal digits (lower case) as a number from 0 up to 1: digits of one length
    are in the order of their numbers, so that none is made of them."""
    out = F.lit(MOST_TIMES)
    for k in range(MOST_TIMES - 1, -1, -1):
        least = math.ceil(POISSON[k] * (1 << 32))
        out = F.when(word < f"{least:08x}", k).otherwise(out) if least < 1 << 32 else F.lit(k)
    return out


def bootstrap_mean(df: DataFrame, keys: Sequence[str], value: str, identity: Sequence[str], resamples: int = 1000, seed: int = 810_081, level: float = 0.95) -> DataFrame:
    """keys, n, mean, low, high of the mean of value in each group, by resampling.

    Every row has a weight in every resample, which a digest of its identity, the resample and the seed tells, so that a
    resample needs no other row of its group: sums are added up wherever the rows lie, and a group of any size is the work of
    many tasks. Rows that agree in identity come in the same resamples. Nulls don't count; a group without values has no mean.
    """
    known = df.where(F.col(value).isNotNull())
    digests = F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // A_DIGEST) - 1)))
    drawn = known.select(*keys, F.col(value).cast("double").alias("_x"), *[F.col(c).alias(f"_i{k}") for k, c in enumerate(identity)], digests.alias("_d"))
    name = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(f"_i{k}").cast("string"), F.lit("")) for k in range(len(identity))], F.col("_d").cast("string"))
    # The resamples of a digest are added up side by side, so that a row is one row for each digest.
    weighted = drawn.withColumn("_h", F.md5(name)).select(*keys, "_x", "_d", *[times(F.substring("_h", 8 * k + 1, 8)).alias(f"_w{k}") for k in range(A_DIGEST)])
    added = weighted.groupBy(*keys, "_d").agg(*[f for k in range(A_DIGEST) for f in (F.sum(F.col(f"_w{k}") * F.col("_x")).alias(f"_s{k}"), F.sum(f"_w{k}").alias(f"_n{k}"))])
    each = F.array(*[F.struct((F.col("_d") * A_DIGEST + k).alias("_b"), (F.col(f"_s{k}") / F.nullif(F.col(f"_n{k}"), F.lit(0))).alias("_m")) for k in range(A_DIGEST)])
    means = added.select(*keys, F.inline(each)).where(F.col("_b") < resamples)
    cut = means.groupBy(*keys).agg(F.percentile("_m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("_q"))
    sums = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    on = None
    for k in keys:
        same = sums[k].eqNullSafe(cut[k])
        on = same if on is None else on & same
    both = sums.join(cut, on, "left") if keys else sums.crossJoin(cut)  # one row each
    return both.select(*[sums[k] for k in keys], "n", "mean", F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"))


def spaced_strata(df: DataFrame, keys: Sequence[str], order: Sequence[str], strata: int, each: int, name: str = "stratum") -> DataFrame:
    """Of each group, each rows of each of its quantile strata by order, at even spaces; picked numbers them, the strata in turn."""
    w = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn(name, F.ntile(strata).over(w))
    by = Window.partitionBy(*keys, name)
    placed = cut.withColumns({"_k": F.row_number().over(by.orderBy(*order)) - 1, "_n": F.count("*").over(by)})
    slot = F.floor((F.col("_k") * each + F.col("_n") - 1) / F.col("_n"))
    chosen = placed.withColumn("_slot", slot).where((F.col("_k") == F.floor(F.col("_slot") * F.col("_n") / each)) & (F.col("_slot") < each))
    return chosen.withColumn("picked", F.col("_slot") * strata + F.col(name) - 1).drop("_k", "_n", "_slot")
