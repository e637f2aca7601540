"""Comparison of a predicted set with a true one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.when(a == b, 1.0).otherwise(0.0))


def compare(truth: DataFrame, predicted: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n_truth, n_predicted, n_both, precision, recall, f1, jaccard, for each group of by (part of the key) or in all.

    Rows are sets: repeats count once. An empty side makes a ratio 1 where both are empty, else 0.
    """
    t = truth.select(*key).distinct().withColumn("_t", F.lit(1))
    p = predicted.select(*key).distinct().withColumn("_p", F.lit(1))
    on = None
    for k in key:
        e = F.col(f"t.{k}").eqNullSafe(F.col(f"p.{k}"))
        on = e if on is None else on & e
    both = t.alias("t").join(p.alias("p"), on, "full_outer").select(*[F.coalesce(f"t.{k}", f"p.{k}").alias(k) for k in by], "_t", "_p")
    sums = both.groupBy(*by).agg(F.count("_t").alias("n_truth"), F.count("_p").alias("n_predicted"), F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("n_both"))
    a, b, c = F.col("n_truth"), F.col("n_predicted"), F.col("n_both")
    return sums.withColumns({"precision": _ratio(c, b), "recall": _ratio(c, a), "f1": _ratio(2 * c, a + b), "jaccard": _ratio(c, a + b - c)})


def macro(metrics: DataFrame) -> DataFrame:
    """The mean over groups."""
    return metrics.agg(F.count("*").alias("n_groups"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "jaccard")])


def differences(truth: DataFrame, predicted: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, side: rows that only one of the sets has."""
    t, p = truth.select(*key).distinct(), predicted.select(*key).distinct()
    return t.exceptAll(p).withColumn("side", F.lit("truth")).union(p.exceptAll(t).withColumn("side", F.lit("predicted")))


def tolerant_comparison(ours: DataFrame, other: DataFrame, key: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """key, ours, other, status: MATCH, DIFF, MISSING_OURS or MISSING_OTHER."""
    a, b = ours.select(*key, F.col(value).alias("ours")), other.select(*key, F.col(value).alias("other"))
    status = F.when(F.col("ours").isNull(), "MISSING_OURS").when(F.col("other").isNull(), "MISSING_OTHER").when(F.abs(F.col("ours") - F.col("other")) <= tolerance, "MATCH").otherwise("DIFF")
    return a.join(b, list(key), "full_outer").withColumn("status", status)


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], position: str, equal: Sequence[str]) -> DataFrame:
    """Rows of two tables that stand at one place of their group (keys, position), which have to agree in the columns equal.

    A row without a partner, or with one that differs, ends the job with an error: the tables are not of one run. Columns of
    right but the keys and the position come as r_*.
    """
    on = [*keys, position]
    named = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on], F.lit(True).alias("_r"))
    both = left.withColumn("_l", F.lit(True)).join(named, on, "full_outer")
    same = F.col("_l") & F.col("_r")
    for c in equal:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    checked = F.when(F.coalesce(same, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("tables differ at "), F.to_json(F.struct(*on)))).cast("boolean"))
    return both.where(checked).drop("_l", "_r")
