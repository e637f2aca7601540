"""Rules: severities, first-failing-rule filters, evidence records and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES, VERDICTS = ("INFO", "WARN", "FAIL"), ("PASS", "WARN", "FAIL")
ENGINE = "strandlake-1"


def severity(fail: Column, warn: Column | None = None) -> Column:
    """FAIL, WARN or INFO, by the first condition that holds; a condition that is null doesn't hold."""
    out = F.when(fail, "FAIL")
    return (out if warn is None else out.when(warn, "WARN")).otherwise("INFO")


def outside(value: Column, low: float, high: float) -> Column:
    return (value < low) | (value > high)


def order_of(text: Column) -> Column:
    """INFO and PASS 0, WARN 1, FAIL 2; anything else null."""
    return F.when(text.isin("INFO", "PASS"), 0).when(text == "WARN", 1).when(text == "FAIL", 2)


def named(order: Column, names: Sequence[str] = SEVERITIES) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), order.cast("int") + 1)


def worst(*texts: Column, names: Sequence[str] = VERDICTS) -> Column:
    """The worst of several columns; blanks and nulls don't count, and without any it is the first name."""
    found = [order_of(t) for t in texts]
    return named(F.coalesce(F.greatest(*found) if len(found) > 1 else found[0], F.lit(0)), names)


def worst_of(text: str, names: Sequence[str] = SEVERITIES) -> Column:
    """Aggregate: the worst of a group."""
    return named(F.coalesce(F.max(order_of(F.col(text))), F.lit(0)), names)


def first_failing(rules: Sequence[tuple[str, Column, Column]]) -> Column:
    """struct(rule, value) of the first (rule, fails, value) that fails; null where none does. Later ones aren't computed."""
    out = None
    for rule, fails, value in rules:
        told = F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value"))
        out = F.when(fails, told) if out is None else out.when(fails, told)
    return out


def evidence(rule: str, target: Column, level: Column, value: dict[str, Column], threshold: dict[str, str] | None = None, note: str = "") -> Column:
    """One record; value is canonical JSON of the columns in order of their names."""
    fields = F.to_json(F.struct(*[c.alias(k) for k, c in sorted(value.items())]), {"ignoreNullFields": "false"})
    limits = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted((threshold or {}).items())])) if threshold else F.lit("{}")
    return F.struct(F.lit(rule).alias("rule"), target.cast("string").alias("target"), fields.alias("value"), limits.alias("threshold"), level.alias("severity"), F.lit(note).alias("note"))


def records(df: DataFrame, *checks: Column, listed: Column | None = None, digest: str = "", profile: str = "") -> DataFrame:
    """One row for each check of each row: rule, target, value, threshold, severity, note and the run's marks.

    listed: an array of checks, beside single ones."""
    each = [F.array(*checks)] * bool(checks) + ([] if listed is None else [listed])
    rows = df.select(F.inline(F.concat(*each)))
    return rows.select("*", F.lit(digest).alias("parameter_digest"), F.lit(ENGINE).alias("engine"), F.lit(profile).alias("profile"), F.lit(False).alias("calibrated"))


def summary(rows: DataFrame) -> DataFrame:
    """target, rule, severity: the worst of each."""
    return rows.groupBy("target", "rule").agg(worst_of("severity").alias("severity"))


def verdicts(rows: DataFrame) -> DataFrame:
    """target, verdict, n_warn, n_fail."""
    return rows.groupBy("target").agg(worst_of("severity", VERDICTS).alias("verdict"), F.count_if(F.col("severity") == "WARN").alias("n_warn"), F.count_if(F.col("severity") == "FAIL").alias("n_fail"))


def _faults() -> list[tuple[str, Column]]:
    """What a record's columns must be like: a reason, and the condition under which it rejects the record."""
    is_object = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    return [
        ("rule", ~F.coalesce(F.col("rule").rlike(r"^[A-Z]{2,4}-[0-9]{2}[a-z]?$"), F.lit(False))),
        ("target", F.coalesce(F.trim("target") == "", F.lit(True))),
        ("severity", ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))),
        ("value", ~is_object("value")),
        ("threshold", ~is_object("threshold")),
    ]


def as_variants(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose value and threshold are VARIANT columns, and the rejected ones as they came, with reason: the first of rule,
    target, severity, value and threshold that isn't as it must be. Values are asked for by path: value_of("$.tm_c", "double")."""
    reason = F.coalesce(*[F.when(fails, name) for name, fails in _faults()])
    told = rows.withColumn("reason", reason)
    parsed = {c: F.try_parse_json(c) for c in ("value", "threshold")}
    return told.where("reason is null").drop("reason").withColumns(parsed), told.where("reason is not null")


def value_of(path: str, kind: str, column: str = "value") -> Column:
    """What a VARIANT column has at a path, null where it has none or another kind."""
    return F.try_variant_get(column, path, kind)
