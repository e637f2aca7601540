"""Sinks: tab-separated tables, JSON lines of evidence, contracts, and a small HTML report. operators.kmer_index writes indexes."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str) -> None:
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("sep", "\t").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line, its keys sorted."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def contract(values: DataFrame) -> DataFrame:
    """A wide row as field, value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in values.columns])
    return values.select(F.inline(pairs))


def html_report(df: DataFrame, title: str, rows: int = 500) -> str:
    """A page of the first rows: a report is for reading, and holds so many rows at most."""
    cell = lambda x: f"<td>{html.escape('' if x is None else str(x))}</td>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in df.limit(rows).collect())
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
