"""Queries of the SQL surface: table functions, and evidence as VARIANT, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import dna, tables
from strandlake.operators import rules
from strandlake.operators.rules import evidence, severity
from strandlake.queries import _RC, CONTIGS, contigs, query

K, PART = 9, 100


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs in parts of PART bases that follow each other."""
    each = contigs(spark, sf_dir).select("chrom", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(PART))).alias("chunk_start"))
    return each.select("chrom", "chunk_start", F.substring(F.col("seq"), F.col("chunk_start") + 1, F.lit(PART)).alias("seq"))


@query(f"WITH {CONTIGS} SELECT kmer, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM (SELECT s AS pos, substr(seq, s + 1, {K}) AS kmer FROM (SELECT seq, unnest(range(0, length(seq) - {K - 1})) AS s FROM contig)) GROUP BY kmer")
def kmers_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers by the table function, over parts in order."""
    tables.register(spark)
    parts(spark, sf_dir).createOrReplaceTempView("strandlake_parts")
    found = spark.sql(f"SELECT * FROM dna_kmers(TABLE(strandlake_parts) PARTITION BY chrom ORDER BY (chunk_start), {K})")
    return found.groupBy("kmer").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query(f"""WITH {CONTIGS}, w AS (SELECT chrom, s AS start, substr(seq, s + 1, 60) AS x FROM (SELECT chrom, seq, unnest(range(0, 256, 40)) AS s FROM contig)),
k AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start) AS r, sum(CASE WHEN length(x) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start) AS short FROM w)
SELECT chrom, CAST(start AS BIGINT) AS start, CAST(start + length(x) AS BIGINT) AS "end", CAST(length(replace(replace(x, 'A', ''), 'T', '')) AS INTEGER) AS n_gc FROM k WHERE short <= 1""")
def windows_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 60 bases, 40 apart, by the table function, over parts in order."""
    tables.register(spark)
    parts(spark, sf_dir).createOrReplaceTempView("strandlake_parts")
    found = spark.sql("SELECT * FROM dna_windows(TABLE(strandlake_parts) PARTITION BY chrom ORDER BY (chunk_start), 60, 40)")
    return found.select("chrom", "start", "end", "n_gc")


#: Both 20-mers of a contig; what a hash of the contig's number breaks is a record that no reader may take.
@query(f"""WITH {CONTIGS}, p AS (SELECT doc_id, unnest([chrom || '_F', chrom || '_R']) AS target, unnest([substr(seq, 12, 20), {_RC('substr(seq, 169, 20)')}]) AS s FROM contig),
v AS (SELECT *, length(replace(replace(s, 'A', ''), 'T', '')) AS gc, CASE doc_id % 11 WHEN 3 THEN 'rule' WHEN 5 THEN 'severity' WHEN 7 THEN 'value' END AS reason FROM p)
SELECT target, reason, CASE WHEN reason IS NULL THEN round(gc / 20.0, 4) END AS gc, CASE WHEN reason IS NULL THEN right(s, 1) END AS base, CASE WHEN reason IS NULL THEN gc / 20.0 NOT BETWEEN 0.4 AND 0.6 END AS beyond FROM v""")
def evidence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence records as VARIANT, their values by path, and what a schema check rejects."""
    c = contigs(spark, sf_dir)
    ends = F.array(F.struct(F.concat("chrom", F.lit("_F")).alias("target"), F.substring("seq", 12, 20).alias("s")), F.struct(F.concat("chrom", F.lit("_R")).alias("target"), dna.reverse_complement(F.substring("seq", 169, 20)).alias("s")))
    gc = dna.gc_fraction("s")
    told = evidence("CMP-01", F.col("target"), severity(gc.between(0.4, 0.6) == F.lit(False)), {"gc": F.round(gc, 4), "last": F.struct(F.right("s", F.lit(1)).alias("base"))}, {"fail": "0.40-0.60"})
    lot = F.col("doc_id") % 11
    raw = rules.records(c.select("doc_id", F.inline(ends)).select("doc_id", "s", "target", told.alias("r")).select("doc_id", F.struct(
        F.when(lot == 3, "cmp1").otherwise(F.col("r.rule")).alias("rule"), F.col("r.target").alias("target"), F.when(lot == 7, F.substring("r.value", 1, 5)).otherwise(F.col("r.value")).alias("value"),
        F.col("r.threshold").alias("threshold"), F.when(lot == 5, "BAD").otherwise(F.col("r.severity")).alias("severity"), F.col("r.note").alias("note")).alias("r")), F.col("r"))
    good, bad = rules.as_variants(raw)
    own = good.select("target", F.lit(None).cast("string").alias("reason"), rules.value_of("$.gc", "double").alias("gc"), rules.value_of("$.last.base", "string").alias("base"), (F.col("severity") == "FAIL").alias("beyond"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("gc", "double"), ("base", "string"), ("beyond", "boolean"))]
    return own.union(bad.select("target", "reason", *none))
