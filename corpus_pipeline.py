"""Raw documents to packed training sequences in five stages of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import forget, written
from strandlake.llm.compression import kept_documents
from strandlake.llm.decontamination import clean_documents
from strandlake.llm.jaccard import one_of_each
from strandlake.llm.lines import dedup_lines
from strandlake.llm.packing import pack_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def passing_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs.select(COLUMNS))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one; n_chars follows."""
    return dedup_lines(docs).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return one_of_each(docs).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, and their places in the training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", passing_quality_rules),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]
#: None: compression ratios and tokenizers are beyond SQL. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each over the written result of the one before, which is deleted then; the last one's
    input stays, as the result is read from it.

    Nulls, empty tables and repeated rows pass through as each stage's operator says; a row without doc_id is never removed as
    another's copy. Columns of documents beyond COLUMNS are left out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k + 1}")
            if last is not None:
                forget(last)
            last = docs
    return docs
