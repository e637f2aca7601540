"""The queries of this subpackage: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .chat import format_chats
from .common import table
from .compression import quality_rules
from .decontamination import contaminated
from .jaccard import jaccard_components
from .language_id import identified
from .licenses import license_scan
from .lines import dedup_lines
from .merkle import proofs
from .packing import pack_documents
from .quality_model import classify
from .repair import damaged_and_repaired
from .suffixes import remove_repeats
from .tokens import token_counts


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed; a row for each piece."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from the labels outside the held-out fold."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and compression verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document is left without strings of 50 bytes that stand in an earlier one."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and group of near duplicates."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names or holds."""
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_known", F.array_join("licenses", ",").alias("licenses"), "n_matches")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after, and a digest of what is left."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


#: Tools that the derived calls name; "forecast" has no schema.
SCHEMAS = {
    "search": {"type": "object", "required": ["limit", "query"], "properties": {"limit": {"type": "integer", "minimum": 0, "maximum": 11}, "query": {"type": "string", "minLength": 8}}, "additionalProperties": False},
    "total": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}},
}


def with_tool_calls(conversations: DataFrame) -> DataFrame:
    """conversations (which hold no tool calls) with calls and results by hashes, alike in SQL.

    With h the md5 of "conv_id:turn", about half the assistant's messages call a tool. Arguments break the schema, results
    come before their call, twice, never or for no call, and calls wait for earlier or later ones, each where a digit says so.
    """
    said = conversations.select("conv_id", "turn", "role", "text").distinct()
    h = F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))
    digit = lambda k: F.substring("h", k, 1)
    number = lambda k: F.conv(digit(k), 16, 10)
    marked = said.withColumn("h", h)
    calls = (F.col("role") == "assistant") & F.coalesce(digit(1) < "8", F.lit(False))
    at = lambda k: F.concat(F.lit("c"), (F.col("turn") + k).cast("string"))
    name = F.when(digit(2) < "a", "search").when(digit(2) < "e", "total").otherwise("forecast")
    search = F.concat(F.lit('{"limit":'), number(3), F.lit(',"query":"'), F.substring("h", 1, 8), F.lit('"}'))
    total = F.concat(F.lit('{"a":'), number(3), F.when(digit(4) < "c", F.concat(F.lit(',"b":'), number(4))).otherwise(""), F.lit("}"))
    waits = F.filter(F.array(F.when(digit(5) < "8", at(-2)), F.when(digit(6) >= "c", at(2))), lambda x: x.isNotNull())
    call = F.struct(at(0).alias("id"), name.alias("name"), F.when(name == "search", search).otherwise(total).alias("arguments"), waits.alias("depends_on"))
    spoken = marked.withColumn("text", F.when(calls, F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.array(call).alias("tool_calls")))).otherwise(F.col("text")))
    answer = lambda when, move, to, content: F.when(when, F.struct((F.col("turn") + move).alias("turn"), F.to_json(F.struct(F.substring("h", content, 8).alias("content"), to.alias("tool_call_id"))).alias("text")))
    answers = F.array(answer(digit(7) < "c", 0, at(0), 9), answer(digit(7).isin("c", "d"), -1, at(0), 9), answer(digit(7) == "f", 0, at(0), 9), answer(digit(7) == "f", 1, at(0), 17), answer(digit(8) == "0", 0, F.concat(F.lit("x"), F.col("turn").cast("string")), 9))
    results = marked.where(calls).select("conv_id", F.inline(F.filter(answers, lambda x: x.isNotNull()))).select("conv_id", "turn", F.lit("tool").alias("role"), "text")
    return spoken.select("conv_id", "turn", "role", "text").union(results)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with derived tool calls, linked, ordered, checked and serialised."""
    return format_chats(with_tool_calls(table(spark, sf_dir, "conversations")), SCHEMAS)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, with the similarity."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by hashes, with its faults and its cheapest repair."""
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof, and whether what is shown of it folds to the root."""
    return proofs(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, as the documents outside the held-out fold teach it."""
    return identified(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op4_suffix_array_dedup": oracles.REPEATS,
    "op5_ngram_jaccard_join": oracles.JACCARD,
    "op6_license_scans": oracles.LICENSES,
    "op8_line_dedup": oracles.LINES,
    "op9_chat_formatting": oracles.CHATS,
    "op10_benchmark_decontamination": oracles.LEAKS,
    "op11_conversation_repair": oracles.REPAIRS,
    "op12_merkle_manifest": oracles.MERKLE,
}
