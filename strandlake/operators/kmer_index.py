"""A k-mer index of contigs on disk, and the anchored search that reads it instead of the contigs.

The index is Parquet: one row for each strict k-mer with its place and the bases on both sides, all as numbers of two bits a base, in
folders by the k-mer's first letters, with Bloom filters. It is written in segments, each of which holds the k-mers of some chunks,
sorted; so chunks are dealt out once, and their many rows never leave the task that makes them. A search reads the folders of its
anchors, skips row groups by their ranges and filters where the anchors are few, and verifies each hit by the bases that lie beside
it: no contig is read again.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.dna import normalized, reverse_complement
from strandlake.functions.masks import WORD, base_bits, mismatches_of_packed, numbers_of, packed, strict_run, unpacked, window_of, words

from .search import BROADCAST_SEEDS, CHUNK, chunks, primers_of, verified

#: Letters of an indexed k-mer, of the bases kept on each side of it, and of the folders' names.
K, FLANK, PREFIX = 12, 24, 2
#: Anchors up to which each is looked up by itself, so that the scan's filters reach the row groups.
LOOKUPS = 128
#: Rows of a segment, which one task sorts, and bytes of a row group: what a lookup reads at least.
ROWS_A_SEGMENT, ROW_GROUP = 2_000_000, 8 << 20


@dataclass(frozen=True)
class Index:
    """Where an index lies and how it was cut. What is read of it must be asked with the same numbers."""

    path: str
    k: int = K
    flank: int = FLANK
    prefix: int = PREFIX


def _sides(index: Index) -> dict[str, list[str]]:
    return {side: [f"{side}{i}" for i in range(len(words(index.flank)))] for side in ("before", "after")}


def indexed_rows(contigs: DataFrame, index: Index, size: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """part, kmer, chrom, pos, and of either side (before, after) its bases from the k-mer outwards and how many are strict up to the
    first that isn't, of every start of a strict k-mer; beyond a contig's ends stand Ns.

    Chunks are dealt out before their starts become rows, so that one contig is the work of many tasks.
    """
    if not 0 < index.k <= WORD:
        raise ValueError(f"an indexed k-mer has {WORD} letters at most")
    pad, k, flank = "N" * index.flank, index.k, index.flank
    padded = contigs.select("chrom", F.concat(F.lit(pad), F.regexp_replace(normalized("seq"), "[^ACGT]", "N"), F.lit(pad)).alias("seq"))
    whole = 2 * flank + k
    parts = chunks(padded, whole, size, as_is=True).where(F.length("seq") >= whole)
    parts = parts.repartition(tasks) if tasks else parts.repartition("chrom", "chunk_start")
    # Letters and marks of Ns as numbers, once for a chunk, read in both directions.
    numbers = numbers_of("seq")
    last = F.least(F.col("owned"), F.length("seq") - whole + 1) - 1
    read = parts.select("chrom", "chunk_start", F.length("seq").alias("n"), last.alias("last"), F.col("seq").cast("binary").alias("data"), *[x.alias(name) for name, x in numbers.items()])
    starts = read.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("at"))
    first, behind = F.col("at") + flank, F.col("at") + flank + k
    beside = {"before": [("ahead", first - at - n, n) for at, n in words(flank)], "after": [("back", F.col("n") - behind - at - n, n) for at, n in words(flank)]}
    columns = []
    for side, names in _sides(index).items():
        columns += [strict_run([(window_of(f"{way}_n", at, n), n) for way, at, n in beside[side]]).alias(f"n_{side}")]
        columns += [window_of(way, at, n).alias(name) for name, (way, at, n) in zip(names, beside[side], strict=True)]
    part = F.substring("data", first + 1, F.lit(index.prefix)).cast("string")
    return starts.where(window_of("ahead_n", first, k) == 0).select(part.alias("part"), window_of("ahead", first, k).alias("kmer"), "chrom", (F.col("chunk_start") + F.col("at")).alias("pos"), *columns)


def write_index(contigs: DataFrame, index: Index, size: int = CHUNK) -> Index:
    """Writes the index. A segment has some ROWS_A_SEGMENT rows of any k-mers, so that a k-mer of very many places is in many files."""
    letters = contigs.agg(F.sum(F.length("seq"))).first()[0] or 0
    tasks = max(contigs.sparkSession.sparkContext.defaultParallelism, -(-letters // ROWS_A_SEGMENT))
    rows = indexed_rows(contigs, index, size, tasks).sortWithinPartitions("part", "kmer", "chrom", "pos")
    ndv = max(min(letters // tasks, 4**index.k) // 4**index.prefix, 1000)
    kept = {"parquet.bloom.filter.enabled#kmer": "true", "parquet.bloom.filter.expected.ndv#kmer": str(ndv), "parquet.block.size": str(ROW_GROUP), "compression": "zstd"}
    rows.write.partitionBy("part").options(**kept).parquet(index.path)
    return index


def _any_of(column: str, values: list[str]) -> Column:
    """column is one of values, each as a comparison of its own: a long IN reaches Parquet as one wide range only."""
    each = [F.col(column) == v for v in values]
    while len(each) > 1:
        each = [functools.reduce(Column.__or__, each[i : i + 2]) for i in range(0, len(each), 2)]
    return each[0]


def looked_up(spark: SparkSession, index: Index, seeds: DataFrame, folders: list[str]) -> DataFrame:
    """The index's rows whose k-mer is one of seeds (seed), read from as few folders and row groups as these need."""
    sides = ", ".join(f"n_{side} int, " + ", ".join(f"{name} long" for name in names) for side, names in _sides(index).items())
    rows = spark.read.schema(f"kmer long, chrom string, pos long, {sides}, part string").parquet(index.path)
    rows = rows.where(F.col("part").isin(folders))
    few = [r.seed for r in seeds.select("seed").distinct().limit(LOOKUPS + 1).collect()]
    return rows.where(_any_of("kmer", few)) if 0 < len(few) <= LOOKUPS else rows


def indexed_search(spark: SparkSession, index: Index, primers: DataFrame, anchor: int = K, most: int = 3) -> DataFrame:
    """strict_search() over an index: the same sites and columns, for anchors of the index's k at least.

    Primers of up to k + flank bases; longer ones end the job with an error, as their sites don't lie beside the k-mer. A hit is
    told by numbers first, and only sites become letters.
    """
    if anchor < index.k:
        raise ValueError(f"the index holds {index.k}-mers: the anchor can't be shorter")
    last, rest = F.right("primer", F.lit(index.k)), F.length("primer") - index.k
    # A primer's other bases from the anchor outwards are what lies before the anchor, or the complement of what lies behind it.
    out = F.left("primer", rest)
    ends = F.array(F.struct(last.alias("text"), F.lit("+").alias("strand"), out.alias("out")), F.struct(reverse_complement(last).alias("text"), F.lit("-").alias("strand"), F.translate(out, "ACGT", "TGCA").alias("out")))
    texts = primers_of(primers, anchor).select("primer", F.inline(ends))
    n, longest, folders = texts.agg(F.count("*"), F.max(F.length("primer")), F.collect_set(F.substring("text", 1, index.prefix))).first()  # 4 ** prefix at most
    if (longest or 0) > index.k + index.flank:
        raise ValueError(f"the index holds sites of {index.k + index.flank} bases, and a primer has {longest}")
    sides = _sides(index)
    asked = [f"out{i}" for i in range(len(sides["before"]))]
    numbers = [packed(F.substring(F.lpad("out", index.flank, "A"), index.flank - at - n + 1, n)) for at, n in words(index.flank)]
    seeds = texts.select("primer", "strand", packed("text").alias("seed"), *[w.alias(name) for w, name in zip(numbers, asked, strict=True)])
    plus = F.col("strand") == "+"
    beside = [F.when(plus, F.col(b)).otherwise(F.col(a)) for b, a in zip(sides["before"], sides["after"], strict=True)]
    there = F.when(plus, F.col("n_before")).otherwise(F.col("n_after"))
    differ = functools.reduce(Column.__add__, [mismatches_of_packed(F.col(p), b, F.least(rest - i * WORD, F.lit(WORD))) for i, (p, b) in enumerate(zip(asked, beside, strict=True))], F.lit(0))
    seeds = F.broadcast(seeds) if n <= BROADCAST_SEEDS else seeds.hint("merge")
    hits = looked_up(spark, index, seeds, sorted(folders)).join(seeds, F.col("kmer") == F.col("seed")).where((there >= rest) & (differ <= most))
    flank = F.right(F.concat(F.lit(""), *[unpacked(b, WORD) for b in reversed(beside)]), rest)
    site = F.when(plus, F.concat(flank, last)).otherwise(F.concat(reverse_complement(last), F.reverse(flank)))
    start = F.when(plus, F.col("pos") - rest).otherwise(F.col("pos"))
    sites = hits.select("primer", "strand", base_bits("primer").alias("bits"), "chrom", start.alias("start"), site.alias("site"))
    # A primer has one seed a strand, and a place one row: each site comes once.
    return verified(sites, most).where(F.right("primer", F.lit(anchor)) == F.right("oriented", F.lit(anchor)))
