"""FASTA, panels, GTF, interval tables, SAM, BLAST tables, variant caches and shard manifests as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.dna import grch38_alias, normalized
from strandlake.operators.search import chunks

# Names that panels use for the same column.
ALIASES = {
    "pair_id": ("pair_id", "id", "name"),
    "primer1": ("primer1", "forward_primer", "left_primer", "forward"),
    "primer2": ("primer2", "reverse_primer", "right_primer", "reverse"),
}


def fasta(spark: SparkSession, path: str, select: Column | None = None) -> DataFrame:
    """name, description, seq of each record, upper case with IUPAC letters as N; select filters on name and description first.

    Records are split by the text reader where a line begins with the mark, so files of many records are read by many tasks,
    and a mark inside a header stays there.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim(F.regexp_replace("value", "\\s", "")) != "")
    at = F.instr(F.col("value"), "\n")
    header = F.trim(F.regexp_replace(F.when(at > 0, F.substring("value", F.lit(1), at - 1)).otherwise(F.col("value")), "\r", ""))
    body = F.when(at > 0, F.substring("value", at + 1, F.length("value"))).otherwise("")
    parts = raw.select(F.regexp_extract(header, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_extract(header, r"^\S*\s*(.*)$", 1)).alias("description"), body.alias("body"))
    if select is not None:
        parts = parts.where(select)
    return parts.select("name", "description", normalized(F.regexp_replace("body", "\\s", "")).alias("seq"))


def locus(header: Column) -> Column:
    """struct(chrom, start, end) of a header such as chr7:1000-2000; null without."""
    part = lambda k: F.regexp_extract(header, r">?\s*([\w.]+):(\d+)-(\d+)", k)
    return F.when(part(1) != "", F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")))


def primary_contigs(records: DataFrame) -> DataFrame:
    """chrom (chr1..chr22, chrX, chrY), seq; other records are left out."""
    return records.select(grch38_alias("name").alias("chrom"), "seq").where("chrom is not null")


def reference_digests(contigs: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """chrom, length, sha256 and, against a manifest (chrom, sha256), whether they agree."""
    own = contigs.select("chrom", F.length("seq").alias("length"), F.sha2("seq", 256).alias("sha256"))
    if manifest is None:
        return own
    return own.join(manifest.select("chrom", F.col("sha256").alias("stated")), "chrom", "left").withColumn("agrees", F.col("sha256") == F.col("stated")).drop("stated")


def fetched(contigs: DataFrame, regions: DataFrame, size: int = 1 << 16) -> DataFrame:
    """regions (chrom, start, end) with their bases as they are, put together from the chunks that they touch. A region of an
    unknown contig, or without bases, is left out."""
    parts = chunks(contigs, 1, size, as_is=True).select("chrom", F.col("chunk_start").alias("_chunk"), F.col("seq").alias("_seq"))
    key = ["chrom", "start", "end"]
    wanted = regions.select(*key).where("end > start").distinct().withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)))).withColumn("_chunk", (F.col("_k") * size).cast("long"))
    low = F.greatest(F.col("start") - F.col("_chunk"), F.lit(0))
    piece = F.substring("_seq", (low + 1).cast("int"), (F.least(F.col("end") - F.col("_chunk"), F.lit(size)) - low).cast("int"))
    whole = wanted.join(parts, ["chrom", "_chunk"]).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", piece.alias("piece")))), lambda x: x["piece"]), "").alias("bases"))
    return regions.join(whole, key).select(*regions.columns, "bases")


def first_record(records: DataFrame) -> DataFrame:
    """The one record of a FASTA file that holds a single target; raises ValueError for none or several."""
    found = records.limit(2).count()
    if found != 1:
        raise ValueError("exactly one record is wanted")
    return records


def target_of(spark: SparkSession, text: str, name: str = "target") -> DataFrame:
    """A target that is given as letters instead of a file: name, description, seq as fasta() gives them."""
    letters = "".join(text.split())
    if not letters:
        raise ValueError("a target needs letters")
    return spark.createDataFrame([(name, "", letters)], "name string, description string, seq string").withColumn("seq", normalized("seq"))


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel by its header: any alias of the columns, in any case; a missing pair_id is the row's content's hash."""
    raw = tsv(spark, path)
    by_name = {c.lower(): c for c in raw.columns}
    pick = lambda names: next((F.col(by_name[n]) for n in names if n in by_name), None)
    one, two = pick(ALIASES["primer1"]), pick(ALIASES["primer2"])
    if one is None or two is None:
        raise ValueError("a panel needs a column for each primer")
    name = pick(ALIASES["pair_id"])
    more = [F.try_to_number(F.col(by_name[c]), F.lit("999999999999999")).cast("long").alias(c) for c in ("left_start", "right_start", "expected_amplicon_length") if c in by_name]
    return raw.select((F.hex(F.xxhash64(one, two)) if name is None else name).alias("pair_id"), F.upper(F.trim(one)).alias("primer1"), F.upper(F.trim(two)).alias("primer2"), *more)


def bindings(spark: SparkSession, path: str) -> DataFrame:
    schema = "pair_id string, role string, primer string, chrom string, start bigint, end_exclusive bigint, strand string, mismatches int, mask_bits bigint, mask string, site_plus_strand string"
    return tsv(spark, path, schema).dropDuplicates(["primer", "chrom", "start", "strand"]).withColumnsRenamed({"end_exclusive": "end", "site_plus_strand": "site_plus"})


def _gtf(spark: SparkSession, path: str, feature: str) -> DataFrame:
    schema = "chrom string, source string, feature string, first bigint, last bigint, score string, strand string, frame string, attributes string"
    rows = spark.read.option("sep", "\t").option("comment", "#").option("quote", "\u0000").schema(schema).csv(path).where(F.col("feature") == feature)
    of = lambda key: F.regexp_extract("attributes", f'{key} "([^"]*)"', 1)
    return rows.select("chrom", (F.col("first") - 1).alias("start"), F.col("last").alias("end"), of("gene_name").alias("gene_name"), of("gene_type").alias("gene_type"), of("transcript_id").alias("transcript_id"))


def pseudogenes(spark: SparkSession, path: str) -> DataFrame:
    return _gtf(spark, path, "gene").where(F.col("gene_type").contains("pseudogene")).select("chrom", "start", "end", F.col("gene_name").alias("name"))


def exons(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    found = _gtf(spark, path, "exon").select("chrom", "start", "end", "gene_name", "transcript_id")
    return found if genes is None else found.join(genes.select("gene_name").distinct(), "gene_name", "left_semi").select(found.columns)


def segmental_duplications(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name of a UCSC table; rows without numbers are left out."""
    raw = spark.read.option("sep", "\t").csv(path)
    number = lambda k: F.col(f"_c{k}").try_cast("bigint")
    return raw.select(F.col("_c1").alias("chrom"), number(2).alias("start"), number(3).alias("end"), F.col("_c4").alias("name")).where("start is not null and end is not null")


def intervals(spark: SparkSession, path: str | None) -> DataFrame:
    schema = "chrom string, start bigint, end bigint, name string"
    return spark.createDataFrame([], schema) if path is None else tsv(spark, path, schema)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """query, chrom, start (from 0), strand, mismatches of each alignment, those of XA:Z too; unmapped rows have none."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(fields.alias("f"))
    tag = lambda name: F.get(F.filter(F.col("f"), lambda x: x.startswith(f"{name}:")), 0)
    flag = F.get("f", 1).cast("int")
    own = F.struct(F.get("f", 2).alias("chrom"), (F.get("f", 3).cast("long") - 1).alias("start"), F.when(flag.bitwiseAND(F.lit(16)) > 0, "-").otherwise("+").alias("strand"), F.substring(tag("NM"), 6, 9).cast("int").alias("mismatches"))
    other = F.filter(F.split(F.substring(tag("XA"), 6, 1 << 30), ";"), lambda x: x != "")

    def parsed(x: Column) -> Column:
        p = F.split(x, ",")
        return F.struct(F.get(p, 0).alias("chrom"), (F.abs(F.get(p, 1).cast("long")) - 1).alias("start"), F.substring(F.get(p, 1), 1, 1).alias("strand"), F.get(p, 3).cast("int").alias("mismatches"))

    mapped = rows.where(flag.bitwiseAND(F.lit(4)) == 0)
    return mapped.select(F.get("f", 0).alias("query"), F.inline(F.concat(F.array(own), F.coalesce(F.transform(other, parsed), F.array().cast("array<struct<chrom:string,start:bigint,strand:string,mismatches:int>>"))))).distinct()


def blast(spark: SparkSession, path: str) -> DataFrame:
    """query, chrom, start (from 0), end, strand, mismatches, gaps of a twelve-column table."""
    schema = "query string, chrom string, identity double, length int, mismatches int, gaps int, q_start int, q_end int, s_start bigint, s_end bigint, evalue double, bits double"
    rows = spark.read.option("sep", "\t").schema(schema).csv(path)
    return rows.select("query", "chrom", (F.least("s_start", "s_end") - 1).alias("start"), F.greatest("s_start", "s_end").alias("end"), F.when(F.col("s_start") <= F.col("s_end"), "+").otherwise("-").alias("strand"), "mismatches", "gaps", "q_start", "q_end")


def variant_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Variants, and regions (chrom, start, end) that the cache covers, of a JSON-lines file with _region marks."""
    schema = "chrom string, pos bigint, ref string, alt string, af double, ac int, an int, rsid string, source string, pop_af map<string,double>, _region string"
    rows = spark.read.schema(schema).json(path)
    part = lambda k: F.regexp_extract("_region", r"^(.+):(\d+)-(\d+)$", k)
    return rows.where("_region is null").drop("_region"), rows.where("_region is not null").select(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """Rows of a shard manifest (chromosome, file_bytes, sha256, status) with what is wrong about them; none if all is well."""
    twice = manifest.groupBy("chromosome").agg(F.count("*").alias("n"))
    fault = F.when(F.col("n") > 1, "repeated").when(F.coalesce(F.col("file_bytes"), F.lit(0)) <= 0, "empty").when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest").when(~F.coalesce(F.col("status").isin("BUILT", "EXISTING"), F.lit(False)), "status")
    return manifest.join(twice, "chromosome").withColumn("fault", fault).where("fault is not null").drop("n")
