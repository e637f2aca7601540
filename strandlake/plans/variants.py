"""Variants under primers: overlap joins of sites with variants, and the VAR rules as aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import dna, thermo
from strandlake.operators.intervals import overlap_join, overlapping
from strandlake.operators.rules import VERDICTS, severity, worst_of


@dataclass(frozen=True)
class Limits:
    report: float = 1e-4
    warn: float = 1e-3
    common: float = 0.01
    high: float = 0.05
    three_prime: int = 5
    population_ratio: float = 5.0


def prepared(variants: DataFrame) -> DataFrame:
    """chrom (without chr), pos, ref, alt, af, pop_af with start, end (half open), is_indel, length_change, pop_max, pop_max_af."""
    top = F.array_max(F.transform(F.map_entries("pop_af"), lambda e: F.struct(e["value"].alias("af"), e["key"].alias("population"))))
    change = F.length("alt") - F.length("ref")
    return variants.select(
        dna.chromosome("chrom").alias("chrom"), "pos", "ref", "alt", "af", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.greatest(F.lit(1), F.length("ref"))).alias("end"),
        (change != 0).alias("is_indel"), change.alias("length_change"), top["population"].alias("pop_max"), F.coalesce(top["af"], F.lit(0.0)).alias("pop_max_af"),
    )


def site_hits(sites: DataFrame, variants: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Each variant on each site (site_id, chrom, start, end, strand): distance_3p, and whether it lies in the 3' window."""
    known = sites.select("site_id", dna.chromosome("chrom").alias("chrom"), "start", "end", "strand", "sequence")
    met = overlap_join(known, variants, ["chrom"], left_prefix="s_", right_prefix="")
    plus = F.col("s_strand") == "+"
    low, high = F.when(plus, F.greatest(F.col("s_start"), F.col("s_end") - limits.three_prime)).otherwise(F.col("s_start")), F.when(plus, F.col("s_end")).otherwise(F.least(F.col("s_end"), F.col("s_start") + limits.three_prime))
    return met.withColumns({"distance_3p": F.when(plus, F.col("s_end") - 1 - F.col("start")).otherwise(F.col("start") - F.col("s_start")), "in_3p": (F.col("start") < high) & (F.col("end") > low)}).withColumnRenamed("s_site_id", "site_id")


def with_energies(hits: DataFrame) -> DataFrame:
    """VAR-04: ddg, the free energy at 37 C of the site's own primer on the other allele less that on its own; null if unscored."""
    n = F.length("s_sequence")
    plus = F.col("s_strand") == "+"
    at = F.when(plus, F.col("pos") - 1 - F.col("s_start")).otherwise(n - 1 - (F.col("pos") - 1 - F.col("s_start"))).cast("int")
    turned = lambda c: F.when(plus, F.upper(c)).otherwise(F.translate(F.upper(c), "ACGT", "TGCA"))
    ref, alt = turned(F.col("ref")), turned(F.col("alt"))
    fits = (F.length("ref") == 1) & (F.length("alt") == 1) & at.between(0, n - 1) & (F.substring(F.col("s_sequence"), at + 1, F.lit(1)) == ref) & (ref != alt)
    other = F.concat(F.substring(F.col("s_sequence"), F.lit(1), at), alt, F.substring(F.col("s_sequence"), at + 2, n))
    free = lambda e: e["dh"] - 310.15 * e["ds"] / 1000.0
    return hits.withColumn("ddg", F.when(fits, free(thermo.duplex_with_mismatch(F.col("s_sequence"), other)) - free(thermo.duplex(F.col("s_sequence")))))


def site_checks(sites: DataFrame, hits: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """site_id with n_variants, the largest frequencies and severities of VAR-01, 02, 03, 06, 07; for probes VAR-05."""
    af = F.col("af")
    largest = lambda cond: F.coalesce(F.max(F.when(cond, af)), F.lit(0.0))
    special = (F.col("pop_max_af") >= limits.common) & ((af <= 0) | (F.col("pop_max_af") >= limits.population_ratio * af))
    label = F.concat_ws(":", F.col("chrom"), F.col("pos").cast("string"), F.concat_ws(">", "ref", "alt"))
    sums = hits.groupBy("site_id").agg(
        F.count("*").alias("n_variants"), F.count_if(af >= limits.report).alias("n_reported"), F.max("af").alias("max_af"), F.max_by(label, F.struct(af, -F.col("pos"))).alias("worst"),
        F.count_if("in_3p").alias("n_3p"), largest(F.col("in_3p")).alias("max_af_3p"), F.count_if(af >= limits.common).alias("n_common"),
        F.count_if("is_indel").alias("n_indels"), F.count_if(F.col("is_indel") & (af >= limits.report)).alias("n_indels_reported"), largest(F.col("is_indel") & (af >= limits.report)).alias("max_af_indel"),
        F.count_if(special).alias("n_population"),
    )
    counts = ["n_variants", "n_reported", "n_3p", "n_common", "n_indels", "n_indels_reported", "n_population"]
    whole = sites.select("site_id").distinct().join(sums, "site_id", "left").fillna(0, counts).fillna(0.0, ["max_af", "max_af_3p", "max_af_indel"])
    c = F.col
    return whole.withColumns({
        "var01": severity(F.lit(False), c("max_af") >= limits.warn),
        "var02": severity(c("max_af_3p") >= limits.common, c("max_af_3p") >= limits.report),
        "var03": severity((c("n_common") > 0) & (c("max_af") >= limits.high), c("n_common") > 0),
        "var05": severity(c("max_af") >= limits.common, c("max_af") >= limits.warn),
        "var06": severity(c("max_af_indel") >= limits.common, c("n_indels_reported") > 0),
        "var07": severity(F.lit(False), c("n_population") > 0),
    })


def amplicon_checks(amplicons: DataFrame, sites: DataFrame, variants: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """VAR-08: amplicon_id with n_inside, n_common_indels, max_length_change of variants in the product outside its sites."""
    free = overlapping(variants, sites.select(dna.chromosome("chrom").alias("chrom"), "start", "end"), ["chrom"], anti=True)
    known = amplicons.select("amplicon_id", dna.chromosome("chrom").alias("chrom"), "start", "end")
    met = overlap_join(known, free, ["chrom"], left_prefix="a_", right_prefix="").withColumnRenamed("a_amplicon_id", "amplicon_id")
    indel = F.col("is_indel") & (F.col("af") >= limits.common)
    sums = met.groupBy("amplicon_id").agg(F.count("*").alias("n_inside"), F.count_if(indel).alias("n_common_indels"), F.coalesce(F.max(F.when(indel, F.abs("length_change"))), F.lit(0)).alias("max_length_change"))
    whole = amplicons.select("amplicon_id").distinct().join(sums, "amplicon_id", "left").fillna(0)
    return whole.withColumn("var08", severity(F.lit(False), F.col("n_common_indels") > 0))


def pair_verdicts(checks: DataFrame, owners: DataFrame) -> DataFrame:
    """pair_id, verdict, n_flags of the sites that owners (site_id, pair_id) give to a pair."""
    rules = ["var01", "var02", "var03", "var06", "var07"]
    each = checks.join(owners, "site_id").select("pair_id", F.explode(F.array(*rules)).alias("severity"))
    return each.groupBy("pair_id").agg(worst_of("severity", VERDICTS).alias("verdict"), F.count_if(F.col("severity") != "INFO").alias("n_flags"))


def uncovered_regions(regions: DataFrame, cached: DataFrame) -> DataFrame:
    """Regions (chrom, start, end) that the cache doesn't hold."""
    return regions.join(cached, ["chrom", "start", "end"], "left_anti")


def parsed_gnomad(raw: Column) -> Column:
    """array of variant structs of one response's JSON: genome before exome, without a frequency none."""
    kind = "struct<data:struct<region:struct<variants:array<struct<chrom:string,pos:bigint,ref:string,alt:string,genome:struct<af:double,ac:int,an:int,populations:array<struct<id:string,ac:int,an:int>>>,exome:struct<af:double,ac:int,an:int,populations:array<struct<id:string,ac:int,an:int>>>>>>>>"

    def one(v: Column) -> Column:
        part = F.coalesce(v["genome"], v["exome"])
        share = F.transform(F.filter(part["populations"], lambda p: p["an"] > 0), lambda p: F.struct(p["id"].alias("key"), (p["ac"] / p["an"]).alias("value")))
        return F.struct(v["chrom"].alias("chrom"), v["pos"].alias("pos"), v["ref"].alias("ref"), v["alt"].alias("alt"), part["af"].alias("af"), part["ac"].alias("ac"), part["an"].alias("an"), F.map_from_entries(F.coalesce(share, F.array().cast("array<struct<key:string,value:double>>"))).alias("pop_af"))

    return F.filter(F.transform(F.from_json(raw, kind)["data"]["region"]["variants"], one), lambda v: v["af"].isNotNull())
