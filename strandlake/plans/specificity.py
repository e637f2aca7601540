"""Specificity of panels: sites and products of each pair, what the pair intends, and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import masks, thermo
from strandlake.operators.intervals import overlap_join, overlapping
from strandlake.operators.ranking import top_k
from strandlake.operators.rules import severity, worst
from strandlake.operators.tables import settled
from strandlake.operators.products import pair_products


def primer_sites(panel: DataFrame, bindings: DataFrame) -> DataFrame:
    """pair_id, role, primer with n_sites, n_exact, n_anchored, n_tolerant, n_disruptive, histogram and severities of SPC-01, 02, 05."""
    roles = panel.select("pair_id", F.inline(F.array(F.struct(F.lit("F").alias("role"), F.col("primer1").alias("primer")), F.struct(F.lit("R").alias("role"), F.col("primer2").alias("primer")))))
    sites = bindings.withColumns({"anchored": masks.anchor_intact("mask"), "tolerant": masks.tolerant_terminal("primer", "oriented"), "disruptive": masks.disruptive_terminal("primer", "oriented")})
    per_count = sites.groupBy("primer", "mismatches").agg(F.count("*").alias("n"), F.count_if("anchored").alias("n_anchored"), F.count_if(F.col("tolerant") > 0).alias("n_tolerant"), F.count_if(F.col("disruptive") > 0).alias("n_disruptive"))
    per_primer = per_count.groupBy("primer").agg(
        F.sum("n").alias("n_sites"), F.sum(F.when(F.col("mismatches") == 0, F.col("n")).otherwise(0)).alias("n_exact"), F.sum(F.when(F.col("mismatches") > 0, F.col("n_anchored")).otherwise(0)).alias("n_anchored_mismatched"),
        F.sum("n_tolerant").alias("n_tolerant"), F.sum("n_disruptive").alias("n_disruptive"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "mismatches", "n"))), ",").alias("histogram"),
    )
    whole = roles.join(per_primer, "primer", "left").fillna(0, ["n_sites", "n_exact", "n_anchored_mismatched", "n_tolerant", "n_disruptive"]).fillna("", ["histogram"])
    n = F.col("n_exact")
    return whole.withColumns({"spc01": severity(n > 1, n == 0), "spc02": severity(F.lit(False), (F.col("n_anchored_mismatched") > 0) | (n > 1)), "spc05": severity(F.lit(False), F.col("n_tolerant") > 0)})


def strongest_sites(bindings: DataFrame, cond: thermo.Conditions = thermo.Conditions()) -> DataFrame:
    """SPC-04: primer with n_scored, n_unscored and why (a map of reasons), theta and place of its strongest site with exactly
    one inner mismatch."""
    single = bindings.where("mismatches = 1").withColumn("m", thermo.melting("primer", cond, energies=thermo.duplex_with_mismatch("primer", "oriented")))
    scored = single.withColumn("theta", thermo.bound_fraction(F.col("m"), cond.anneal_c))
    at = F.length(F.conv(F.col("mask_bits").cast("string"), 10, 2)) - 1
    end = (at < 2) | (at >= F.length("primer") - 2)
    reason = F.when(F.col("theta").isNotNull(), None).when(end, "near an end").otherwise("no parameters")
    best = F.max_by(F.struct("chrom", "start", "strand"), F.struct("theta", F.xxhash64("chrom", "start", "strand")))
    counted = lambda name: F.count_if(F.col("reason") == name)
    reasons = F.create_map(F.lit("near an end"), counted("near an end"), F.lit("no parameters"), counted("no parameters"))
    return scored.withColumn("reason", reason).groupBy("primer").agg(F.count("theta").alias("n_scored"), F.count_if(F.col("theta").isNull()).alias("n_unscored"), reasons.alias("unscored"), F.max("theta").alias("theta"), best.alias("site"))


def annotated(bindings: DataFrame, annotations: DataFrame) -> DataFrame:
    """SPC-06, SPC-07: primer with n_overlapping sites on the annotated intervals (chrom, start, end)."""
    hit = overlapping(bindings.select("chrom", "start", "end", "primer", "strand"), annotations.select("chrom", "start", "end"), ["chrom"])
    return hit.groupBy("primer").agg(F.count("*").alias("n_overlapping"))


def annotation_names(bindings: DataFrame, annotations: DataFrame, shown: int = 10) -> DataFrame:
    """primer with n_names, how many names of intervals (chrom, start, end, name) its sites lie on, and the first of these."""
    met = overlap_join(bindings.select("chrom", "start", "end", "primer"), annotations.select("chrom", "start", "end", "name"), ["chrom"], left_prefix="", right_prefix="a_")
    names = met.select("primer", F.col("a_name").alias("name")).where("name is not null").distinct()
    first = top_k(names, ["primer"], ["name"], shown).groupBy("primer").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return names.groupBy("primer").agg(F.count("*").alias("n_names")).join(first, "primer")


def shown_sites(bindings: DataFrame, shown: int = 40, anchor: int = 12) -> DataFrame:
    """The first sites of each primer for a reader: few mismatches first, anchored ones before others, then by place."""
    marked = bindings.withColumn("anchored", masks.anchor_intact("mask", anchor))
    return top_k(marked, ["primer"], ["mismatches", F.desc("anchored"), "chrom", "start", "strand"], shown)


def panel_summary(panel: DataFrame, products: DataFrame, match_chrom: bool = True) -> DataFrame:
    """Each pair's products: n_products, n_intended, n_off, n_off_exact, least_off_mismatches, and its verdict.

    The intended product starts at left_start with expected_length, and on expected_chrom unless match_chrom is false. A pair
    fails if it has not exactly one, or an exact product elsewhere; another product elsewhere warns.
    """
    expected = panel.select("pair_id", "left_start", "expected_length", *(["expected_chrom"] if match_chrom else []))
    met = products.join(expected, "pair_id").withColumn("intended", (F.col("start") == F.col("left_start")) & (F.col("length") == F.col("expected_length")) & ((F.col("chrom") == F.col("expected_chrom")) if match_chrom else F.lit(True)))
    sums = met.groupBy("pair_id").agg(
        F.count("*").alias("n_products"), F.count_if("intended").alias("n_intended"), F.count_if(~F.col("intended")).alias("n_off"),
        F.count_if(~F.col("intended") & (F.col("mismatches") == 0)).alias("n_off_exact"), F.min(F.when(~F.col("intended"), F.col("mismatches"))).alias("least_off_mismatches"),
    )
    whole = panel.select("pair_id").distinct().join(sums, "pair_id", "left").fillna(0, ["n_products", "n_intended", "n_off", "n_off_exact"])
    fails = (F.col("n_intended") != 1) | (F.col("n_off_exact") > 0)
    return whole.withColumn("verdict", F.when(fails, "FAIL").when(F.col("n_off") > 0, "WARN").otherwise("PASS"))


def panel_qc(panel: DataFrame, bindings: DataFrame, low: int = 50, high: int = 3000, match_chrom: bool = True) -> dict[str, DataFrame]:
    products = pair_products(panel, bindings, low, high)
    return {"sites": primer_sites(panel, bindings), "products": products, "pairs": panel_summary(panel, products, match_chrom)}


def rerank(pairs: DataFrame, variant_verdicts: DataFrame | None = None, order: list[str] = ("score",)) -> DataFrame:
    """pairs (pair_id, verdict, n_off, ...) with final_verdict and final_rank: verdict, off-targets, variant flags, then order."""
    whole = pairs
    if variant_verdicts is not None:
        whole = whole.join(variant_verdicts.select("pair_id", F.col("verdict").alias("variant_verdict"), "n_flags"), "pair_id", "left").fillna(0, ["n_flags"])
    else:
        whole = whole.withColumns({"variant_verdict": F.lit(""), "n_flags": F.lit(0).cast("long")})
    whole = whole.withColumn("final_verdict", worst(F.col("verdict"), F.col("variant_verdict")))
    level = F.when(F.col("final_verdict") == "PASS", 0).when(F.col("final_verdict") == "WARN", 1).otherwise(2)
    # One list over all pairs is what is asked for; it is sorted by range, and numbered through offsets of its parts.
    keyed = whole.withColumn("_level", level)
    columns = ["_level", "n_off", "n_flags", *order, "pair_id"]
    parts = keyed.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id())
    # A checkpoint keeps the deal by range the same for both of its uses.
    local = settled(parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*columns))))
    sizes = local.groupBy("_part").agg(F.max("_n").alias("_size"))
    offsets = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_before"])
    return local.join(F.broadcast(offsets.select("_part", "_before")), "_part").withColumn("final_rank", F.col("_before") + F.col("_n")).drop("_part", "_n", "_before", "_level")
