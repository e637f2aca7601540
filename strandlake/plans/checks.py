"""Rules as evidence: what is said of a primer, a pair, a probe, a product or a transcript."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions import dna, masks, melting, thermo
from strandlake.functions.structures import all_on_distinct, dimer_udf, fold_udf, hairpin_udf, unpaired_udf
from strandlake.functions.parameters import all_steps
from strandlake.operators.intervals import containment_join, merge_intervals
from strandlake.operators.ranking import top_k
from strandlake.operators.rules import evidence, outside, severity
from strandlake.operators.tables import settled

# Genes of clonal haematopoiesis (Jaiswal 2014, Razavi 2019).
CHIP_GENES = ("DNMT3A", "TET2", "ASXL1", "JAK2", "TP53", "PPM1D", "SF3B1", "SRSF2", "GNB1", "CBL", "GNAS", "IDH1", "IDH2", "KRAS", "NRAS", "CREBBP", "ATM", "CHEK2", "SETD2", "STAG2", "BCOR")


def parsed_oligo(raw: Column) -> Column:
    """struct(dna, n_lna, lna, tags, warnings) of a modified oligo: +N is an LNA base (lna: its places from 0), /name/ a tag at
    an end. Warned of: a + without a base behind it, a / without a partner, letters that are no bases."""
    tags = F.regexp_extract_all(raw, F.lit("/([^/]+)/"), F.lit(1))
    bare = F.upper(F.regexp_replace(F.regexp_replace(raw, "/[^/]+/", ""), "\\s", ""))
    plain = F.regexp_replace(bare, "[+/]", "")
    parts = F.split(bare, "\\+")
    lna = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("i"), F.length(F.array_join(F.slice(parts, 1, i), "")).alias("at"))), lambda x: (x["i"] < F.size(parts)) & F.get(parts, x["i"]).rlike("^[ACGT]"))
    warnings = F.filter(F.array(F.when(bare.rlike("\\+([^ACGT]|$)"), "dangling +"), F.when(bare.contains("/"), "unpaired /"), F.when(plain.rlike("[^ACGT]"), "other letters")), lambda x: x.isNotNull())
    return F.struct(plain.alias("dna"), F.regexp_count(bare, F.lit("\\+[ACGT]")).alias("n_lna"), F.transform(lna, lambda x: x["at"]).alias("lna"), tags.alias("tags"), warnings.alias("warnings"))


def _over(values: dict[str, Column], checks) -> Column:
    """The array of checks(fields) where each of the values is computed once, however many checks look at it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), checks), 0)


def primer_checks(seq: str, target: str, cond: thermo.Conditions = thermo.Conditions(), tm: tuple[float, float] = (58.0, 62.0)) -> Column:
    """SEQ-01..03, CMP-05..08 and TH-01..05 of a primer, as an array: expressions only. A degenerate or invalid primer fails or
    is INFO without values."""
    s, t = F.col(seq), F.col(target)
    half, last5 = F.floor(F.length(s) / 2).cast("int"), F.right(s, F.lit(5))
    free = lambda e: e["dh"] - 310.15 * e["ds"] / 1000.0
    values = lambda e: {
        "n": F.length(s), "strict": dna.is_strict(s), "kinds": dna.degeneracy(s), "ending": dna.degenerate_three_prime(s), "h1": dna.shannon_entropy(s, 1), "h2": dna.shannon_entropy(s, 2), "g4": dna.has_g_quadruplex(s),
        "d5": free(thermo.duplex(F.substring(s, F.lit(1), half))), "d3": free(thermo.duplex(F.right(s, half))), "m": thermo.melting(s, cond, energies=e), "spread": thermo.salt_spread(s, cond, e),
        "tail": thermo.stack_free_energy(last5),
    }

    def checks(v: Column) -> Column:
        bound = {"theta": thermo.bound_fraction(v["m"], cond.anneal_c), "half": thermo.bound_fraction(v["m"], v["m"]["tm_c"])}
        return _over(bound, lambda b: told(v, b["theta"], b["half"]))

    def told(v: Column, theta: Column, half_bound: Column) -> Column:
        n, kinds, h1, m, tail, spread = v["n"], v["kinds"], v["h1"], v["m"], v["tail"], v["spread"]
        no = F.lit(False)
        return F.array(
            evidence("SEQ-01", t, severity(~v["strict"]), {"strict": v["strict"]}),
            evidence("SEQ-02", t, severity(outside(n, 15, 35), outside(n, 18, 30)), {"length": n}, {"warn": "18-30", "fail": "15-35"}),
            evidence("SEQ-03", t, severity((kinds > 256) | v["ending"], kinds > 32), {"degeneracy": kinds, "three_prime": v["ending"]}, {"warn": "> 32", "fail": "> 256 or in the last 3"}),
            evidence("CMP-05", t, severity(h1 < 1.2, h1 < 1.5), {"k1": F.round(h1, 4), "k2": F.round(v["h2"], 4)}, {"warn": "k1 < 1.5", "fail": "k1 < 1.2"}),
            evidence("CMP-06", t, severity(v["g4"]), {"g_quadruplex": v["g4"]}),
            evidence("CMP-07", t, severity(no, v["d3"] < v["d5"] - 2.0), {"dg5": F.round(v["d5"], 3), "dg3": F.round(v["d3"], 3)}, {"warn": "3' half 2 kcal/mol below"}),
            evidence("CMP-08", t, severity(no, s.endswith("T")), {"base": F.right(s, F.lit(1))}),
            evidence("TH-01", t, severity(outside(m["tm_c"], tm[0] - 3, tm[1] + 3), outside(m["tm_c"], *tm)), {"tm_c": F.round(m["tm_c"], 3)}),
            evidence("TH-02", t, severity(spread > 4, spread > 2), {"spread_c": F.round(spread, 3)}),
            evidence("TH-03", t, severity(theta < 0.80, theta < 0.95), {"theta": F.round(theta, 6)}),
            evidence("TH-04", t, severity(tail < -11, outside(tail, -9, -6)), {"dg_last5": F.round(tail, 3)}),
            evidence("TH-05", t, severity(F.abs(half_bound - 0.5) > 1e-9), {"theta_at_tm": F.round(half_bound, 6)}),
        )

    return _over({"e": thermo.duplex(s)}, lambda x: _over(values(x["e"]), checks))


#: Dimers of a primer with itself.
_SELF = {"self_any": lambda s: dimer_udf(False)(s, s), "self_three": lambda s: dimer_udf(True)(s, s)}


def with_structures(primers: DataFrame, seq: str = "primer") -> DataFrame:
    """primers with self dimers, hairpin, fold and unpaired probabilities, once for each distinct sequence."""
    return all_on_distinct(primers, [seq], _SELF | {"hairpin": lambda s: hairpin_udf()(s), "fold": lambda s: fold_udf()(s), "unpaired": lambda s: unpaired_udf()(s)})


def self_checks(primers: DataFrame, target: str, seq: str = "primer") -> tuple[DataFrame, list[Column]]:
    """primers with their self dimers, and DIM-01, DIM-02 over them."""
    return all_on_distinct(primers, [seq], _SELF), _self_evidence(F.col(target))


def _self_evidence(t: Column) -> list[Column]:
    any_dg, three = F.when(F.col("self_any.found"), F.col("self_any.dg")), F.when(F.col("self_three.found"), F.col("self_three.dg"))
    return [evidence("DIM-01", t, severity(any_dg < -9, any_dg < -6), {"dg": F.round(any_dg, 3)}), evidence("DIM-02", t, severity(three < -7, three < -5), {"dg": F.round(three, 3)})]


def structure_checks(target: str) -> list[Column]:
    """DIM-01, DIM-02, SS-01, SS-02, SS-03 over with_structures()."""
    t = F.col(target)
    stem = F.when(F.col("hairpin.found"), F.col("hairpin.dg"))
    n = F.size("unpaired")
    tail = F.aggregate(F.slice("unpaired", n - 4, 5), F.lit(0.0), lambda a, x: a + x) / 5
    return [
        *_self_evidence(t),
        evidence("SS-01", t, F.lit("INFO"), {"mfe": F.round("fold.mfe", 3), "structure": F.col("fold.structure")}),
        evidence("SS-02", t, severity(F.lit(False), F.col("hairpin.extendable") & (stem < -2)), {"dg": F.round(stem, 3), "extendable": F.col("hairpin.extendable")}),
        evidence("SS-03", t, F.lit("INFO"), {"unpaired_3p": F.when(n >= 5, F.round(tail, 4))}),
    ]


def pair_checks(target: str, product: tuple[int, int] = (60, 200), cond: thermo.Conditions = thermo.Conditions(), ctdna: bool = False) -> Column:
    """PAIR-01..04, AMP-01, AMP-03, TH-07, and with ctdna CT-01, CT-02, of (primer1, primer2, amplicon), as an array."""
    t, a = F.col(target), F.col("amplicon")
    tm = lambda c: thermo.melting(c, cond)["tm_c"]
    values = {"n": F.length(a), "f": tm("primer1"), "r": tm("primer2"), "p": tm("amplicon"), "gc": dna.gc_fraction(a), "window": dna.gc_window_max(a, 50), "h": dna.shannon_entropy(a, 1), "g4": dna.has_g_quadruplex(a)}
    edge, no = 0.1 * (product[1] - product[0]), F.lit(False)

    def checks(v: Column) -> Column:
        n, f, r, p = v["n"], v["f"], v["r"], v["p"]
        delta, gap, inner, best = F.abs(f - r), p - F.greatest(f, r), n - F.length("primer1") - F.length("primer2"), thermo.rychlik_anneal(F.least(f, r), p)
        out = [
            evidence("PAIR-01", t, severity(delta > 5, delta > 2), {"delta_tm": F.round(delta, 3)}),
            evidence("PAIR-02", t, severity(outside(n, *product), outside(n, product[0] + edge, product[1] - edge)), {"length": n}),
            evidence("PAIR-03", t, severity(inner < 0, inner < 10), {"gap": inner}),
            evidence("PAIR-04", t, severity(no, gap > 30), {"gap_c": F.round(gap, 3)}),
            evidence("AMP-01", t, severity(v["window"] > 0.85, outside(v["gc"], 0.35, 0.65) | (v["window"] > 0.75)), {"gc": F.round(v["gc"], 4), "window": F.round(v["window"], 4)}),
            evidence("AMP-03", t, severity(no, (v["h"] < 1.5) | v["g4"]), {"k1": F.round(v["h"], 4), "g_quadruplex": v["g4"]}),
            evidence("TH-07", t, severity(no, F.abs(best - cond.anneal_c) > 5), {"anneal_c": F.round(best, 3)}),
        ]
        if ctdna:
            out += [evidence("CT-01", t, severity(n > 100), {"length": n}), evidence("CT-02", t, F.lit("INFO"), {"intact": F.round(thermo.intact_fragment_probability(n), 6)})]
        return F.array(*out)

    return _over(values, checks)


def hetero_checks(pairs: DataFrame, target: str) -> tuple[DataFrame, list[Column]]:
    """pairs with the dimers of primer1 and primer2, and DIM-03, DIM-04 over them."""
    out = all_on_distinct(pairs, ["primer1", "primer2"], {"pair_any": lambda a, b: dimer_udf(False)(a, b), "pair_three": lambda a, b: dimer_udf(True)(a, b)})
    any_dg, three = F.when(F.col("pair_any.found"), F.col("pair_any.dg")), F.when(F.col("pair_three.found"), F.col("pair_three.dg"))
    return out, [evidence("DIM-03", F.col(target), severity(any_dg < -9, any_dg < -6), {"dg": F.round(any_dg, 3)}), evidence("DIM-04", F.col(target), severity(three < -7, three < -5), {"dg": F.round(three, 3)})]


def template_checks(target: str) -> list[Column]:
    """SEQ-04, SEQ-05 of (primer1, primer2, start, end, raw): raw is the reference as it is, with N and soft masks."""
    t = F.col(target)
    piece = lambda at, n: F.substring(F.col("raw"), (at + 1).cast("int"), n.cast("int"))
    n1, n2 = F.length("primer1"), F.length("primer2")
    whole, left, right = piece(F.col("start"), F.col("end") - F.col("start")), piece(F.col("start"), n1), piece(F.col("end") - n2, n2)
    unknown, soft = lambda x: dna.count_of(x, "[Nn]"), lambda x: dna.count_of(x, "[acgt]")
    under = unknown(left) + unknown(right)
    ok1, ok2 = F.upper(left) == F.upper("primer1"), dna.reverse_complement(F.upper(right)) == F.upper("primer2")
    return [
        evidence("SEQ-04", t, severity(under > 0, (unknown(whole) > 0) | (soft(whole) > 0)), {"unknown": unknown(whole), "soft": soft(whole), "under_primers": under}),
        evidence("SEQ-05", t, severity(~(ok1 & ok2)), {"forward": ok1, "reverse": ok2}),
        evidence("SEQ-06", t, severity(F.lit(False), F.col("raw").isNull()), {"sha256": F.sha2(F.col("raw"), 256)}),
    ]


def bisulfite_checks(target: str, primer: str = "primer", footprint: str = "footprint", msp: bool = False) -> list[Column]:
    """BIS-01..03."""
    s, o, t = F.col(primer), F.col(footprint), F.col(target)
    n, near, c, h = dna.cpg_count(s), dna.nearest_cpg_to_three_prime(s), dna.non_cpg_c(F.upper(o)), dna.shannon_entropy(s, 1)
    return [
        evidence("BIS-01", t, F.lit("INFO") if msp else severity(near < 5, n > 0), {"cpg": n, "nearest": near}),
        evidence("BIS-02", t, severity(F.lit(False), c < 2), {"non_cpg_c": c}),
        evidence("BIS-03", t, severity(h < 0.9, h < 1.2), {"k1": F.round(h, 4)}),
    ]


def strand_products(ct: DataFrame, ga: DataFrame, intended: str = "CT") -> DataFrame:
    """BIS-04: pair_id, n_ct, n_ga and severity: any product on the other conversion fails, more than one on its own warns."""
    count = lambda df, name: df.groupBy("pair_id").agg(F.count("*").alias(name))
    both = count(ct, "n_ct").join(count(ga, "n_ga"), "pair_id", "full_outer").fillna(0)
    own, other = ("n_ct", "n_ga") if intended == "CT" else ("n_ga", "n_ct")
    return both.withColumn("bis04", severity(F.col(other) > 0, F.col(own) > 1))


def probe_checks(probes: DataFrame, target: str, cond: thermo.Conditions = thermo.Conditions()) -> tuple[DataFrame, list[Column]]:
    """probes (probe, primer1, primer2, amplicon) with dimers, and PRB-01..05, DIM-05 over them."""
    out = probes
    for name, other in (("self", "probe"), ("fwd", "primer1"), ("rev", "primer2")):
        columns = ["probe"] if other == "probe" else ["probe", other]
        out = all_on_distinct(out, columns, {f"d_{name}_{tag}": lambda *c, e=end: dimer_udf(e)(c[0], c[-1]) for tag, end in (("any", False), ("three", True))})
    t, p, a = F.col(target), F.col("probe"), F.col("amplicon")
    tm = lambda c: thermo.melting(c, cond)["tm_c"]
    delta = tm("probe") - F.greatest(tm("primer1"), tm("primer2"))
    g, c = dna.count_of(p, "G"), dna.count_of(p, "C")
    plus, minus = F.call_function("instr", a, p), F.call_function("instr", a, dna.reverse_complement(p))
    at = F.when(plus > 0, plus - 1).when(minus > 0, minus - 1)
    over = F.greatest(F.lit(0), F.length("primer1") - at) + F.greatest(F.lit(0), at + F.length(p) - (F.length(a) - F.length("primer2")))
    dg = lambda name: F.when(F.col(f"d_{name}.found"), F.col(f"d_{name}.dg"))
    low = lambda *names: F.least(*[dg(n) for n in names])
    any_dg, three = low("self_any", "fwd_any", "rev_any"), low("self_three", "fwd_three", "rev_three")
    return out, [
        evidence("PRB-01", t, severity(outside(delta, 3, 13), outside(delta, 6, 10)), {"delta_tm": F.round(delta, 3)}),
        evidence("PRB-02", t, severity(p.startswith("G")), {"base": F.substring(p, 1, 1)}),
        evidence("PRB-03", t, severity(F.lit(False), c <= g), {"g": g, "c": c}),
        evidence("PRB-04", t, severity(at.isNull() | (over > 0)), {"start": at, "overlap": over}),
        evidence("PRB-05", t, severity((any_dg < -9) | (three < -7), (any_dg < -6) | (three < -5)), {"any": F.round(any_dg, 3), "three": F.round(three, 3)}),
        evidence("DIM-05", t, severity((low("fwd_any", "rev_any") < -9) | (low("fwd_three", "rev_three") < -7), (low("fwd_any", "rev_any") < -6) | (low("fwd_three", "rev_three") < -5)), {"any": F.round(low("fwd_any", "rev_any"), 3), "three": F.round(low("fwd_three", "rev_three"), 3)}),
    ]


def probe_windows(amplicons: DataFrame, length: tuple[int, int] = (18, 30), gc: tuple[float, float] = (0.30, 0.80), run: int = 4, per_amplicon: int = 120, cond: thermo.Conditions = thermo.Conditions()) -> DataFrame:
    """Probes of each amplicon (amplicon_id, amplicon, primer1, primer2) between its primers that pass PRB-02, PRB-03 and the composition.

    The per_amplicon ones whose Tm lies next to 8 degrees above the primers' come with their score.
    """
    n = F.length("amplicon")
    at = lambda size: F.transform(F.sequence(F.length("primer1"), n - F.length("primer2") - size), lambda i: F.struct(i.alias("start"), (i + size).alias("end"), F.substring(F.col("amplicon"), i + 1, size).alias("plus")))
    each = F.flatten(F.array(*[F.when(n - F.length("primer2") - k >= F.length("primer1"), at(F.lit(k))).otherwise(F.array()) for k in range(length[0], length[1] + 1)]))
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("plus").alias("probe")), F.struct(F.lit("-").alias("strand"), dna.reverse_complement("plus").alias("probe")))
    cut = amplicons.select("amplicon_id", "primer1", "primer2", F.inline(each)).select("amplicon_id", "primer1", "primer2", "start", "end", F.inline(both)).where(dna.is_strict("probe"))
    p = F.col("probe")
    kept = cut.where(dna.gc_fraction(p).between(*gc) & (dna.longest_homopolymer(p) < run) & ~p.startswith("G") & (dna.count_of(p, "C") > dna.count_of(p, "G")))
    tm = lambda c: thermo.melting(c, cond)["tm_c"]
    scored = kept.withColumn("delta_tm", tm("probe") - F.greatest(tm("primer1"), tm("primer2"))).withColumn("score", F.abs(F.col("delta_tm") - 8.0))
    return top_k(scored, ["amplicon_id"], ["score", "start", "end", "strand"], per_amplicon)


def chosen_probes(windows: DataFrame, fail: float = -9.0, warn: float = -6.0) -> tuple[DataFrame, DataFrame]:
    """probe_windows() with dimers of the probe with itself and both primers: those whose most stable one is no stronger than
    fail, their score raised by what it is beyond warn, ranked (rank 1 is the choice); and the rejected, with rule and value."""
    out = windows
    for name, other in (("self", "probe"), ("fwd", "primer1"), ("rev", "primer2")):
        columns = ["probe"] if other == "probe" else ["probe", other]
        out = all_on_distinct(out, columns, {f"d_{name}": lambda *c: dimer_udf(False)(c[0], c[-1])})
    dg = lambda name: F.when(F.col(f"d_{name}.found"), F.col(f"d_{name}.dg")).otherwise(0.0)
    out = settled(out.withColumn("worst_dimer", F.least(dg("self"), dg("fwd"), dg("rev"))).drop("d_self", "d_fwd", "d_rev", "rank"))
    kept = out.where(F.col("worst_dimer") >= fail).withColumn("score", F.col("score") + F.greatest(F.lit(0.0), F.lit(warn) - F.col("worst_dimer")))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("amplicon_id").orderBy("score", "start", "end", "strand")))
    rejected = out.where(F.col("worst_dimer") < fail).select("amplicon_id", "probe", "start", "end", "strand", F.lit("PRB-05").alias("rule"), F.round("worst_dimer", 2).cast("string").alias("value"))
    return ranked, rejected


def allele_check(target: str, cond: thermo.Conditions = thermo.Conditions()) -> Column:
    """CT-04 of (primer, other): other is the second allele's site, written like the primer."""
    on = thermo.melting("primer", cond, concentration="primer_excess")
    energies = thermo.duplex_with_three_prime_mismatch("primer", "other")
    off = thermo.melting("primer", cond, energies=energies, concentration="primer_excess")
    margin = thermo.bound_fraction(on, cond.anneal_c) - thermo.bound_fraction(off, cond.anneal_c)
    ddg = (energies["dh"] - on["dh"]) - 310.15 * (energies["ds"] - on["ds"]) / 1000.0
    return evidence("CT-04", F.col(target), severity(F.lit(False), (margin < 0.20) | (ddg < 0.50)), {"margin": F.round(margin, 6), "ddg": F.round(ddg, 4)})


def blocker_check(target: str, cond: thermo.Conditions = thermo.Conditions()) -> Column:
    """CT-05 of (mutant_probe, wild_probe), modified or plain."""
    m, w = parsed_oligo(F.col("mutant_probe")), parsed_oligo(F.col("wild_probe"))
    delta = F.abs(thermo.melting(m["dna"], cond)["tm_c"] - thermo.melting(w["dna"], cond)["tm_c"])
    return evidence("CT-05", F.col(target), severity(delta < 3, delta < 5), {"delta_tm": F.round(delta, 3), "mutant_lna": m["n_lna"], "wild_lna": w["n_lna"]})


def gene_check(target: str, gene: str = "gene", genes: tuple[str, ...] = CHIP_GENES) -> Column:
    """CT-06."""
    return evidence("CT-06", F.col(target), severity(F.lit(False), F.upper(gene).isin(*genes)), {"gene": F.col(gene)})


def hybrid_check(target: str, primer: str = "primer", total: float = 2.0e-7) -> Column:
    """RT-05."""
    e = thermo.hybrid_duplex(primer)
    tm = 1000.0 * e["dh"] / (e["ds"] + 1.9872 * math.log(total / 4.0)) - 273.15
    return evidence("RT-05", F.col(target), F.lit("INFO"), {"tm_c": F.round(tm, 3)})


def melt_checks(amplicons: DataFrame, target: str, cond: thermo.Conditions = thermo.Conditions()) -> tuple[DataFrame, list[Column]]:
    """amplicons with their melting profile and fold, and AMP-02 (QPCR-02), SS-04 over them."""
    out = all_on_distinct(amplicons, ["amplicon"], {"melt": lambda a: melting.melted(a, cond.monovalent), "fold": lambda a: fold_udf()(a)})
    t = F.col(target)
    tm = structure_tm(F.col("amplicon"), F.col("fold"))
    return out, [
        evidence("AMP-02", t, severity(F.lit(False), (F.size("melt.peaks") > 1) & (F.col("melt.gap") >= 2)), {"n_peaks": F.size("melt.peaks"), "gap": F.round("melt.gap", 2), "tm_c": F.round("melt.tm", 3)}),
        evidence("SS-04", t, severity(tm > cond.anneal_c, tm > cond.anneal_c - 10), {"mfe": F.round("fold.mfe", 3), "structure_tm": F.round(tm, 3)}),
    ]


def structure_tm(seq: Column, fold: Column) -> Column:
    """Of a folded strand, in Celsius: enthalpy from the stacks alone, entropy from that and the free energy; null if it never melts so.

    A stack is an opening bracket behind another whose partners stand one behind the other too: runs of "(" and ")" that
    close each other. Without multiloops a stem's brackets nest, so partners are found by depth.
    """
    marks = dna.letters(fold["structure"])
    depth = lambda i: F.aggregate(F.slice(marks, 1, i), F.lit(0), lambda n, c: n + F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    places = F.sequence(F.lit(1), F.length(seq))
    partner = lambda i: F.get(F.filter(F.sequence(i + 1, F.length(seq)), lambda j: (F.get(marks, j - 1) == ")") & (depth(j) == depth(i) - 1)), 0)
    opened = F.transform(F.filter(places, lambda i: F.get(marks, i - 1) == "("), lambda i: F.struct(i.alias("i"), partner(i).alias("j")))

    def enthalpy(pairs: Column) -> Column:
        steps = F.create_map(*[F.lit(x) for k, v in all_steps().items() for x in (k, float(v[0]))])
        held = F.transform(pairs, lambda p: F.concat_ws(":", p["i"].cast("string"), p["j"].cast("string")))
        stacked = F.filter(pairs, lambda p: F.array_contains(held, F.concat_ws(":", (p["i"] + 1).cast("string"), (p["j"] - 1).cast("string"))))
        return F.aggregate(F.transform(stacked, lambda p: F.try_element_at(steps, F.substring(seq, p["i"], F.lit(2)))), F.lit(0.0), lambda n, x: n + x)

    dh = F.get(F.transform(F.array(opened), enthalpy), 0)
    ds = (dh - fold["mfe"]) * 1000.0 / 310.15
    return F.when((dh < 0) & (ds < 0), 1000.0 * dh / ds - 273.15)


def tailed_check(pairs: DataFrame, target: str, tail1: str = "tail1", tail2: str = "tail2") -> tuple[DataFrame, Column]:
    """DIM-07 (NGS-01) of (primer1, primer2) with the tails at their 5' ends: self and cross dimers of the whole oligos."""
    out = pairs.withColumns({"_f": F.concat(tail1, "primer1"), "_r": F.concat(tail2, "primer2")})
    for name, (x, y) in (("ff", ("_f", "_f")), ("rr", ("_r", "_r")), ("fr", ("_f", "_r"))):
        out = all_on_distinct(out, [x] if x == y else [x, y], {f"t_{name}_{tag}": lambda *c, e=end: dimer_udf(e)(c[0], c[-1]) for tag, end in (("any", False), ("three", True))})
    low = lambda tag: F.least(F.lit(0.0), *[F.when(F.col(f"t_{n}_{tag}.found"), F.col(f"t_{n}_{tag}.dg")) for n in ("ff", "rr", "fr")])
    return out, evidence("DIM-07", F.col(target), severity((low("any") < -9) | (low("three") < -7), (low("any") < -6) | (low("three") < -5)), {"any": F.round(low("any"), 3), "three": F.round(low("three"), 3)})


def reference_build(header: Column) -> Column:
    """SEQ-06: the build and patch that a FASTA header names; null without."""
    found = F.regexp_extract(header, r"(GRCh3\d(?:\.p\d+)?)", 1)
    return F.when(found != "", found)


def isoform_coverage(pairs: DataFrame, exons: DataFrame) -> DataFrame:
    """RT-03: pair_id, n_isoforms, targeted, untargeted (sorted) and severity.

    A transcript is targeted if both primers (fwd_start, fwd_end, rev_start, rev_end) lie in one merged exon each, on the
    pair's chromosome. Genes without transcripts give n_isoforms 0 and INFO.
    """
    merged = merge_intervals(exons, ["gene_name", "transcript_id", "chrom"])
    known = exons.select(F.col("gene_name").alias("gene"), "transcript_id").distinct()

    def inside(tag: str) -> DataFrame:
        ends = pairs.select("pair_id", F.col("gene").alias("gene_name"), "chrom", F.col(f"{tag}_start").alias("start"), F.col(f"{tag}_end").alias("end"))
        return containment_join(ends, merged, ["gene_name", "chrom"], left_prefix="", right_prefix="x_").select("pair_id", F.col("x_transcript_id").alias("transcript_id")).distinct()

    both = inside("fwd").join(inside("rev"), ["pair_id", "transcript_id"]).withColumn("hit", F.lit(True))
    each = pairs.select("pair_id", "gene").join(known, "gene", "left").join(both, ["pair_id", "transcript_id"], "left")
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("transcript_id"))))
    sums = each.groupBy("pair_id").agg(F.count("transcript_id").alias("n_isoforms"), names(F.col("hit")).alias("targeted"), names(F.col("hit").isNull()).alias("untargeted"))
    return sums.withColumn("rt03", severity(F.lit(False), (F.col("n_isoforms") > 0) & (F.size("targeted") == 0)))


def condition_checks(cond: thermo.Conditions) -> list[tuple[str, str]]:
    """COND-01, COND-02 of a run: rule and severity."""
    return [("COND-01", "INFO"), ("COND-02", "WARN" if cond.magnesium - cond.dntp <= 0 else "INFO")]


def contig_checks(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """SPC-08: primer with n_sites, n_anchored (last three bases match) of its sites on contaminating contigs, and severity."""
    anchored = masks.anchor_intact("mask", 3)
    sums = sites.groupBy("primer").agg(F.count("*").alias("n_sites"), F.count_if(anchored).alias("n_anchored"))
    whole = targets.select("primer").distinct().join(sums, "primer", "left").fillna(0)
    return whole.withColumn("spc08", severity(F.col("n_anchored") > 0, F.col("n_sites") > 0))


def probe_structure_check(target: str, anneal_c: float = 60.0) -> Column:
    """SS-05 of (probe, fold): the Tm of the probe's own fold against the annealing temperature."""
    tm = structure_tm(F.col("probe"), F.col("fold"))
    return evidence("SS-05", F.col(target), severity(tm > anneal_c, tm > anneal_c - 10), {"structure_tm": F.round(tm, 3), "mfe": F.round("fold.mfe", 3)})


def contract_check(contract: DataFrame, fields: tuple[str, ...] = ("anchor", "max_mismatches", "min_amplicon", "max_amplicon", "index_sha256")) -> DataFrame:
    """SPC-09: the fields that a search contract (field, value) lacks, and severity; one row."""
    wanted = F.array(*[F.lit(f) for f in fields])
    held = contract.where("value is not null and value <> ''").agg(F.collect_set("field").alias("held"))
    return held.select(F.array_except(wanted, "held").alias("missing")).withColumn("spc09", severity(F.lit(False), F.size("missing") > 0))
