"""Queries over the driver's tables, each with DuckDB SQL that says the same in another way.

The tables hold no DNA: contigs, panels and variants are derived from documents by hashes, alike in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import dna, masks, thermo
from strandlake.operators import intervals, products, ranking, rules, search, sets
from strandlake.plans import checks, design, multiplex, specificity, variants
from strandlake.plans.profiles import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BLOCKS, SHARED_BY = 8, 97


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chrom, seq: 256 bases for each document; every other block of 32 is shared with other documents."""
    part = lambda k: F.translate(F.md5(F.concat((F.col("doc_id") % SHARED_BY if k % 2 else F.col("doc_id")).cast("string"), F.lit(f":{k}"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), F.concat(*[part(k) for k in range(BLOCKS)]).alias("seq"))


_BLOCK = lambda k: f"translate(md5(concat({f'doc_id % {SHARED_BY}' if k % 2 else 'doc_id'}, ':{k}')), '0123456789abcdef', 'ACGTACGTACGTACGT')"
CONTIGS = f"contig AS (SELECT doc_id, concat('d', doc_id) AS chrom, {' || '.join(_BLOCK(k) for k in range(BLOCKS))} AS seq FROM documents)"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each document: the left primer's first base is changed, the right one lies in a shared block."""
    c = contigs(spark, sf_dir)
    left, right = F.substring("seq", 12, 20), dna.reverse_complement(F.substring("seq", 169, 20))
    return c.select(
        F.col("chrom").alias("pair_id"), F.concat(F.translate(F.substring(left, 1, 1), "ACGT", "CGTA"), F.substring(left, 2, 19)).alias("primer1"), right.alias("primer2"),
        F.lit(11).cast("long").alias("left_start"), F.lit(177).cast("long").alias("expected_length"), F.col("chrom").alias("expected_chrom"),
    )


PANEL = "panel AS (SELECT chrom AS pair_id, translate(substr(seq, 12, 1), 'ACGT', 'CGTA') || substr(seq, 13, 19) AS primer1, reverse(translate(substr(seq, 169, 20), 'ACGT', 'TGCA')) AS primer2, 11 AS left_start, 177 AS expected_length, chrom AS expected_chrom FROM contig)"

ANCHOR, MOST = 12, 3
_RC = lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))"
#: Every window of 20 bases on both strands against every primer that shares the last 12 bases.
BINDINGS = f"""primers AS (SELECT DISTINCT unnest([primer1, primer2]) AS primer FROM panel),
windows AS (SELECT chrom, s, substr(seq, s + 1, 20) AS site FROM (SELECT chrom, seq, unnest(range(0, length(seq) - 19)) AS s FROM contig)),
oriented AS (SELECT chrom, s, '+' AS strand, site, site AS o FROM windows UNION ALL SELECT chrom, s, '-', site, {_RC('site')} FROM windows),
bindings AS (SELECT primer, chrom, s, s + 20 AS e, strand, hamming(primer, o) AS mm, site, o,
  array_to_string([CASE WHEN primer[i] = o[i] THEN '.' ELSE 'X' END FOR i IN range(1, 21)], '') AS mask
  FROM oriented JOIN primers ON right(primer, {ANCHOR}) = right(o, {ANCHOR}) WHERE hamming(primer, o) <= {MOST})"""
_SITES = f"WITH {CONTIGS}, {PANEL}, {BINDINGS}"


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    primers = p.select(F.explode(F.array("primer1", "primer2")).alias("primer"))
    return search.strict_search(contigs(spark, sf_dir), primers, ANCHOR, MOST)


@query(f"""{_SITES} SELECT primer, chrom, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", strand, CAST(mm AS INTEGER) AS mismatches,
CAST(list_sum([CASE WHEN mask[i] = 'X' THEN 1 << (i - 1) ELSE 0 END FOR i IN range(1, 21)]) AS BIGINT) AS mask_bits, o AS oriented, site AS site_plus, mask FROM bindings""")
def strict_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings(spark, sf_dir)


#: All windows of both strands against all primers.
@query(f"""WITH {CONTIGS}, {PANEL}, primers AS (SELECT DISTINCT unnest([primer1, primer2]) AS primer FROM panel),
windows AS (SELECT chrom, s, substr(seq, s + 1, 20) AS site FROM (SELECT chrom, seq, unnest(range(0, length(seq) - 19)) AS s FROM contig)),
oriented AS (SELECT chrom, s, '+' AS strand, site AS o FROM windows UNION ALL SELECT chrom, s, '-', {_RC('site')} FROM windows)
SELECT primer, chrom, CAST(s AS BIGINT) AS start, strand, CAST(hamming(primer, o) AS INTEGER) AS mismatches FROM oriented JOIN primers ON hamming(primer, o) <= 3""")
def sensitive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    primers = panel(spark, sf_dir).select(F.explode(F.array("primer1", "primer2")).alias("primer"))
    found = search.sensitive_search(contigs(spark, sf_dir), primers, 3)
    return found.select("primer", "chrom", "start", "strand", "mismatches")


#: Documents whose contigs are one after another in one long contig, of over a million bases.
IN_A_ROW = 5000


def long_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = contigs(spark, sf_dir).select(F.floor(F.col("doc_id") / IN_A_ROW).alias("k"), F.struct("doc_id", "seq").alias("x"))
    return part.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("all")).select(F.concat(F.lit("long"), F.col("k").cast("string")).alias("chrom"), F.array_join(F.transform("all", lambda x: x["seq"]), "").alias("seq"))


#: Each document's windows with the first bases of the next one behind it.
@query(f"""WITH {CONTIGS}, {PANEL}, long AS (SELECT concat('long', doc_id // {IN_A_ROW}) AS chrom, (row_number() OVER w - 1) * {32 * BLOCKS} AS ahead, seq || coalesce(left(lead(seq) OVER w, 19), '') AS seq FROM contig WINDOW w AS (PARTITION BY doc_id // {IN_A_ROW} ORDER BY doc_id)),
primers AS (SELECT DISTINCT unnest([primer1, primer2]) AS primer FROM panel),
windows AS (SELECT chrom, ahead + s AS s, substr(seq, s + 1, 20) AS site FROM (SELECT chrom, ahead, seq, unnest(range(0, length(seq) - 19)) AS s FROM long)),
oriented AS (SELECT chrom, s, '+' AS strand, site AS o FROM windows UNION ALL SELECT chrom, s, '-', {_RC('site')} FROM windows)
SELECT primer, chrom, CAST(s AS BIGINT) AS start, strand, CAST(hamming(primer, o) AS INTEGER) AS mismatches FROM oriented JOIN primers ON right(primer, {ANCHOR}) = right(o, {ANCHOR}) WHERE hamming(primer, o) <= {MOST}""")
def long_contig_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    primers = panel(spark, sf_dir).select(F.explode(F.array("primer1", "primer2")).alias("primer"))
    return search.strict_search(long_contigs(spark, sf_dir), primers, ANCHOR, MOST).select("primer", "chrom", "start", "strand", "mismatches")


@query(f"""WITH {CONTIGS}, {PANEL}, primers AS (SELECT DISTINCT primer2 AS primer FROM panel),
w AS (SELECT substr(seq, s + 1, 12) AS k FROM (SELECT seq, unnest(range(0, length(seq) - 11)) AS s FROM contig)),
n AS (SELECT primer, count(k) AS n FROM primers LEFT JOIN (SELECT k FROM w UNION ALL SELECT {_RC('k')} FROM w) ON k = right(primer, 12) GROUP BY primer)
SELECT primer, n AS n_anchor, CASE WHEN n <= 10 THEN 'EASY' WHEN n <= 100 THEN 'MODERATE' WHEN n <= 1000 THEN 'HARD' ELSE 'REPEAT_RICH' END AS difficulty FROM n""")
def search_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_difficulty(contigs(spark, sf_dir), panel(spark, sf_dir).select(F.col("primer2").alias("primer")))


@query(f"WITH {CONTIGS} SELECT kmer, count(*) AS n FROM (SELECT substr(seq, s + 1, 12) AS kmer FROM (SELECT seq, unnest(range(0, length(seq) - 11)) AS s FROM contig)) GROUP BY kmer")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.kmers(search.chunks(contigs(spark, sf_dir), 12, 100), 12).groupBy("kmer").agg(F.count("*").alias("n"))


_PRODUCTS = """products AS (SELECT DISTINCT p.pair_id, a.chrom, a.s AS start, b.e AS "end", b.e - a.s AS length, a.primer AS left_primer, b.primer AS right_primer, a.mm AS left_mismatches, b.mm AS right_mismatches, a.mm + b.mm AS mismatches, a.mask AS left_mask, b.mask AS right_mask
FROM panel p JOIN bindings a ON a.strand = '+' AND a.primer IN (p.primer1, p.primer2) JOIN bindings b ON b.strand = '-' AND b.primer IN (p.primer1, p.primer2) AND a.chrom = b.chrom AND b.s >= a.e AND b.e - a.s BETWEEN 50 AND 200 AND a.primer <> b.primer)"""


@query(f'{_SITES}, {_PRODUCTS} SELECT pair_id, chrom, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(length AS BIGINT) AS length, left_primer, right_primer, CAST(left_mismatches AS INTEGER) AS left_mismatches, CAST(right_mismatches AS INTEGER) AS right_mismatches, CAST(mismatches AS INTEGER) AS mismatches, left_mask, right_mask FROM products')
def pair_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.pair_products(panel(spark, sf_dir), bindings(spark, sf_dir), 50, 200)


@query(f"""{_SITES}, {_PRODUCTS}, j AS (SELECT p.pair_id, q.mismatches, q.start = p.left_start AND q.length = p.expected_length AND q.chrom = p.expected_chrom AS good, q.pair_id IS NOT NULL AS there FROM panel p LEFT JOIN products q ON q.pair_id = p.pair_id),
g AS (SELECT pair_id, count(*) FILTER (there) AS n_products, count(*) FILTER (good) AS n_intended, count(*) FILTER (NOT good) AS n_off, count(*) FILTER (NOT good AND mismatches = 0) AS n_off_exact, CAST(min(mismatches) FILTER (NOT good) AS INTEGER) AS least_off_mismatches FROM j GROUP BY pair_id)
SELECT *, CASE WHEN n_intended <> 1 OR n_off_exact > 0 THEN 'FAIL' WHEN n_off > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM g""")
def panel_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specificity.panel_qc(panel(spark, sf_dir), bindings(spark, sf_dir), 50, 200)["pairs"]


@query(f"""{_SITES}, f AS (SELECT primer, mm, CASE WHEN instr(right(mask, 3), 'X') = 0 THEN 1 ELSE 0 END AS a FROM bindings),
r AS (SELECT pair_id, 'F' AS role, primer1 AS primer FROM panel UNION ALL SELECT pair_id, 'R', primer2 FROM panel),
h AS (SELECT primer, string_agg(t, ',' ORDER BY t) AS histogram FROM (SELECT primer, concat(mm, ':', count(*)) AS t FROM f GROUP BY primer, mm) GROUP BY primer)
SELECT pair_id, role, r.primer, count(mm) AS n_sites, count(*) FILTER (mm = 0) AS n_exact, count(*) FILTER (mm > 0 AND a = 1) AS n_anchored_mismatched, coalesce(any_value(histogram), '') AS histogram,
CASE WHEN count(*) FILTER (mm = 0) > 1 THEN 'FAIL' WHEN count(*) FILTER (mm = 0) = 0 THEN 'WARN' ELSE 'INFO' END AS spc01,
CASE WHEN count(*) FILTER (mm > 0 AND a = 1) > 0 OR count(*) FILTER (mm = 0) > 1 THEN 'WARN' ELSE 'INFO' END AS spc02 FROM r LEFT JOIN f ON f.primer = r.primer LEFT JOIN h ON h.primer = r.primer GROUP BY pair_id, role, r.primer""")
def primer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specificity.primer_sites(panel(spark, sf_dir), bindings(spark, sf_dir)).select("pair_id", "role", "primer", "n_sites", "n_exact", "n_anchored_mismatched", "histogram", "spc01", "spc02")


@query(f"""{_SITES}, c AS (SELECT a.chrom, a.s AS start, b.e AS "end", a.primer AS l, b.primer AS r, a.mm + b.mm AS mm, concat(least(a.primer, b.primer), '/', greatest(a.primer, b.primer)) AS combo
FROM bindings a JOIN bindings b ON a.strand = '+' AND b.strand = '-' AND a.chrom = b.chrom AND b.s >= a.e AND b.e - a.s BETWEEN 50 AND 200),
d AS (SELECT DISTINCT concat(least(primer1, primer2), '/', greatest(primer1, primer2)) AS combo, true AS designed FROM panel)
SELECT combo, coalesce(designed, false) AS designed, count(*) AS n, count(*) FILTER (mm = 0) AS n_exact FROM c LEFT JOIN d USING (combo) GROUP BY combo, designed""")
def cross_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = products.cross_products(bindings(spark, sf_dir), panel(spark, sf_dir), 50, 200)
    return found.groupBy("combo", "designed").agg(F.count("*").alias("n"), F.count_if(F.col("mismatches") == 0).alias("n_exact"))


@query(f"""{_SITES}, c AS (SELECT b.e - a.s AS length, a.mm + b.mm AS mm, concat(least(a.primer, b.primer), '/', greatest(a.primer, b.primer)) IN (SELECT concat(least(primer1, primer2), '/', greatest(primer1, primer2)) FROM panel) AS designed
FROM bindings a JOIN bindings b ON a.strand = '+' AND b.strand = '-' AND a.chrom = b.chrom AND b.s >= a.e AND b.e - a.s BETWEEN 50 AND 200)
SELECT count(*) AS n_total, count(*) FILTER (designed) AS n_designed, count(*) FILTER (NOT designed) AS n_cross, count(*) FILTER (NOT designed AND mm = 0) AS n_cross_exact, CASE WHEN count(*) FILTER (NOT designed) > 0 THEN 'FAIL' ELSE 'INFO' END AS mpx02 FROM c""")
def multiplex_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = products.cross_products(bindings(spark, sf_dir), panel(spark, sf_dir), 50, 200)
    return multiplex.cross_summary(found, 166).select("n_total", "n_designed", "n_cross", "n_cross_exact", "mpx02")


@query(f"""{_SITES} SELECT primer, chrom, CAST(s AS BIGINT) AS start, strand, CAST(mm AS INTEGER) AS mismatches, CAST(length(replace(left(mask, 5), '.', '')) AS INTEGER) AS first5, CAST(length(replace(right(mask, 5), '.', '')) AS INTEGER) AS last5, CAST(length(replace(right(mask, 8), '.', '')) AS INTEGER) AS last8,
CASE WHEN mm > 0 THEN CAST(instr(reverse(mask), 'X') - 1 AS INTEGER) END AS nearest_to_3p, round(list_sum([CASE WHEN mask[i] = 'X' THEN i ELSE 0 END FOR i IN range(1, 21)]) / 210.0, 6) AS burden, lpad(lower(to_hex(list_sum([CASE WHEN mask[i] = 'X' THEN 1 << (i - 1) ELSE 0 END FOR i IN range(1, 21)]))), 16, '0') AS hex_mask FROM bindings""")
def mismatch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bindings(spark, sf_dir).withColumn("f", masks.mismatch_features("mask_bits", F.length("primer")))
    return b.select("primer", "chrom", "start", "strand", "mismatches", F.col("f.first5").alias("first5"), F.col("f.last5").alias("last5"), F.col("f.last8").alias("last8"), F.col("f.nearest_to_3p").cast("int").alias("nearest_to_3p"), F.round("f.positional_burden", 6).alias("burden"), masks.hexadecimal("mask_bits").alias("hex_mask"))


def entropy_sql(seq: str) -> str:
    """Of a column's bases, in bits."""
    return f"list_sum([CASE WHEN n = 0 THEN 0 ELSE -n / CAST(length({seq}) AS DOUBLE) * log2(n / CAST(length({seq}) AS DOUBLE)) END FOR n IN [length({seq}) - length(replace({seq}, b, '')) FOR b IN ['A', 'C', 'G', 'T']]])"


_K1 = "[length(seq) - length(replace(seq, b, '')) FOR b IN ['A', 'C', 'G', 'T']]"


@query(f"""WITH {CONTIGS} SELECT chrom, CAST(length(replace(replace(seq, 'A', ''), 'T', '')) AS INTEGER) AS gc, CAST(length(regexp_replace(right(seq, 5), '[^GC]', '', 'g')) AS INTEGER) AS clamp,
CAST(list_max([length(x) FOR x IN regexp_extract_all(seq, '(A+|C+|G+|T+)')]) AS INTEGER) AS longest_run, {_RC('seq')} AS rc, CAST(len(regexp_extract_all(seq, 'CG')) AS INTEGER) AS cpg,
round(-list_sum([CASE WHEN n = 0 THEN 0 ELSE n / 256.0 * log2(n / 256.0) END FOR n IN {_K1}]), 6) AS k1, round(list_max([length(replace(replace(substr(seq, i, 50), 'A', ''), 'T', '')) FOR i IN range(1, 208)]) / 50.0, 6) AS window_gc,
regexp_matches(seq, 'G{{3,}}\\w{{1,7}}G{{3,}}\\w{{1,7}}G{{3,}}\\w{{1,7}}G{{3,}}') OR regexp_matches({_RC('seq')}, 'G{{3,}}\\w{{1,7}}G{{3,}}\\w{{1,7}}G{{3,}}\\w{{1,7}}G{{3,}}') AS g4 FROM contig""")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contigs(spark, sf_dir).select(
        "chrom", dna.gc_count("seq").alias("gc"), dna.gc_clamp("seq").alias("clamp"), dna.longest_homopolymer("seq").alias("longest_run"), dna.reverse_complement("seq").alias("rc"), dna.cpg_count("seq").alias("cpg"),
        F.round(dna.shannon_entropy("seq"), 6).alias("k1"), F.round(dna.gc_window_max("seq", 50), 6).alias("window_gc"), dna.has_g_quadruplex("seq").alias("g4"),
    )


#: Copies of a unit from every start, counted one after another.
@query(f"""WITH RECURSIVE {CONTIGS}, s AS (SELECT chrom, seq, i, u, substr(seq, i, u) AS m FROM (SELECT chrom, seq, unnest(range(1, 256)) AS i FROM contig), (SELECT unnest([2, 3]) AS u) WHERE i <= length(seq) - u),
r AS (SELECT chrom, seq, i, u, m, 1 AS n FROM s UNION ALL SELECT chrom, seq, i, u, m, n + 1 FROM r WHERE substr(seq, i + n * u, u) = m)
SELECT chrom, u AS unit, max(n) AS copies FROM r GROUP BY chrom, u""")
def tandem_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(u).alias("unit"), dna.max_repeat_units("seq", u).alias("copies")) for u in (2, 3)])
    return contigs(spark, sf_dir).select("chrom", F.inline(each))


_STEP = {"AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4), "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "TT": (-7.9, -22.2), "TG": (-8.5, -22.7), "AC": (-8.4, -22.4), "AG": (-7.8, -21.0), "TC": (-8.2, -22.2), "CC": (-8.0, -19.9)}


def steps_sql(seq: str, k: int) -> str:
    """Enthalpy (0) or entropy (1) of the steps of a column."""
    return f"list_sum([CASE {' '.join(f'WHEN x = {chr(39)}{s}{chr(39)} THEN {v[k]}' for s, v in _STEP.items())} END FOR x IN [substr({seq}, i, 2) FOR i IN range(1, length({seq}))]])"


def _duplex_sql(seq: str) -> str:
    """dh, ds of a column by counting over its steps."""
    part = lambda k: steps_sql(seq, k)
    end = lambda b, k: f"CASE WHEN {b} IN ('A', 'T') THEN {(2.3, 4.1)[k]} ELSE {(0.1, -2.8)[k]} END"
    sym = f"CASE WHEN {seq} = {_RC(seq)} THEN -1.4 ELSE 0 END"
    return f"CAST({part(0)} AS DOUBLE) + {end(f'left({seq}, 1)', 0)} + {end(f'right({seq}, 1)', 0)} AS dh, CAST({part(1)} AS DOUBLE) + {end(f'left({seq}, 1)', 1)} + {end(f'right({seq}, 1)', 1)} + {sym} AS ds"


_GC = "length(replace(replace(primer, 'A', ''), 'T', '')) / CAST(length(primer) AS DOUBLE)"
#: Free magnesium 0.9 mM and 50 mM monovalent: the mixed regime.
_THERMO = f"""d AS (SELECT primer, {_duplex_sql('primer')}, {_GC} AS f, length(primer) AS n, CASE WHEN primer = {_RC('primer')} THEN 2e-7 ELSE 2e-7 END AS c FROM primers),
t AS (SELECT *, 1000 * dh / (ds + 1.9872 * ln(c)) AS tm1, ln(0.05) AS lm, ln(0.0009) AS lg FROM d),
m AS (SELECT *, 1 / (1 / tm1 + 3.92e-5 * (0.843 - 0.352 * sqrt(0.05) * lm) - 9.11e-6 * lg + f * (6.26e-5 + 1.42e-5 * (1.279 - 4.03e-3 * lm - 8.03e-3 * lm * lm) * lg) + 1 / (2.0 * (n - 1)) * (-4.82e-4 + 5.25e-4 * lg + 8.31e-5 * (0.486 - 0.258 * lm + 5.25e-3 * lm * lm * lm) * lg * lg)) AS tm,
1 / (1 / tm1 + (4.29 * f - 3.95) * 1e-5 * ln(0.05 + 0.12 * sqrt(0.9)) + 9.40e-6 * power(ln(0.05 + 0.12 * sqrt(0.9)), 2)) AS tmv FROM t),
e AS (SELECT *, 1000 * dh / tm - 1.9872 * ln(c) AS dse FROM m)"""


@query(f"""WITH {CONTIGS}, {PANEL}, primers AS (SELECT DISTINCT unnest([primer1, primer2]) AS primer FROM panel), {_THERMO}
SELECT primer, round(dh, 4) AS dh, round(ds, 4) AS ds, round(tm1 - 273.15, 4) AS tm_1m_c, round(tm - 273.15, 4) AS tm_c, round((1000 * dh - 310.15 * dse) / 1000, 4) AS dg37,
round(1 - 1 / (1 + exp(-(1000 * dh - 333.15 * dse) / (1.9872 * 333.15)) * c), 6) AS theta60, round(abs(tm - tmv), 4) AS spread FROM e""")
def thermodynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select(F.explode(F.array("primer1", "primer2")).alias("primer")).distinct().withColumn("m", thermo.melting("primer"))
    m = F.col("m")
    return p.select("primer", F.round(m["dh"], 4).alias("dh"), F.round(m["ds"], 4).alias("ds"), F.round(m["tm_1m_c"], 4).alias("tm_1m_c"), F.round(m["tm_c"], 4).alias("tm_c"), F.round(thermo.free_energy(m), 4).alias("dg37"), F.round(thermo.bound_fraction(m, 60.0), 6).alias("theta60"), F.round(thermo.salt_spread("primer"), 4).alias("spread"))


@query(f"""WITH {CONTIGS}, {PANEL}, primers AS (SELECT DISTINCT primer2 AS primer FROM panel), {_THERMO},
g AS (SELECT primer, dh, dse, c, unnest(range(0, 31)) AS i FROM e) SELECT primer, CAST(20 + i * 2.5 AS DOUBLE) AS t, round(1 - 1 / (1 + exp(least(-(1000 * dh - (293.15 + i * 2.5) * dse) / (1.9872 * (293.15 + i * 2.5)), 700)) * c), 6) AS theta FROM g""")
def melting_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select(F.col("primer2").alias("primer")).distinct().withColumn("m", thermo.melting("primer"))
    return p.select("primer", F.inline(thermo.melting_curve(F.col("m"), 20.0, 95.0, 2.5))).select("primer", "t", F.round("theta", 6).alias("theta"))


_CONS = limits("qpcr_sybr")


@query(f"""WITH {CONTIGS}, w AS (SELECT chrom, s, s + n AS e, substr(seq, s + 1, n) AS x FROM (SELECT chrom, seq, unnest(range(0, length(seq))) AS s FROM contig), (SELECT unnest(range(18, 28)) AS n) WHERE s + n <= length(seq)),
b AS (SELECT chrom, 'F' AS o, s, e, x FROM w UNION ALL SELECT chrom, 'R', s, e, {_RC('x')} FROM w),
v AS (SELECT *, length(replace(replace(x, 'A', ''), 'T', '')) / CAST(length(x) AS DOUBLE) AS gc, length(replace(replace(right(x, 5), 'A', ''), 'T', '')) AS clamp, regexp_matches(x, 'AAAA|CCCC|GGGG|TTTT') AS run,
regexp_matches(x, '{"|".join(f"({a + b}){{4}}" for a in "ACGT" for b in "ACGT")}|{"|".join(f"({a + b + c}){{4}}" for a in "ACGT" for b in "ACGT" for c in "ACGT")}') AS rep FROM b),
r AS (SELECT chrom, o, CASE WHEN gc < 0.4 OR gc > 0.6 THEN 'CMP-01' WHEN clamp < 1 OR clamp > 3 THEN 'CMP-02' WHEN run THEN 'CMP-03' WHEN rep THEN 'CMP-04' ELSE 'ok' END AS rule FROM v)
SELECT chrom AS target_id, o AS orientation, rule, count(*) AS n FROM r GROUP BY ALL""")
def design_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = contigs(spark, sf_dir).select(F.col("chrom").alias("target_id"), "seq")
    return design.composition_counts(targets, _CONS)


@query(f"""WITH {CONTIGS}, x AS (SELECT chrom, s AS a, s + 20 AS b FROM (SELECT chrom, unnest(range(0, 237, 7)) AS s FROM contig))
SELECT l.chrom, CAST(l.a AS BIGINT) AS l_start, CAST(r.b AS BIGINT) AS r_end FROM x l JOIN x r ON l.chrom = r.chrom AND r.b - l.a BETWEEN 70 AND 120 AND r.a >= l.b""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = contigs(spark, sf_dir).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(236).cast("long"), F.lit(7).cast("long"))).alias("start")).withColumn("end", F.col("start") + 20)
    return intervals.band_join(x, x, ["chrom"], "start", "end", 70, 120).where("r_start >= l_end").select("chrom", "l_start", "r_end")


#: Orders as intervals of days from their date on, as long as their priority says; per customer.
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), day.alias("start"), (day + 5 + 20 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("end"))


_SPANS = "x AS (SELECT o_custkey AS key, o_orderkey AS id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS a, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 5 + 20 * CAST(left(o_orderpriority, 1) AS INTEGER) AS BIGINT) AS b FROM orders)"


@query(f"WITH {_SPANS} SELECT l.key, l.id AS l_id, r.id AS r_id FROM x l JOIN x r ON l.key = r.key AND l.id < r.id AND l.a < r.b AND l.b > r.a")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spans(spark, sf_dir)
    return intervals.overlap_join(x, x, ["key"], width=64).where("l_id < r_id").select("key", "l_id", "r_id")


@query(f"WITH {_SPANS} SELECT i.id AS inner_id, o.id AS outer_id FROM x i JOIN x o ON i.key = o.key AND i.id <> o.id AND i.a >= o.a AND i.b <= o.b")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spans(spark, sf_dir)
    return intervals.containment_join(x, x, ["key"], width=64).where("l_id <> r_id").select(F.col("l_id").alias("inner_id"), F.col("r_id").alias("outer_id"))


@query(f"""WITH {_SPANS}, o AS (SELECT *, max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT key, min(a) AS start, max(b) AS "end", count(*) AS n FROM g GROUP BY key, g""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(spans(spark, sf_dir), ["key"])


@query(f"WITH {_SPANS} SELECT key, id, a AS start, b AS \"end\" FROM x l WHERE NOT EXISTS (SELECT 1 FROM x r WHERE r.key = l.key AND r.id <> l.id AND r.a < l.b AND r.b > l.a)")
def lonely_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spans(spark, sf_dir)
    met = intervals.overlap_join(x, x, ["key"], width=64).where("l_id <> r_id").select(F.col("l_id").alias("id")).distinct()
    return x.join(met, "id", "left_anti").select("key", "id", "start", "end")


@query(f"WITH {_SPANS}, g AS (SELECT key, a - lag(a) OVER (PARTITION BY key ORDER BY a) AS g FROM x) SELECT key, min(g) AS min_gap, count(*) FILTER (g < 10) AS n_conflicts FROM g GROUP BY key")
def smallest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.smallest_gap(spans(spark, sf_dir), ["key"], "start", 10)


@query("""WITH p AS (SELECT p_brand AS brand, p_partkey AS id, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part)
SELECT brand, id FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.brand = x.brand AND y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))""")
def skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return ranking.skyline(p, ["brand"], ["a", "b"]).select("brand", "id")


@query("""WITH p AS (SELECT p_brand AS brand, p_partkey AS id, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part), e AS (SELECT brand, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM p GROUP BY brand),
s AS (SELECT p.brand, id, ((CASE WHEN ha > la THEN (a - la) / (ha - la) ELSE 0 END) + (CASE WHEN hb > lb THEN (b - lb) / (hb - lb) ELSE 0 END)) / 2 AS s FROM p JOIN e ON p.brand = e.brand)
SELECT brand, id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY brand ORDER BY s, id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY brand ORDER BY s, id) <= 5""")
def min_max_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return ranking.top_k(ranking.min_max_score(p, ["brand"], ["a", "b"]), ["brand"], ["score", "id"], 5).select("brand", "id", F.round("score", 6).alias("score"), "rank")


@query("""WITH t AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'), q AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity > 25),
j AS (SELECT coalesce(t.s, q.s) AS s, t.p IS NOT NULL AS a, q.p IS NOT NULL AS b FROM t FULL JOIN q ON t.s = q.s AND t.p = q.p), n AS (SELECT s, count(*) FILTER (a) AS x, count(*) FILTER (b) AS y, count(*) FILTER (a AND b) AS z FROM j GROUP BY s)
SELECT s AS supplier, x AS n_truth, y AS n_predicted, z AS n_both, round(CASE WHEN y > 0 THEN z / CAST(y AS DOUBLE) WHEN z = y THEN 1 ELSE 0 END, 6) AS precision, round(CASE WHEN x > 0 THEN z / CAST(x AS DOUBLE) WHEN z = x THEN 1 ELSE 0 END, 6) AS recall, round(2.0 * z / (x + y), 6) AS f1, round(z / CAST(x + y - z AS DOUBLE), 6) AS jaccard FROM n""")
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), "l_returnflag", "l_quantity")
    m = sets.compare(x.where("l_returnflag = 'R'"), x.where("l_quantity > 25"), ["supplier", "part"], ["supplier"])
    return m.select("supplier", "n_truth", "n_predicted", "n_both", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "jaccard")])


#: Variants at a hash's place of each contig, with a hash's frequency.
def variant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contigs(spark, sf_dir).select("doc_id", "chrom", "seq", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    h = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("v"), F.col("k").cast("string"))), 1, 7), 16, 10).cast("long")
    pos = (h % 240 + 1).alias("pos")
    raw = c.select("chrom", "seq", pos, (h % 3).alias("kind"), (F.lit(1.0) / (F.floor(h / 240) % 5000 + 2)).alias("af"))
    base = F.substring(F.col("seq"), F.col("pos").cast("int"), F.lit(1))
    ref = F.when(F.col("kind") == 2, F.substring(F.col("seq"), F.col("pos").cast("int"), F.lit(3))).otherwise(base)
    alt = F.when(F.col("kind") == 0, F.translate(base, "ACGT", "CATG")).otherwise(base)
    alt = F.when(F.col("kind") == 1, F.translate(base, "ACGT", "GTAC")).otherwise(alt)
    return raw.select("chrom", "pos", ref.alias("ref"), alt.alias("alt"), "af", F.create_map(F.lit("x"), F.col("af") * 6.0).alias("pop_af"))


VARIANTS = """vh AS (SELECT doc_id, chrom, seq, CAST(('0x' || left(md5(concat(doc_id, 'v', k)), 7)) AS BIGINT) AS h FROM (SELECT doc_id, chrom, seq, unnest(range(0, 20)) AS k FROM contig)),
va AS (SELECT chrom, h % 240 + 1 AS pos, h % 3 AS kind, 1.0::DOUBLE / ((h // 240) % 5000 + 2) AS af FROM vh), vs AS (SELECT chrom, pos - 1 AS a, pos - 1 + CASE WHEN kind = 2 THEN 3 ELSE 1 END AS b, kind = 2 AS indel, af FROM va),
ss AS (SELECT chrom || '_F' AS site_id, chrom, 11 AS a, 31 AS b, '+' AS strand FROM contig UNION ALL SELECT chrom || '_R', chrom, 168, 188, '-' FROM contig)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contigs(spark, sf_dir)
    one = F.struct(F.concat("chrom", F.lit("_F")).alias("site_id"), F.lit(11).cast("long").alias("start"), F.lit(31).cast("long").alias("end"), F.lit("+").alias("strand"), F.substring("seq", 12, 20).alias("sequence"))
    two = F.struct(F.concat("chrom", F.lit("_R")).alias("site_id"), F.lit(168).cast("long").alias("start"), F.lit(188).cast("long").alias("end"), F.lit("-").alias("strand"), dna.reverse_complement(F.substring("seq", 169, 20)).alias("sequence"))
    return c.select("chrom", F.inline(F.array(one, two)))


@query(f"""WITH {CONTIGS}, {VARIANTS}, h AS (SELECT site_id, af, indel, CASE WHEN strand = '+' THEN v.a < s.b AND v.b > s.b - 5 ELSE v.a < s.a + 5 AND v.b > s.a END AS tp FROM ss s JOIN vs v ON s.chrom = v.chrom AND v.a < s.b AND v.b > s.a),
g AS (SELECT s.site_id, count(af) AS n_variants, count(*) FILTER (af >= 0.0001) AS n_reported, count(*) FILTER (tp) AS n_3p, count(*) FILTER (af >= 0.01) AS n_common, count(*) FILTER (indel) AS n_indels, coalesce(max(af), 0) AS m, coalesce(max(af) FILTER (tp), 0) AS m3, coalesce(max(af) FILTER (indel AND af >= 0.0001), 0) AS mi, count(*) FILTER (indel AND af >= 0.0001) AS ni, count(*) FILTER (af * 6 >= 0.01) AS np FROM ss s LEFT JOIN h ON h.site_id = s.site_id GROUP BY s.site_id)
SELECT site_id, n_variants, n_reported, n_3p, n_common, n_indels, CASE WHEN m >= 0.001 THEN 'WARN' ELSE 'INFO' END AS var01, CASE WHEN m3 >= 0.01 THEN 'FAIL' WHEN m3 >= 0.0001 THEN 'WARN' ELSE 'INFO' END AS var02, CASE WHEN n_common > 0 AND m >= 0.05 THEN 'FAIL' WHEN n_common > 0 THEN 'WARN' ELSE 'INFO' END AS var03,
CASE WHEN m >= 0.01 THEN 'FAIL' WHEN m >= 0.001 THEN 'WARN' ELSE 'INFO' END AS var05, CASE WHEN mi >= 0.01 THEN 'FAIL' WHEN ni > 0 THEN 'WARN' ELSE 'INFO' END AS var06, CASE WHEN np > 0 THEN 'WARN' ELSE 'INFO' END AS var07 FROM g""")
def variant_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites(spark, sf_dir)
    found = variants.site_checks(s, variants.site_hits(s, variants.prepared(variant_table(spark, sf_dir))))
    return found.select("site_id", "n_variants", "n_reported", "n_3p", "n_common", "n_indels", "var01", "var02", "var03", "var05", "var06", "var07")


@query(f"""WITH {CONTIGS}, {VARIANTS}, f AS (SELECT DISTINCT ON (chrom, v.a, v.b, v.indel, v.af, rn) chrom, v.a, v.b, indel, af FROM (SELECT *, row_number() OVER () AS rn FROM vs) v WHERE NOT EXISTS (SELECT 1 FROM ss s WHERE s.chrom = v.chrom AND v.a < s.b AND v.b > s.a)),
j AS (SELECT c.chrom, indel, af FROM contig c LEFT JOIN f ON f.chrom = c.chrom AND f.a < 188 AND f.b > 11)
SELECT chrom AS amplicon_id, count(af) AS n_inside, count(*) FILTER (indel AND af >= 0.01) AS n_common_indels, CASE WHEN count(*) FILTER (indel AND af >= 0.01) > 0 THEN 'WARN' ELSE 'INFO' END AS var08 FROM j GROUP BY chrom""")
def amplicon_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = contigs(spark, sf_dir).select(F.col("chrom").alias("amplicon_id"), "chrom", F.lit(11).cast("long").alias("start"), F.lit(188).cast("long").alias("end"))
    found = variants.amplicon_checks(a, sites(spark, sf_dir), variants.prepared(variant_table(spark, sf_dir)))
    return found.select("amplicon_id", "n_inside", "n_common_indels", "var08")


@query(f"""WITH {CONTIGS}, {PANEL}, c AS (SELECT pair_id, translate(primer1, 'C', 'T') AS s, primer1 AS o FROM panel), n AS (SELECT pair_id, CAST(len(regexp_extract_all(o, 'CG')) AS INTEGER) AS cpg, CASE WHEN instr(reverse(o), 'GC') > 0 THEN instr(reverse(o), 'GC') END AS near, length(o) - length(replace(o, 'C', '')) - len(regexp_extract_all(o, 'CG')) AS other, {entropy_sql('o')} AS h FROM c)
SELECT pair_id, cpg, CASE WHEN near < 5 THEN 'FAIL' WHEN cpg > 0 THEN 'WARN' ELSE 'INFO' END AS bis01, CASE WHEN other < 2 THEN 'WARN' ELSE 'INFO' END AS bis02, CASE WHEN h < 0.9 THEN 'FAIL' WHEN h < 1.2 THEN 'WARN' ELSE 'INFO' END AS bis03 FROM n""")
def bisulfite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two, three = checks.bisulfite_checks("pair_id", "primer1", "primer1")
    return panel(spark, sf_dir).select("pair_id", dna.cpg_count("primer1").alias("cpg"), one["severity"].alias("bis01"), two["severity"].alias("bis02"), three["severity"].alias("bis03"))


#: Three transcripts for each contig's gene, but none for every seventh. Each exon's ends are digits of a hash; the second exon of a
#: transcript may overlap or touch its first one, and the third lies around the right primer or just beside it.
_DIGIT = lambda k: f"('0x' || substr(md5(concat('exon', doc_id, t)), {k}, 1))::BIGINT"


@query(f"""WITH {CONTIGS}, t AS (SELECT doc_id, t FROM contig, (SELECT unnest(['t1', 't2', 't3']) AS t) WHERE doc_id % 7 <> 0),
e AS (SELECT doc_id, t, unnest([{_DIGIT(1)}, 18 + {_DIGIT(2)}, 156 + {_DIGIT(3)}]) AS a, unnest([20 + {_DIGIT(4)}, 40 + {_DIGIT(5)}, 176 + 2 * {_DIGIT(6)}]) AS b FROM t),
m AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, t ORDER BY a, b) AS k FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id, t ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM e)),
x AS (SELECT doc_id, t, min(a) AS a, max(b) AS b FROM m GROUP BY doc_id, t, k),
h AS (SELECT doc_id, t, bool_or(a <= 11 AND b >= 31) AND bool_or(a <= 168 AND b >= 188) AS hit FROM x GROUP BY doc_id, t)
SELECT c.doc_id, count(h.t) AS n_isoforms, coalesce(string_agg(h.t, ',' ORDER BY h.t) FILTER (hit), '') AS targeted, coalesce(string_agg(h.t, ',' ORDER BY h.t) FILTER (NOT hit), '') AS untargeted,
  CASE WHEN count(h.t) > 0 AND count(*) FILTER (hit) = 0 THEN 'WARN' ELSE 'INFO' END AS rt03 FROM contig c LEFT JOIN h ON h.doc_id = c.doc_id GROUP BY c.doc_id""")
def isoform_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts whose merged exons hold both primers of a pair."""
    c = contigs(spark, sf_dir)
    gene = F.concat(F.lit("g"), F.col("doc_id").cast("string"))
    each = c.where("doc_id % 7 <> 0").select("chrom", "doc_id", gene.alias("gene_name"), F.explode(F.array(*[F.lit(f"t{k}") for k in (1, 2, 3)])).alias("transcript_id"))
    each = each.withColumn("h", F.md5(F.concat(F.lit("exon"), F.col("doc_id").cast("string"), "transcript_id")))
    digit = lambda k: F.conv(F.substring("h", k, 1), 16, 10).cast("long")
    exon = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    exons = each.select("chrom", "gene_name", "transcript_id", F.inline(F.array(exon(digit(1), 20 + digit(4)), exon(18 + digit(2), 40 + digit(5)), exon(156 + digit(3), 176 + 2 * digit(6)))))
    n = lambda k: F.lit(k).cast("long")
    pairs = c.select(F.col("doc_id").alias("pair_id"), gene.alias("gene"), "chrom", n(11).alias("fwd_start"), n(31).alias("fwd_end"), n(168).alias("rev_start"), n(188).alias("rev_end"))
    found = checks.isoform_coverage(pairs, exons)
    return found.select(F.col("pair_id").alias("doc_id"), "n_isoforms", F.array_join("targeted", ",").alias("targeted"), F.array_join("untargeted", ",").alias("untargeted"), "rt03")


@query("""WITH b AS (SELECT date_trunc('hour', ts) AS window_start, event_type FROM events) SELECT window_start, event_type, count(*) AS n FROM b GROUP BY ALL""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.streaming import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query(None)
def dimers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self and pair dimers of every panel primer; tests hold them against brute force."""
    given = panel(spark, sf_dir)
    role = lambda c, tag: F.struct(F.concat("pair_id", F.lit(tag)).alias("primer_id"), F.col(c).alias("primer"))
    primers = given.select(F.inline(F.array(role("primer1", "_F"), role("primer2", "_R"))))
    found = [rules.records(df, *told) for df, told in (checks.self_checks(primers, "primer_id"), checks.hetero_checks(given, "pair_id"))]
    return found[0].union(found[1]).select("target", "rule", "value", "severity")


@query(None)
def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hairpins, folds and unpaired ends of every left primer; tests hold them against all structures of short strings."""
    p = checks.with_structures(panel(spark, sf_dir).select("pair_id", F.col("primer1").alias("primer")))
    return rules.records(p, *checks.structure_checks("pair_id")).select("target", "rule", "value", "severity")


#: Narrower than the application's own limits: every pair that passes is scanned for dimers.
_NARROW = limits("qpcr_sybr", {"length": (20, 20), "TH-01": (59.7, 60.3), "product": (100, 140)})


@query(None)
def designed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked primer pairs of every contig, within narrow limits."""
    targets = contigs(spark, sf_dir).select(F.col("chrom").alias("target_id"), "seq")
    return design.design(targets, _NARROW)["pairs"]


from strandlake import ranking_queries, rule_queries, search_queries, structure_queries, surface_queries  # noqa: E402, F401  (add their own to QUERIES)
