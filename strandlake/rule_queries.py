"""Queries of the rule families over the derived panel, each with SQL that says every rule in its own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import queries as q
from strandlake.functions.parameters import HYBRID, HYBRID_START
from strandlake.operators import products, ranking, rules, search, sets
from strandlake.plans import checks, design, mains, multiplex, reports, specificity
from strandlake.plans.profiles import limits

_FOUR_G = r"G{3,}\w{1,7}G{3,}\w{1,7}G{3,}\w{1,7}G{3,}"
_G4 = lambda s: f"(regexp_matches({s}, '{_FOUR_G}') OR regexp_matches({q._RC(s)}, '{_FOUR_G}'))"
_WITH = f"WITH {q.CONTIGS}, {q.PANEL}"


def _levels(**each: tuple[str, str]) -> str:
    """A list of (rule, severity) structs from what fails and what warns."""
    return "[" + ", ".join(f"{{'rule': '{rule.replace('_', '-')}', 'severity': CASE WHEN {fail} THEN 'FAIL' WHEN {warn} THEN 'WARN' ELSE 'INFO' END}}" for rule, (fail, warn) in each.items()) + "]"


_PRIMER = _levels(
    SEQ_01=("NOT regexp_full_match(s, '[ACGT]+')", "false"),
    SEQ_02=("length(s) NOT BETWEEN 15 AND 35", "length(s) NOT BETWEEN 18 AND 30"),
    SEQ_03=("false", "false"),
    CMP_05=("h < 1.2", "h < 1.5"),
    CMP_06=(_G4("s"), "false"),
    CMP_07=("false", "h3 - 310.15 * s3 / 1000 < h5 - 310.15 * s5 / 1000 - 2.0"),
    CMP_08=("false", "right(s, 1) = 'T'"),
    TH_01=("t NOT BETWEEN 55 AND 65", "t NOT BETWEEN 58 AND 62"),
    TH_02=("abs(tm - tmv) > 4", "abs(tm - tmv) > 2"),
    TH_03=("theta < 0.80", "theta < 0.95"),
    TH_04=("tail < -11", "tail NOT BETWEEN -9 AND -6"),
    TH_05=("false", "false"),
)


#: Every rule of every primer of the panel.
_PRIMER_RULES = f"""{_WITH}, primers AS (SELECT DISTINCT unnest([primer1, primer2]) AS primer FROM panel), {q._THERMO},
a AS (SELECT primer, dh AS h5, ds AS s5 FROM (SELECT primer, {q._duplex_sql('left(primer, 10)')} FROM primers)), b AS (SELECT primer, dh AS h3, ds AS s3 FROM (SELECT primer, {q._duplex_sql('right(primer, 10)')} FROM primers)),
v AS (SELECT *, primer AS s, tm - 273.15 AS t, {q.entropy_sql('primer')} AS h, 1 - 1 / (1 + exp(-(1000 * dh - 333.15 * dse) / (1.9872 * 333.15)) * c) AS theta,
  {q.steps_sql('right(primer, 5)', 0)} - 310.15 * {q.steps_sql('right(primer, 5)', 1)} / 1000 AS tail FROM e JOIN a USING (primer) JOIN b USING (primer)),
r AS (SELECT primer, unnest({_PRIMER}) AS x FROM v),
ends AS (SELECT unnest([pair_id || '_F', pair_id || '_R']) AS target, unnest([primer1, primer2]) AS primer FROM panel),
told AS (SELECT target, x.rule AS rule, x.severity AS severity FROM ends JOIN r USING (primer))"""


def panel_primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, primer: both primers of every pair."""
    end = lambda tag, c: F.struct(F.concat("pair_id", F.lit(tag)).alias("target"), F.col(c).alias("primer"))
    return q.panel(spark, sf_dir).select(F.inline(F.array(end("_F", "primer1"), end("_R", "primer2"))))


@q.query(f"{_PRIMER_RULES} SELECT * FROM told")
def primer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-01..03, CMP-05..08 and TH-01..05 of every primer."""
    return rules.records(panel_primers(spark, sf_dir), listed=checks.primer_checks("primer", "target")).select("target", "rule", "severity")


@q.query(f"""{_PRIMER_RULES} SELECT target, CASE WHEN bool_or(severity = 'FAIL') THEN 'FAIL' WHEN bool_or(severity = 'WARN') THEN 'WARN' ELSE 'PASS' END AS verdict,
count(*) FILTER (severity = 'WARN') AS n_warn, count(*) FILTER (severity = 'FAIL') AS n_fail FROM told GROUP BY target""")
def primer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of all rules of every primer."""
    return rules.verdicts(rules.records(panel_primers(spark, sf_dir), listed=checks.primer_checks("primer", "target")))


_PAIR = _levels(
    PAIR_01=("abs(f - r) > 5", "abs(f - r) > 2"),
    PAIR_02=("n NOT BETWEEN 60 AND 200", "n NOT BETWEEN 74 AND 186"),
    PAIR_03=("n - 40 < 0", "n - 40 < 10"),
    PAIR_04=("false", "p - greatest(f, r) > 30"),
    AMP_01=("w > 0.85", "gc NOT BETWEEN 0.35 AND 0.65 OR w > 0.75"),
    AMP_03=("false", f"h < 1.5 OR {_G4('a')}"),
    TH_07=("false", "abs(0.3 * least(f, r) + 0.7 * p - 14.9 - 60) > 5"),
    CT_01=("n > 100", "false"),
    CT_02=("false", "false"),
)


@q.query(f"""{_WITH}, x AS (SELECT pair_id, primer1, primer2, substr(seq, 12, 177) AS a FROM panel JOIN contig ON chrom = pair_id), primers AS (SELECT DISTINCT unnest([primer1, primer2, a]) AS primer FROM x), {q._THERMO},
v AS (SELECT pair_id, a, length(a) AS n, i.tm - 273.15 AS f, j.tm - 273.15 AS r, k.tm - 273.15 AS p, length(replace(replace(a, 'A', ''), 'T', '')) / CAST(length(a) AS DOUBLE) AS gc, {q.entropy_sql('a')} AS h,
  list_max([length(replace(replace(substr(a, z, 50), 'A', ''), 'T', '')) FOR z IN range(1, length(a) - 48)]) / 50.0 AS w FROM x JOIN e i ON i.primer = primer1 JOIN e j ON j.primer = primer2 JOIN e k ON k.primer = a),
r AS (SELECT pair_id, unnest({_PAIR}) AS x FROM v) SELECT pair_id AS target, x.rule AS rule, x.severity AS severity FROM r""")
def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAIR-01..04, AMP-01, AMP-03, TH-07, CT-01 and CT-02 of every pair and its product."""
    seqs = q.contigs(spark, sf_dir).select(F.col("chrom").alias("pair_id"), F.substring("seq", 12, 177).alias("amplicon"))
    found = rules.records(q.panel(spark, sf_dir).join(seqs, "pair_id"), listed=checks.pair_checks("pair_id", ctdna=True))
    return found.select("target", "rule", "severity")


_RAW = "CASE WHEN doc_id % 3 = 0 THEN lower(left(seq, 60)) || substr(seq, 61) WHEN doc_id % 3 = 1 THEN left(seq, 100) || 'NNN' || substr(seq, 104) ELSE left(seq, 170) || 'n' || substr(seq, 172) END"


@q.query(f"""{_WITH}, x AS (SELECT pair_id, primer1, primer2, {_RAW} AS raw FROM panel JOIN contig ON chrom = pair_id), y AS (SELECT *, substr(raw, 12, 20) AS l, substr(raw, 169, 20) AS r, substr(raw, 12, 177) AS w FROM x),
u AS (SELECT pair_id, unnest([{{'rule': 'SEQ-04', 'severity': CASE WHEN regexp_matches(l || r, '[Nn]') THEN 'FAIL' WHEN regexp_matches(w, '[Nnacgt]') THEN 'WARN' ELSE 'INFO' END}}, {{'rule': 'SEQ-05', 'severity': CASE WHEN upper(l) = primer1 AND {q._RC('upper(r)')} = primer2 THEN 'INFO' ELSE 'FAIL' END}}, {{'rule': 'SEQ-06', 'severity': 'INFO'}}]) AS x FROM y)
SELECT pair_id AS target, x.rule AS rule, x.severity AS severity FROM u""")
def template_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-04..06 of every pair on its template as it is."""
    c = q.contigs(spark, sf_dir)
    s, k = F.col("seq"), F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lower(F.substring(s, 1, 60)), F.substring(s, 61, 300))).when(k == 1, F.concat(F.substring(s, 1, 100), F.lit("NNN"), F.substring(s, 104, 300))).otherwise(F.concat(F.substring(s, 1, 170), F.lit("n"), F.substring(s, 172, 300)))
    given = q.panel(spark, sf_dir).join(c.select(F.col("chrom").alias("pair_id"), raw.alias("raw")), "pair_id").withColumns({"start": F.lit(11), "end": F.lit(188)})
    return rules.records(given, *checks.template_checks("pair_id")).select("target", "rule", "severity")


@q.query(f"""{_WITH}, primers AS (SELECT DISTINCT unnest([primer1, primer2]) AS primer FROM panel), {q._THERMO}, w AS (SELECT primer, tm - 273.15 AS t FROM e)
SELECT count(*) AS n_primers, round(min(t), 4) AS tm_min, round(max(t), 4) AS tm_max, round(max(t) - min(t), 4) AS tm_range, CASE WHEN max(t) - min(t) > 5 THEN 'FAIL' WHEN max(t) - min(t) > 3 THEN 'WARN' ELSE 'INFO' END AS mpx01 FROM w""")
def tm_homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MPX-01 of the whole panel."""
    primers = q.panel(spark, sf_dir).select(F.explode(F.array("primer1", "primer2")).alias("primer"))
    return multiplex.tm_homogeneity(primers).select("n_primers", *[F.round(c, 4).alias(c) for c in ("tm_min", "tm_max", "tm_range")], "mpx01")


_LENGTH = "('0x' || left(md5(concat(doc_id, 'n')), 4))::BIGINT % 3000"


@q.query(f"""WITH p AS (SELECT doc_id % 50 AS panel_id, {_LENGTH} AS n FROM documents), g AS (SELECT panel_id, n - lag(n) OVER (PARTITION BY panel_id ORDER BY n) AS g FROM p)
SELECT panel_id, min(g) AS min_gap, count(*) FILTER (g < 10) AS n_conflicts, CASE WHEN min(g) < 10 THEN 'WARN' ELSE 'INFO' END AS mpx03 FROM g GROUP BY panel_id""")
def size_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MPX-03 of fifty panels."""
    h = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("n")).cast("binary")), 1, 4), 16, 10).cast("long") % 3000
    p = q.table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("panel_id"), h.alias("expected_length"))
    return multiplex.size_separation(p)


@q.query("""WITH x AS (SELECT 'd' || doc_id AS pair_id, doc_id % 3 AS ct, (doc_id % 5 = 0)::INT AS ga FROM documents)
SELECT pair_id, CAST(ct AS BIGINT) AS n_ct, CAST(ga AS BIGINT) AS n_ga, CASE WHEN ga > 0 THEN 'FAIL' WHEN ct > 1 THEN 'WARN' ELSE 'INFO' END AS bis04 FROM x WHERE ct + ga > 0""")
def conversion_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIS-04 from products on the two conversions."""
    d = q.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("pair_id"), "doc_id")
    ct = d.where("doc_id % 3 > 0").select("pair_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 3)).alias("k"))
    return checks.strand_products(ct, d.where("doc_id % 5 = 0"))


_SAID = lambda x: f"CASE {x} WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END"


@q.query(f"""WITH x AS (SELECT 'd' || doc_id AS pair_id, doc_id % 3 AS a, CASE WHEN doc_id % 2 = 0 THEN doc_id * 7 % 5 % 3 ELSE 0 END AS b, CAST(doc_id % 4 AS BIGINT) AS n_off, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 6 ELSE 0 END AS BIGINT) AS n_flags, doc_id % 7 / 8.0 AS score FROM documents)
SELECT pair_id, {_SAID('greatest(a, b)')} AS final_verdict, n_flags, row_number() OVER (ORDER BY greatest(a, b), n_off, n_flags, score, pair_id) AS final_rank FROM x""")
def final_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by verdict, off-targets, variant flags and score, over all pairs."""
    d = F.col("doc_id")
    said = lambda x: F.when(x == 0, "PASS").when(x == 1, "WARN").otherwise("FAIL")
    p = q.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), d.cast("string")).alias("pair_id"))
    pairs = p.select("pair_id", said(d % 3).alias("verdict"), (d % 4).alias("n_off"), (d % 7 / 8.0).alias("score"))
    flags = p.where("doc_id % 2 = 0").select("pair_id", said(d * 7 % 5 % 3).alias("verdict"), (d % 6).alias("n_flags"))
    return specificity.rerank(pairs, flags).select("pair_id", "final_verdict", "n_flags", F.col("final_rank").cast("long").alias("final_rank"))


@q.query(f"""{q._SITES}, s AS (SELECT primer, instr(right(mask, 3), 'X') = 0 AS ok FROM bindings WHERE regexp_matches(chrom, '[05]$')), t AS (SELECT DISTINCT unnest([primer1, primer2]) AS primer FROM panel)
SELECT t.primer, count(ok) AS n_sites, count(*) FILTER (ok) AS n_anchored, CASE WHEN count(*) FILTER (ok) > 0 THEN 'FAIL' WHEN count(ok) > 0 THEN 'WARN' ELSE 'INFO' END AS spc08 FROM t LEFT JOIN s ON s.primer = t.primer GROUP BY t.primer""")
def contaminant_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPC-08: sites of the primers on contaminating contigs, here those whose names end in 0 or 5."""
    p = q.panel(spark, sf_dir)
    return checks.contig_checks(q.bindings(spark, sf_dir).where(F.col("chrom").rlike("[05]$")), p.select(F.explode(F.array("primer1", "primer2")).alias("primer")))


@q.query(f"""{q._SITES}, a AS (SELECT chrom, 5 + doc_id % 40 AS a, 40 + doc_id % 120 AS b FROM contig), h AS (SELECT DISTINCT primer, x.chrom, s, e, strand FROM bindings x JOIN a ON a.chrom = x.chrom AND x.s < a.b AND x.e > a.a)
SELECT primer, count(*) AS n_overlapping FROM h GROUP BY primer""")
def annotated_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPC-06, SPC-07: sites on annotated intervals."""
    d = F.col("doc_id")
    known = q.contigs(spark, sf_dir).select("chrom", (5 + d % 40).alias("start"), (40 + d % 120).alias("end"))
    return specificity.annotated(q.bindings(spark, sf_dir), known)


_HYBRID = lambda k: f"list_sum([CASE {' '.join(f'WHEN x = {chr(39)}{s}{chr(39)} THEN {v[k]}' for s, v in HYBRID.items())} END FOR x IN [substr(primer, i, 2) FOR i IN range(1, length(primer))]]) + {HYBRID_START[k]}"


@q.query(f"""{_WITH}, primers AS (SELECT DISTINCT primer2 AS primer FROM panel), e AS (SELECT primer, CAST({_HYBRID(0)} AS DOUBLE) AS dh, CAST({_HYBRID(1)} AS DOUBLE) AS ds FROM primers)
SELECT primer, round(1000 * dh / (ds + 1.9872 * ln(2e-7 / 4)) - 273.15, 3) AS tm_c FROM e""")
def hybrid_tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-05: Tm on RNA of every right primer."""
    p = q.panel(spark, sf_dir).select(F.col("primer2").alias("primer")).distinct()
    found = rules.records(p, checks.hybrid_check("primer"))
    return found.select(F.col("target").alias("primer"), F.get_json_object("value", "$.tm_c").cast("double").alias("tm_c"))


@q.query("""WITH x AS (SELECT doc_id, (['TP53', 'tet2', 'ABC1', 'EGFR', 'Jak2'])[1 + doc_id % 5] AS gene FROM documents) SELECT CAST(doc_id AS VARCHAR) AS target, gene, CASE WHEN gene IN ('TP53', 'tet2', 'Jak2') THEN 'WARN' ELSE 'INFO' END AS ct06 FROM x""")
def gene_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CT-06 of a gene for each document."""
    names = F.array(*[F.lit(x) for x in ("TP53", "tet2", "ABC1", "EGFR", "Jak2")])
    d = q.table(spark, sf_dir, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 5).cast("int")).alias("gene"))
    found = rules.records(d, checks.gene_check("doc_id"))
    return found.select("target", F.get_json_object("value", "$.gene").alias("gene"), F.col("severity").alias("ct06"))


_PLACED = limits(given={"length": (18, 20), "REGION": (20, 220)})


@q.query(f"""WITH {q.CONTIGS}, t AS (SELECT chrom, doc_id, CASE WHEN doc_id % 4 = 0 THEN left(seq, 59) || 'N' || substr(seq, 61) ELSE seq END AS seq FROM contig), v AS (SELECT chrom, doc_id % 200 AS a, doc_id % 200 + 1 + doc_id % 3 AS b FROM contig),
w AS (SELECT chrom, s, s + n AS e, substr(seq, s + 1, n) AS x FROM (SELECT chrom, seq, unnest(range(0, length(seq))) AS s FROM t), (SELECT unnest([18, 19, 20]) AS n) WHERE s + n <= length(seq)),
b AS (SELECT *, unnest(['F', 'R']) AS o FROM w),
r AS (SELECT b.chrom, o, CASE WHEN s < 20 OR e > 220 THEN 'REGION' WHEN contains(x, 'N') THEN 'SEQ-04' WHEN v.a < e AND v.b > s AND (CASE WHEN o = 'F' THEN v.b > e - 5 ELSE v.a < s + 5 END) THEN 'VAR-02' WHEN v.a < e AND v.b > s THEN 'VAR-01' ELSE 'ok' END AS rule FROM b JOIN v ON v.chrom = b.chrom)
SELECT chrom AS target_id, o AS orientation, rule, count(*) AS n FROM r GROUP BY ALL""")
def placed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every contig by what is wrong with their place: the region, letters, variants."""
    c, d = q.contigs(spark, sf_dir), F.col("doc_id")
    seq = F.when(d % 4 == 0, F.concat(F.substring("seq", 1, 59), F.lit("N"), F.substring("seq", 61, 300))).otherwise(F.col("seq"))
    targets = c.select(F.col("chrom").alias("target_id"), seq.alias("seq"))
    known = c.select(F.col("chrom").alias("target_id"), (d % 200).alias("start"), (d % 200 + 1 + d % 3).alias("end"))
    found = design.placed_windows(targets, _PLACED, known)
    return found.groupBy("target_id", "orientation", F.coalesce("failed.rule", F.lit("ok")).alias("rule")).agg(F.count("*").alias("n"))


@q.query(f"""{_WITH}, primers AS (SELECT DISTINCT primer1 AS primer FROM panel),
windows AS (SELECT chrom, n, s, substr(seq, s + 1, 20) AS site FROM (SELECT chrom, seq, length(seq) AS n, unnest(range(0, length(seq) - 19)) AS s FROM contig)),
oriented AS (SELECT chrom, s, s AS scan, '+' AS strand, site AS o FROM windows UNION ALL SELECT chrom, s, n - s - 20, '-', {q._RC('site')} FROM windows)
SELECT primer, chrom, CAST(s AS BIGINT) AS start, strand, CAST(hamming(primer, o) AS INTEGER) AS mismatches, CAST(scan AS BIGINT) AS scan_start, right(primer, 3) = right(o, 3) AS anchored FROM oriented JOIN primers ON hamming(primer, o) <= 2""")
def contig_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the left primers with at most two mismatches, each strand in its own coordinates."""
    found = search.contig_sites(q.contigs(spark, sf_dir), q.panel(spark, sf_dir).select(F.col("primer1").alias("primer")))
    return found.select("primer", "chrom", "start", "strand", "mismatches", "scan_start", "anchored")


@q.query(f"""{q._SITES}, b AS (SELECT primer, chrom, s, strand, mm, instr(right(mask, 12), 'X') = 0 AS ok FROM bindings)
SELECT primer, chrom, CAST(s AS BIGINT) AS start, strand, CAST(mm AS INTEGER) AS mismatches, CAST(row_number() OVER (PARTITION BY primer ORDER BY mm, ok DESC, chrom, s, strand) AS INTEGER) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY primer ORDER BY mm, ok DESC, chrom, s, strand) <= 40""")
def shown_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty sites of each primer for a reader."""
    return specificity.shown_sites(q.bindings(spark, sf_dir)).select("primer", "chrom", "start", "strand", "mismatches", "rank")


@q.query(f"""{q._SITES}, a AS (SELECT chrom, 5 + doc_id % 40 AS a, 60 + doc_id % 120 AS b, concat('psg', doc_id % 30) AS name FROM contig),
h AS (SELECT DISTINCT primer, name FROM bindings x JOIN a ON a.chrom = x.chrom AND x.s < a.b AND x.e > a.a)
SELECT primer, count(*) AS n_names, array_to_string(list_slice(list(name ORDER BY name), 1, 10), ',') AS names FROM h GROUP BY primer""")
def annotation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the annotations under each primer's sites, the first ten of them spelled out."""
    d = F.col("doc_id")
    known = q.contigs(spark, sf_dir).select("chrom", (5 + d % 40).alias("start"), (60 + d % 120).alias("end"), F.concat(F.lit("psg"), (d % 30).cast("string")).alias("name"))
    return specificity.annotation_names(q.bindings(spark, sf_dir), known).select("primer", "n_names", F.array_join("names", ",").alias("names"))


_SOFT = "CASE WHEN doc_id % 3 = 0 THEN lower(left(seq, 60)) || substr(seq, 61) ELSE seq END"
_TEMPLATE = _levels(
    SEQ_04=("regexp_matches(l || r2, '[Nn]')", "regexp_matches(w2, '[Nnacgt]')"),
    SEQ_05=(f"NOT (upper(l) = primer1 AND {q._RC('upper(r2)')} = primer2)", "false"),
    SEQ_06=("false", "raw IS NULL"),
)


@q.query(f"""{_WITH}, x AS (SELECT pair_id, primer1, primer2, {_SOFT} AS raw, substr(seq, 12, 177) AS a FROM panel JOIN contig ON chrom = pair_id), primers AS (SELECT DISTINCT unnest([primer1, primer2, a]) AS primer FROM x), {q._THERMO},
a5 AS (SELECT primer, dh AS h5, ds AS s5 FROM (SELECT primer, {q._duplex_sql('left(primer, 10)')} FROM primers)), b3 AS (SELECT primer, dh AS h3, ds AS s3 FROM (SELECT primer, {q._duplex_sql('right(primer, 10)')} FROM primers)),
v AS (SELECT *, primer AS s, tm - 273.15 AS t, {q.entropy_sql('primer')} AS h, 1 - 1 / (1 + exp(-(1000 * dh - 333.15 * dse) / (1.9872 * 333.15)) * c) AS theta,
  {q.steps_sql('right(primer, 5)', 0)} - 310.15 * {q.steps_sql('right(primer, 5)', 1)} / 1000 AS tail FROM e JOIN a5 USING (primer) JOIN b3 USING (primer)),
one AS (SELECT primer, unnest({_PRIMER}) AS x FROM v),
two AS (SELECT pair_id, a, length(a) AS n, i.tm - 273.15 AS f, j.tm - 273.15 AS r, k.tm - 273.15 AS p, length(replace(replace(a, 'A', ''), 'T', '')) / CAST(length(a) AS DOUBLE) AS gc, {q.entropy_sql('a')} AS h,
  list_max([length(replace(replace(substr(a, z, 50), 'A', ''), 'T', '')) FOR z IN range(1, length(a) - 48)]) / 50.0 AS w FROM x JOIN e i ON i.primer = primer1 JOIN e j ON j.primer = primer2 JOIN e k ON k.primer = a),
three AS (SELECT *, substr(raw, 12, 20) AS l, substr(raw, 169, 20) AS r2, substr(raw, 12, 177) AS w2 FROM x),
g AS (SELECT pair_id, x FROM panel JOIN one ON one.primer = primer1 UNION ALL SELECT pair_id, x FROM panel JOIN one ON one.primer = primer2 UNION ALL SELECT pair_id, unnest({_PAIR}) FROM two UNION ALL SELECT pair_id, unnest({_TEMPLATE}) FROM three)
SELECT pair_id, CASE max(CASE x.severity WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS verdict, count(*) FILTER (x.severity = 'WARN') AS n_warn, count(*) FILTER (x.severity = 'FAIL') AS n_fail FROM g GROUP BY pair_id""")
def sequence_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over all rules of primers, pairs, products and templates that need no folding."""
    s = F.col("seq")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lower(F.substring(s, 1, 60)), F.substring(s, 61, 300))).otherwise(s)
    given = q.panel(spark, sf_dir).join(q.contigs(spark, sf_dir).select(F.col("chrom").alias("pair_id"), raw.alias("raw")), "pair_id").withColumns({"start": F.lit(11), "end": F.lit(188)})
    return mains.sequence_qc(given, ctdna=True, structures=False)["verdicts"]


@q.query(f"""{q._SITES}, c AS (SELECT a.chrom, a.s AS start, b.e AS "end", a.primer AS l, b.primer AS r, a.mm + b.mm AS mm, concat(least(a.primer, b.primer), '/', greatest(a.primer, b.primer)) AS combo
FROM bindings a JOIN bindings b ON a.strand = '+' AND b.strand = '-' AND a.chrom = b.chrom AND b.s >= a.e AND b.e - a.s BETWEEN 50 AND 200),
pp AS (SELECT a.pair_id, a.primer1, b.primer2 FROM panel a JOIN panel b ON b.pair_id = 'd' || (substr(a.pair_id, 2)::BIGINT + 1)),
d AS (SELECT DISTINCT concat(least(primer1, primer2), '/', greatest(primer1, primer2)) AS combo FROM pp), o AS (SELECT DISTINCT pair_id, unnest([primer1, primer2]) AS primer FROM pp)
SELECT x.pair_id AS left_pair, y.pair_id AS right_pair, count(*) AS n, CAST(min(mm) AS INTEGER) AS least FROM c JOIN o x ON x.primer = l JOIN o y ON y.primer = r WHERE x.pair_id <> y.pair_id AND combo NOT IN (SELECT combo FROM d) GROUP BY ALL""")
def multiplex_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross products that no pair designs, dealt back to the pairs that own their primers; each pair has the next one's right
    primer here, so that most products are cross ones."""
    every = q.panel(spark, sf_dir).withColumn("panel_id", F.lit("all"))
    moved = every.select(F.concat(F.lit("d"), (F.substring("pair_id", 2, 20).cast("long") - 1).cast("string")).alias("pair_id"), "primer2")
    p = every.drop("primer2").join(moved, "pair_id")
    found = mains.multiplex_qc(p, q.bindings(spark, sf_dir), 50, 200, dimers=False)["slots"]
    return found.groupBy("left_pair", "right_pair").agg(F.count("*").alias("n"), F.min("mismatches").cast("int").alias("least"))


@q.query(f"""{_WITH}, x AS (SELECT pair_id, primer1 AS p, doc_id FROM panel JOIN contig ON chrom = pair_id)
SELECT pair_id, p || CASE WHEN doc_id % 5 = 0 THEN 'X' ELSE '' END AS dna, CAST(2 AS INTEGER) AS n_lna, '3,8' AS lna, '56-FAM' AS tags,
  array_to_string([w FOR w IN [CASE WHEN doc_id % 4 = 0 THEN 'dangling +' END, CASE WHEN doc_id % 5 = 0 THEN 'unpaired /' END, CASE WHEN doc_id % 5 = 0 THEN 'other letters' END] IF w IS NOT NULL], ',') AS warnings FROM x""")
def modified_oligos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written of oligos with tags and LNA bases."""
    d = q.contigs(spark, sf_dir).select(F.col("chrom").alias("pair_id"), "doc_id")
    p, k = F.col("primer1"), F.col("doc_id")
    raw = F.concat(F.lit("/56-FAM/"), F.substring(p, 1, 3), F.lit(" +"), F.lower(F.substring(p, 4, 5)), F.lit("+"), F.substring(p, 9, 20), F.when(k % 5 == 0, "x/").otherwise(""), F.when(k % 4 == 0, "+").otherwise(""))
    found = q.panel(spark, sf_dir).join(d, "pair_id").select("pair_id", checks.parsed_oligo(raw).alias("o"))
    return found.select("pair_id", "o.dna", "o.n_lna", F.array_join(F.transform("o.lna", lambda x: x.cast("string")), ",").alias("lna"), F.array_join("o.tags", ",").alias("tags"), F.array_join("o.warnings", ",").alias("warnings"))


@q.query("""SELECT o_custkey AS key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS rank, o_orderkey AS id, o_totalprice AS price FROM orders""")
def zipped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of one run row by row: orders by rank, and their prices."""
    o = q.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    ranked = ranking.top_k(o, ["key"], ["id"], 1 << 30)
    return sets.zipped(ranked.drop("price"), ranked, ["key"], "rank", ["id"]).select("key", "rank", "id", F.col("r_price").alias("price"))


@q.query(f"""{q._SITES}, r AS (SELECT pair_id, 'F' AS role, primer1 AS primer FROM panel UNION ALL SELECT pair_id, 'R', primer2 FROM panel)
SELECT pair_id, role, r.primer, chrom, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS end_exclusive, strand, CAST(mm AS INTEGER) AS mismatches, CAST(list_sum([CASE WHEN mask[i] = 'X' THEN 1 << (i - 1) ELSE 0 END FOR i IN range(1, 21)]) AS BIGINT) AS mask_bits, mask, site AS site_plus_strand
FROM r JOIN bindings ON bindings.primer = r.primer""")
def binding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair's sites in their fixed layout."""
    return reports.binding_table(q.panel(spark, sf_dir), q.bindings(spark, sf_dir))


@q.query(f"""{q._SITES}, {q._PRODUCTS} SELECT pair_id, chrom, CAST(start AS BIGINT) AS amplicon_start, CAST("end" AS BIGINT) AS amplicon_end_exclusive, CAST(length AS BIGINT) AS amplicon_length, CAST(start AS BIGINT) AS left_position, CAST("end" - 20 AS BIGINT) AS right_position, CAST(left_mismatches AS INTEGER) AS left_mismatches, CAST(right_mismatches AS INTEGER) AS right_mismatches, CAST(mismatches AS INTEGER) AS total_mismatches, left_mask, right_mask FROM products""")
def product_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair's products in their fixed layout."""
    return reports.product_table(products.pair_products(q.panel(spark, sf_dir), q.bindings(spark, sf_dir), 50, 200))
