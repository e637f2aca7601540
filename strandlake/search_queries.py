"""Queries of the searches over an index, by neighbourhoods and by pairs, with DuckDB SQL over all windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import kmer_index, products, search
from strandlake.operators.tables import shared_folder
from strandlake.queries import _RC, _SITES, ANCHOR, CONTIGS, MOST, PANEL, contigs, panel, query


def primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both primers of every pair."""
    return panel(spark, sf_dir).select(F.explode(F.array("primer1", "primer2")).alias("primer"))


def index_of_contigs(spark: SparkSession, sf_dir: str) -> kmer_index.Index:
    """The index of all contigs, written to the shared folder."""
    return kmer_index.write_index(contigs(spark, sf_dir), kmer_index.Index(f"{shared_folder(spark)}/kmers-{uuid.uuid4().hex}"))


@query(f"""{_SITES} SELECT primer, chrom, CAST(s AS BIGINT) AS start, strand, CAST(mm AS INTEGER) AS mismatches, o AS oriented, mask FROM bindings""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchored search of the whole panel over an index that was written before."""
    found = kmer_index.indexed_search(spark, index_of_contigs(spark, sf_dir), primers(spark, sf_dir), ANCHOR, MOST)
    return found.select("primer", "chrom", "start", "strand", "mismatches", "oriented", "mask")


#: Ten bases that differ in one place at most agree in their first or their last five.
@query(f"""WITH {CONTIGS}, {PANEL}, primers AS (SELECT DISTINCT unnest([primer1, primer2]) AS primer FROM panel),
parts AS (SELECT primer, unnest([left(x, 10), right(x, 10)]) AS part FROM (SELECT primer, unnest([primer, {_RC('primer')}]) AS x FROM primers)), uniq AS (SELECT DISTINCT part FROM parts),
words AS (SELECT w, count(*) AS n FROM (SELECT substr(seq, s + 1, 10) AS w FROM (SELECT seq, unnest(range(0, length(seq) - 9)) AS s FROM contig)) GROUP BY w),
near AS (SELECT part, w, n FROM uniq JOIN words ON left(part, 5) = left(w, 5) WHERE hamming(part, w) <= 1 UNION SELECT part, w, n FROM uniq JOIN words ON right(part, 5) = right(w, 5) WHERE hamming(part, w) <= 1),
sums AS (SELECT part, sum(n) AS n FROM near GROUP BY part)
SELECT primer, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_candidates FROM parts LEFT JOIN sums USING (part) GROUP BY primer""")
def search_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the unanchored search of every primer has to check."""
    return search.seed_cost(contigs(spark, sf_dir), primers(spark, sf_dir), MOST)


#: Both sides searched everywhere; what differs in three places at most of twenty agrees in one of four runs of five.
@query(f"""WITH {CONTIGS}, {PANEL}, primers AS (SELECT DISTINCT unnest([primer1, primer2]) AS primer FROM panel),
w AS (SELECT chrom, s, substr(seq, s + 1, 20) AS site FROM (SELECT chrom, seq, unnest(range(0, length(seq) - 19)) AS s FROM contig)),
o AS (SELECT chrom, s, '+' AS strand, site AS o FROM w UNION ALL SELECT chrom, s, '-', {_RC('site')} FROM w),
b AS ({" UNION ".join(f"SELECT primer, chrom, s, strand, hamming(primer, o) AS mm FROM o JOIN primers ON substr(primer, {a}, 5) = substr(o, {a}, 5) WHERE hamming(primer, o) <= {MOST}" for a in (1, 6, 11, 16))})
SELECT DISTINCT p.pair_id, x.chrom, CAST(x.s AS BIGINT) AS start, CAST(y.s + 20 - x.s AS BIGINT) AS length, x.primer AS left_primer, y.primer AS right_primer, CAST(x.mm + y.mm AS INTEGER) AS mismatches
FROM panel p JOIN b x ON x.strand = '+' AND x.primer IN (p.primer1, p.primer2) JOIN b y ON y.strand = '-' AND y.primer IN (p.primer1, p.primer2) AND x.chrom = y.chrom AND y.s >= x.s + 20 AND y.s + 20 - x.s BETWEEN 50 AND 200 AND x.primer <> y.primer""")
def paired_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of unanchored sites, where each pair's dearer primer is searched near the sites of its cheaper one only."""
    pairs = panel(spark, sf_dir)
    sites = search.paired_search(contigs(spark, sf_dir), pairs, MOST, 200)
    return products.pair_products(pairs, sites, 50, 200).select("pair_id", "chrom", "start", "length", "left_primer", "right_primer", "mismatches")
