"""Queries of the distributed rankings: bootstrap intervals, Pareto layers and greedy pools, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators import pools, ranking, sampling
from strandlake.queries import _RC, CONTIGS, PANEL, panel, query, table

RESAMPLES, SEED = 200, 810_081
_TIMES = "CASE " + " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(sampling.POISSON)) + f" ELSE {sampling.MOST_TIMES} END"


@query(f"""WITH d AS (SELECT o_orderpriority AS priority, CAST(o_totalprice AS DOUBLE) AS x, o_orderkey AS id, unnest(range(0, {-(-RESAMPLES // 4)})) AS d FROM orders),
h AS (SELECT priority, x, d, md5(concat('{SEED}:', id, ':', d)) AS h FROM d),
u AS (SELECT priority, x, d * 4 + k AS b, CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (SELECT *, unnest(range(0, 4)) AS k FROM h)),
m AS (SELECT priority, b, sum(w * x) / nullif(sum(w), 0) AS m FROM (SELECT priority, b, x, {_TIMES} AS w FROM u WHERE b < {RESAMPLES}) GROUP BY priority, b),
q AS (SELECT priority, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY priority)
SELECT o_orderpriority AS priority, count(*) AS n, round(avg(CAST(o_totalprice AS DOUBLE)), 4) AS mean, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high FROM orders JOIN q ON q.priority = o_orderpriority GROUP BY o_orderpriority""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mean price of each priority's orders may be."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    found = sampling.bootstrap_mean(orders, ["priority"], "o_totalprice", ["o_orderkey"], RESAMPLES, SEED)
    return found.select("priority", "n", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


#: The layer of a row is the longest chain of rows that ends with it, each dominating the next.
@query("""WITH RECURSIVE p AS (SELECT p_brand AS brand, p_partkey AS id, CAST(p_size AS DOUBLE) AS a, CAST(p_retailprice AS DOUBLE) AS b, CAST(length(p_type) AS DOUBLE) AS c FROM part),
e AS (SELECT x.brand, x.id AS better, y.id AS worse FROM p x JOIN p y ON x.brand = y.brand AND x.a <= y.a AND x.b <= y.b AND x.c <= y.c AND (x.a < y.a OR x.b < y.b OR x.c < y.c)),
r AS (SELECT brand, id, 1 AS layer FROM p UNION SELECT r.brand, e.worse, r.layer + 1 FROM r JOIN e ON e.brand = r.brand AND e.better = r.id)
SELECT brand, id, CAST(least(max(layer), 51) AS INTEGER) AS layer FROM r GROUP BY brand, id""")
def pareto_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand in layers by size, price and the length of their type."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"), F.length("p_type").alias("c"))
    return ranking.pareto(part, ["brand"], ["a", "b", "c"]).select("brand", "id", "layer")


PLACES, PAIRS_A_POOL, END = 8, 50, 3


#: One pair after another, each against the list of what its pool has taken.
@query(f"""WITH RECURSIVE {CONTIGS}, {PANEL}, n AS (SELECT doc_id // {PAIRS_A_POOL} AS pool, pair_id, primer1, primer2, length(replace(replace(primer1 || primer2, 'A', ''), 'T', '')) AS gc FROM panel JOIN contig ON chrom = pair_id),
o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY abs(gc - 20), pair_id) AS k FROM n),
x AS (SELECT a.pool, a.k, list(b.pair_id) AS foes FROM o a JOIN o b ON a.pool = b.pool AND list_has_any([right(a.primer1, {END}), right(a.primer2, {END})], [{_RC(f"right(b.primer1, {END})")}, {_RC(f"right(b.primer2, {END})")}]) GROUP BY a.pool, a.k),
r AS (SELECT pool, 0::BIGINT AS k, []::VARCHAR[] AS taken FROM o GROUP BY pool UNION ALL
  SELECT r.pool, o.k, CASE WHEN list_has_any(coalesce(foes, []), r.taken || [o.pair_id]) THEN r.taken ELSE r.taken || [o.pair_id] END FROM r JOIN o ON o.pool = r.pool AND o.k = r.k + 1 LEFT JOIN x ON x.pool = o.pool AND x.k = o.k),
t AS (SELECT pool, max_by(taken, k) AS taken FROM r GROUP BY pool)
SELECT pool, pair_id, CAST(abs(gc - 20) AS INTEGER) AS rank, list_contains(taken[1:{PLACES}], pair_id) AS in_pool FROM o JOIN t USING (pool)""")
def greedy_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of pairs, the most balanced first, no two of which have 3' ends that pair with each other."""
    pairs = panel(spark, sf_dir).withColumn("pool", F.floor(F.substring("pair_id", 2, 20).cast("long") / PAIRS_A_POOL))
    nodes = pairs.select("pool", F.col("pair_id").alias("id"), F.abs(dna.gc_count("primer1") + dna.gc_count("primer2") - 20).cast("int").alias("rank"))
    ends = pairs.select("pool", "pair_id", F.explode(F.array("primer1", "primer2")).alias("primer")).select("pool", "pair_id", F.right("primer", F.lit(END)).alias("end"))
    met = ends.select("pool", F.col("pair_id").alias("a"), "end").join(ends.select("pool", F.col("pair_id").alias("b"), dna.reverse_complement("end").alias("end")), ["pool", "end"])
    return pools.pooled(nodes, met.select("pool", "a", "b"), ["pool"], PLACES).select("pool", F.col("id").alias("pair_id"), "rank", "in_pool")
