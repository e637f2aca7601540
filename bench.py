"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

calibration is a fixed piece of work that reads no table: rounds on machines of different speed compare by their quotient with it.
Building an index and searching it are timed apart, as an index is written once and searched often.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

HEADLINE = [
    "strict_search", "long_contig_search", "sensitive_search", "paired_products", "panel_qc", "cross_products", "thermodynamics", "composition",
    "overlap_join", "merge_intervals", "skyline", "pareto_layers", "set_metrics", "bootstrap_interval", "variant_qc", "melting_profiles",
]
#: Rows that the calibration hashes and adds up.
CALIBRATION = 60_000_000


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work: Callable[[], None]) -> float:
    began = time.perf_counter()
    work()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from strandlake import search_queries
    from strandlake.operators import kmer_index
    from strandlake.queries import QUERIES

    spark.range(1).count()
    calibration = timed(lambda: run(spark.range(CALIBRATION).selectExpr("sum(xxhash64(id) % 1000) as s")))
    seconds = {name: timed(lambda name=name: run(QUERIES[name](spark, sf_dir))) for name in HEADLINE}
    index: list[kmer_index.Index] = []
    seconds["index_build"] = timed(lambda: index.append(search_queries.index_of_contigs(spark, sf_dir)))
    seconds["index_search"] = timed(lambda: run(kmer_index.indexed_search(spark, index[0], search_queries.primers(spark, sf_dir))))
    few = search_queries.primers(spark, sf_dir).limit(20)
    seconds["index_search_of_20"] = timed(lambda: run(kmer_index.indexed_search(spark, index[0], few)))
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "calibration": calibration, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
