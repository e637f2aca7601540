"""Tables that are computed once: reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import functools
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="strandlake-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where that is unset, a folder of our own in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or _own_folder()


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and kept in shared_folder()."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def many_tasks(df: DataFrame) -> int:
    """Tasks for rows that are few bytes and much work, which are not to be gathered into few tasks."""
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
