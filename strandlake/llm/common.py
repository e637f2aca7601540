"""What the text operators share: reading tables, Arrow row maps and tables written to cut lineage."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="strandlake-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or _own_folder()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more: what came of them has been written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def arrow_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[tuple]], Iterable[tuple]], out_batch: int = 4096) -> DataFrame:
    """mapInArrow of a generator over a partition's rows; rows yields tuples of the schema.

    Spark bounds the incoming batches by bytes (spark.sql.execution.arrow.maxBytesPerBatch), out_batch the outgoing by rows.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one_by_one() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)

        held: list[tuple] = []
        for row in rows(one_by_one()):
            held.append(row)
            if len(held) >= out_batch:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else, alike in every locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once, however often then looks at it."""
    return F.get(F.transform(F.array(value), then), 0)
