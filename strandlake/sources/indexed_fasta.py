"""A data source for FASTA files with an index of their records (.fai): a contig is read in ranges by many tasks.

    register(spark)
    spark.read.format("strandlake_fasta").option("names", "chr7,chr8").option("overlap", 63).load("genome.fa")

Rows are chunks as search.chunks() cuts them: the search takes them as they are. The index is a line for each record (name, bases,
offset of the first, bases in a line, bytes in a line); it says where in the file a range of bases lies, so a task seeks to its
own range and reads no other byte. The option names leaves other records' ranges out before any task starts. (It is an option
and no pushed filter, as a filter that one query pushes stays with the source for the next query over the same DataFrame.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "chrom string, chunk_start long, seq string, owned int"
#: Bases of a task's range and of a chunk, and bases of the next chunk that a chunk repeats.
RANGE, CHUNK, OVERLAP = 1 << 22, 1 << 12, 62
_UPPER = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Any byte but A, C, G and T is N.
_STRICT = bytes(c if chr(c) in "ACGT" else ord("N") for c in range(256))


@dataclass(frozen=True)
class Record:
    name: str
    bases: int
    offset: int
    line_bases: int
    line_bytes: int

    def at(self, base: int) -> int:
        """The byte at which a base stands."""
        return self.offset + base // self.line_bases * self.line_bytes + base % self.line_bases


@dataclass
class Range(InputPartition):
    record: Record
    start: int
    end: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_index(path: str) -> list[Record]:
    """The records of a .fai file. One that doesn't have five numbers in a line, or a line of no bases, is an error."""
    files, inner = _opened(path)
    with files.open_input_stream(inner) as f:
        lines = [line.split("\t") for line in f.read().decode().splitlines() if line.strip()]
    records = [Record(line[0], *map(int, line[1:5])) for line in lines]
    if bad := [r.name for r in records if r.bases and not 0 < r.line_bases <= r.line_bytes]:
        raise ValueError(f"{path}: no line length for {bad[0]}")
    return records


class IndexedFasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandlake_fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return IndexedFastaReader(self.options)


class IndexedFastaReader(DataSourceReader):
    """Options: path; index (path + ".fai"); names, with commas between (all); range, chunk and overlap in bases."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.index = options.get("index", self.path + ".fai")
        self.range, self.chunk, self.overlap = (int(options.get(k, d)) for k, d in (("range", RANGE), ("chunk", CHUNK), ("overlap", OVERLAP)))
        self.names = {x.strip() for x in options["names"].split(",")} if "names" in options else None

    def partitions(self) -> list[Range]:
        wanted = [r for r in read_index(self.index) if self.names is None or r.name in self.names]
        step = max(1, self.range // self.chunk) * self.chunk
        return [Range(r, at, min(at + step, r.bases)) for r in wanted for at in range(0, r.bases, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        record, start, end = partition.record, partition.start, partition.end
        last = min(end + self.overlap, record.bases)
        files, inner = _opened(self.path)
        with files.open_input_file(inner) as f:
            f.seek(record.at(start))
            raw = f.read(record.at(last - 1) + 1 - record.at(start))
        bases = raw.translate(_UPPER, b"\r\n").translate(_STRICT)
        if len(bases) != last - start:
            raise ValueError(f"{self.path}: {record.name} doesn't lie where its index says")
        places = list(range(start, end, self.chunk))
        seqs = [bases[p - start : p - start + self.chunk + self.overlap].decode() for p in places]
        owned = [min(self.chunk, end - p) for p in places]
        yield pa.RecordBatch.from_arrays([pa.array([record.name] * len(places)), pa.array(places, pa.int64()), pa.array(seqs), pa.array(owned, pa.int32())], names=["chrom", "chunk_start", "seq", "owned"])


def register(spark: SparkSession) -> None:
    """Makes the format known to spark.read."""
    spark.dataSource.register(IndexedFasta)
