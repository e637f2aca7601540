"""Table functions for SQL: k-mers and windows of contigs that come in parts, one after another.

    SELECT * FROM dna_kmers(TABLE(parts) PARTITION BY chrom ORDER BY (chunk_start), 12)

A function is called with the rows of one contig in order and holds no more than the last bases of the row before, so that a
k-mer or window over two parts is found. What it reads is the columns chrom and seq; parts follow each other without overlap.
PARTITION BY makes a contig one task's stream: for one contig over many tasks, search.kmers() cuts overlapping chunks instead.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

_STRICT = frozenset("ACGT")


class _Parts:
    """The last bases of what came before, and where they stand."""

    def __init__(self) -> None:
        self.tail, self.at = "", 0

    def joined(self, row: Row, keep: int) -> tuple[str, int]:
        """The row's bases behind those kept of the ones before, and the first one's place; keep bases stay for the next row."""
        seq, start = self.tail + (row["seq"] or "").upper(), self.at
        cut = max(0, len(seq) - keep)
        self.tail, self.at = seq[cut:], start + cut
        return seq, start


@udtf(returnType="chrom string, pos bigint, kmer string")
class Kmers:
    """Every strict k-mer with its place."""

    def __init__(self) -> None:
        self.parts = _Parts()

    def eval(self, row: Row, k: int) -> Iterator[tuple]:
        seq, start = self.parts.joined(row, k - 1)
        for i in range(len(seq) - k + 1):
            if _STRICT.issuperset(seq[i : i + k]):
                yield row["chrom"], start + i, seq[i : i + k]


@udtf(returnType="chrom string, start bigint, end bigint, n_gc int, n_strict int")
class Windows:
    """Windows of size bases, a step apart from the contig's start; what is behind the last whole window comes as a shorter one."""

    def __init__(self) -> None:
        self.parts, self.next, self.chrom, self.step = _Parts(), 0, None, 1

    def _told(self, start: int, window: str) -> tuple:
        gc = window.count("G") + window.count("C")
        return self.chrom, start, start + len(window), gc, gc + window.count("A") + window.count("T")

    def eval(self, row: Row, size: int, step: int) -> Iterator[tuple]:
        self.chrom, self.step = row["chrom"], step
        seq, start = self.parts.joined(row, max(size, step))
        while self.next + size <= start + len(seq):
            yield self._told(self.next, seq[self.next - start : self.next - start + size])
            self.next += step
        # What the next window needs stays, and nothing before it.
        cut = min(len(seq), self.next - start)
        self.parts.tail, self.parts.at = seq[cut:], start + cut

    def terminate(self) -> Iterator[tuple]:
        rest = self.parts.tail[max(0, self.next - self.parts.at) :]
        if rest:
            yield self._told(self.next, rest)


def register(spark: SparkSession) -> list[str]:
    spark.udtf.register("dna_kmers", Kmers)
    spark.udtf.register("dna_windows", Windows)
    return ["dna_kmers", "dna_windows"]
