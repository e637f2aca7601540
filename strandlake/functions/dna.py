"""Composition of DNA strings as Catalyst expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parameters import IUPAC

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: ColumnLike) -> Column:
    """Letters other than A, C, G, T stay as they are."""
    return F.reverse(F.translate(col(seq), "ACGT", "TGCA"))


def normalized(seq: ColumnLike) -> Column:
    """Upper case, without white space around; what isn't A, C, G, T, N becomes N."""
    return F.translate(F.upper(F.trim(col(seq))), "".join(k for k in IUPAC if k not in "ACGTN"), "N" * 10)


def is_strict(seq: ColumnLike) -> Column:
    return col(seq).rlike("^[ACGT]+$")


def letters(seq: ColumnLike) -> Column:
    return F.split(col(seq), "")


def count_of(seq: ColumnLike, pattern: str) -> Column:
    return F.regexp_count(col(seq), F.lit(pattern))


def gc_count(seq: ColumnLike) -> Column:
    return F.length(col(seq)) - F.length(F.translate(col(seq), "GC", ""))


def gc_fraction(seq: ColumnLike) -> Column:
    return gc_count(seq) / F.length(col(seq))


def gc_clamp(seq: ColumnLike, window: int = 5) -> Column:
    """G and C among the last bases."""
    return gc_count(F.right(col(seq), F.lit(window)))


def is_self_complementary(seq: ColumnLike) -> Column:
    return col(seq) == reverse_complement(seq)


def longest_homopolymer(seq: ColumnLike) -> Column:
    runs = F.regexp_extract_all(col(seq), F.lit("(A+|C+|G+|T+|N+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def max_repeat_units(seq: ColumnLike, unit: int) -> Column:
    """The most copies of a unit that follow each other, from any place on; 1 for strings without a repeat.

    Copies from a place on are counted by how long the string agrees with itself moved by the unit.
    """
    s = col(seq)
    same = F.transform(F.sequence(F.lit(1), F.length(s) - unit), lambda i: (F.substring(s, i, 1) == F.substring(s, i + unit, 1)).cast("int"))
    joined = F.array_join(same, "")
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(joined, F.lit("(1+)"), F.lit(1)), F.length)), F.lit(0))
    return F.when(F.length(s) <= unit, 1).otherwise(1 + F.floor(longest / unit).cast("int"))


def windows(seq: ColumnLike, size: int) -> Column:
    """All substrings of a size, in order; none where the string is shorter."""
    s = col(seq)
    return F.when(F.length(s) >= size, F.transform(F.sequence(F.lit(1), F.length(s) - size + 1), lambda i: F.substring(s, i, size))).otherwise(F.array().cast("array<string>"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def shannon_entropy(seq: ColumnLike, k: int = 1) -> Column:
    """Of the k-mers, in bits; 0 for shorter strings. Letters are counted by what is shorter without them; k-mers, which can overlap,
    are sorted once, and runs of equal ones counted. Both add up in the order of the k-mers."""
    s = col(seq)
    part = lambda n, total: F.when(n > 0, (n / total) * F.log2(n / total)).otherwise(0.0)

    def by_runs(parts: Column) -> Column:
        total = F.size(parts).cast("double")
        start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("h"))
        step = lambda s, x: F.when(s["last"] == x, F.struct(x.alias("last"), (s["run"] + 1).alias("run"), s["h"].alias("h"))).otherwise(F.struct(x.alias("last"), F.lit(1).alias("run"), (s["h"] + part(s["run"], total)).alias("h")))
        return -F.aggregate(parts, start, step, lambda s: s["h"] + part(s["run"], total))

    def by_letters(total: Column) -> Column:
        count = lambda x: total - F.length(F.replace(s, x, F.lit("")))
        return -F.aggregate(F.sort_array(F.array_distinct(letters(s))), F.lit(0.0), lambda h, x: h + _let(count(x), lambda n: part(n, total.cast("double"))))

    found = _let(F.length(s), by_letters) if k == 1 else _let(F.sort_array(windows(s, k)), by_runs)
    return F.when(F.length(s) >= k, found).otherwise(F.lit(0.0))


def degeneracy(seq: ColumnLike) -> Column:
    """How many strict sequences an IUPAC string stands for; null where a letter isn't IUPAC."""
    sizes = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (k, len(v))])
    return F.aggregate(F.transform(letters(F.upper(col(seq))), lambda b: F.try_element_at(sizes, b).cast("double")), F.lit(1.0), lambda n, x: n * x)


def degenerate_three_prime(seq: ColumnLike, window: int = 3) -> Column:
    return F.right(F.upper(col(seq)), F.lit(window)).rlike("[RYSWKMBDHVN]")


def has_g_quadruplex(seq: ColumnLike) -> Column:
    """Four runs of three or more G, one to seven letters between, on either strand."""
    pattern = r"G{3,}\w{1,7}G{3,}\w{1,7}G{3,}\w{1,7}G{3,}"
    return col(seq).rlike(pattern) | reverse_complement(seq).rlike(pattern)


def gc_window_max(seq: ColumnLike, size: int = 50) -> Column:
    """The highest GC fraction of any window; of the whole string where that is shorter. One walk, with a running count of what comes
    in and goes out; before the first whole window it can't be higher than in it."""
    marks = F.regexp_replace(F.translate(col(seq), "GC", "11"), "[^1]", "0")
    gone = F.left(F.concat(F.lit("0" * size), marks), F.length(marks))
    change = F.zip_with(letters(marks).cast("array<int>"), letters(gone).cast("array<int>"), lambda x, y: x - y)
    step = lambda s, x: F.struct((s["n"] + x).alias("n"), F.greatest(s["most"], s["n"] + x).alias("most"))
    most = F.aggregate(change, F.struct(F.lit(0).alias("n"), F.lit(0).alias("most")), step, lambda s: s["most"])
    return F.when(F.length(col(seq)) >= size, most / F.lit(float(size))).otherwise(gc_fraction(seq))


def cpg_count(seq: ColumnLike) -> Column:
    return count_of(seq, "CG")


def non_cpg_c(seq: ColumnLike) -> Column:
    return count_of(seq, "C(?!G)")


def nearest_cpg_to_three_prime(seq: ColumnLike) -> Column:
    """Bases behind the C of the last CG; null without one."""
    at = F.instr(F.reverse(col(seq)), "GC")
    return F.when(at > 0, at)


def bisulfite(seq: ColumnLike, strand: str = "CT") -> Column:
    """The converted genome: C to T of one strand, or G to A as the other's conversion reads."""
    return F.translate(col(seq), "Cc", "Tt") if strand == "CT" else F.translate(col(seq), "Gg", "Aa")


def chromosome(name: ColumnLike) -> Column:
    """Without a leading chr."""
    return F.regexp_replace(col(name), "^(?i)chr", "")


def grch38_alias(name: ColumnLike) -> Column:
    """chr1..chr22, chrX, chrY of an accession NC_0000nn.v or a plain name; null for anything else."""
    number = F.regexp_extract(col(name), r"^NC_0000(\d\d)\.\d+", 1)
    n = F.when(number != "", number.cast("int"))
    plain = F.regexp_extract(col(name), r"^(?:chr)?([1-9]|1\d|2[0-2]|X|Y)$", 1)
    by_number = F.when(n.between(1, 22), F.concat(F.lit("chr"), n.cast("string"))).when(n == 23, "chrX").when(n == 24, "chrY")
    return F.coalesce(by_number, F.when(plain != "", F.concat(F.lit("chr"), plain)))


def mismatch_positions(primer: ColumnLike, site: ColumnLike) -> Column:
    """0-based places where two strings of one length differ."""
    p, t = col(primer), col(site)
    return F.filter(F.sequence(F.lit(0), F.length(p) - 1), lambda i: F.substring(p, i + 1, 1) != F.substring(t, i + 1, 1))


def hamming(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda n, x: n + x)
