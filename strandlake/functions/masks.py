"""Mismatch masks: bit i tells of the base i from the 5' end, on either strand. Primers of up to 63 bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import ColumnLike, _let, col, letters


def mismatch_mask(primer: ColumnLike, site: ColumnLike) -> Column:
    places = F.zip_with(letters(primer), letters(site), lambda x, y: x != y)
    bits = F.transform(places, lambda differ, i: F.when(differ, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda n, x: n.bitwiseOR(x))


def base_bits(seq: ColumnLike) -> Column:
    """struct(a, c, g): where a strict string of up to 63 letters has these, bit i for the base i; what is left is T."""
    bits = lambda ones: F.conv(F.reverse(F.translate(col(seq), "ACGT", ones)), 2, 10).cast("long")
    return F.struct(bits("1000").alias("a"), bits("0100").alias("c"), bits("0010").alias("g"))


def mismatch_mask_of_bits(p: Column, t: Column, length: ColumnLike) -> Column:
    """mismatch_mask() of two strict strings of one length by their base_bits(), without a look at letters."""
    differ = p["a"].bitwiseXOR(t["a"]).bitwiseOR(p["c"].bitwiseXOR(t["c"])).bitwiseOR(p["g"].bitwiseXOR(t["g"]))
    return differ.bitwiseAND(_ones(col(length)))


def packed(seq: ColumnLike) -> Column:
    """Up to 31 letters as a number of two bits a letter, the last one lowest; an N counts as A."""
    return F.conv(F.translate(col(seq), "ACGTN", "01230"), 4, 10).cast("long")


def unpacked(number: ColumnLike, n: int) -> Column:
    """The n letters of a packed() number."""
    return F.translate(F.lpad(F.conv(col(number).cast("string"), 10, 4), n, "0"), "0123", "ACGT")


#: Letters of the numbers along a text (two bits a letter), which begin at every STEP-th letter, so that any WORD letters lie within one.
LETTERS, STEP, WORD = 31, 8, 24


def words(n: int) -> list[tuple[int, int]]:
    """n letters beside a place as words of up to WORD letters: how far from it each begins, and its length."""
    return [(at, min(WORD, n - at)) for at in range(0, n, WORD)]


def numbers_along(digits: Column) -> Column:
    """LETTERS digits (0 to 3) from every STEP-th on as numbers, the last digit lowest; zeros stand behind the end."""
    cut = lambda d: F.transform(F.sequence(F.lit(0), F.length(d) - LETTERS - 1, F.lit(STEP)), lambda i: F.conv(F.substring(d, i + 1, LETTERS).cast("string"), 4, 10).cast("long"))
    return _let(F.concat(digits, F.lit("0" * LETTERS)).cast("binary"), cut)


def window_of(numbers: str, at: Column, n: int) -> Column:
    """Of numbers_along(), n digits (WORD at most) from a place on."""
    shift = 2 * (LETTERS - n - at.bitwiseAND(STEP - 1))
    return F.call_function("shiftrightunsigned", F.get(numbers, F.floor(at / STEP).cast("int")), shift.cast("int")).bitwiseAND(F.lit((1 << 2 * n) - 1).cast("long"))


def strict_run(marks: list[tuple[Column, int]]) -> Column:
    """How many letters of words (marks of what isn't strict, length) come before the first mark, from the lowest end on."""
    out = F.lit(0)
    for x, n in reversed(marks):
        run = F.least(F.bit_count(x.bitwiseAND(-x) - 1).cast("int").bitwiseAND(126), F.lit(2 * n))
        out = F.call_function("shiftright", run, F.lit(1)) + F.when(x == 0, out).otherwise(0)
    return out


def numbers_of(seq: ColumnLike) -> dict[str, Column]:
    """numbers_along() of a text of A, C, G, T and N in both directions (ahead, back), and of its Ns (ahead_n, back_n)."""
    texts = {"ahead": col(seq), "back": F.reverse(col(seq))}
    return {name: numbers_along(F.translate(text, "ACGTN", "01230")) for name, text in texts.items()} | {f"{name}_n": numbers_along(F.translate(text, "ACGTN", "00001")) for name, text in texts.items()}


def mismatches_of_packed(p: Column, t: Column, n: Column) -> Column:
    """In how many of their last n letters two packed() numbers differ; none where n is below 1."""
    differ = p.bitwiseXOR(t)
    either = differ.bitwiseOR(F.call_function("shiftrightunsigned", differ, F.lit(1))).bitwiseAND(F.lit(0x5555555555555555))
    return F.bit_count(either.bitwiseAND(_ones(2 * F.greatest(n, F.lit(0)))))


def rendered(mask: ColumnLike, length: ColumnLike) -> Column:
    """. for a match, X for a mismatch."""
    return F.array_join(F.transform(F.sequence(F.lit(0), col(length) - 1), lambda i: F.when(_bit(col(mask), i) == 1, "X").otherwise(".")), "")


def hexadecimal(mask: ColumnLike) -> Column:
    return F.lower(F.lpad(F.hex(col(mask)), 16, "0"))


def _bit(mask: Column, at: Column) -> Column:
    return F.call_function("shiftright", mask, at.cast("int")).bitwiseAND(F.lit(1))


def _ones(n: Column) -> Column:
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n.cast("int")))  # of 63 too, without an overflow


def in_first(mask: ColumnLike, n: int) -> Column:
    return F.bit_count(col(mask).bitwiseAND(F.lit((1 << n) - 1)))


def in_last(mask: ColumnLike, length: ColumnLike, n: int) -> Column:
    return F.bit_count(F.call_function("shiftrightunsigned", col(mask), F.greatest(col(length) - n, F.lit(0)).cast("int")))


def nearest_to_three_prime(mask: ColumnLike, length: ColumnLike) -> Column:
    """Bases behind the last mismatch; null without any."""
    m, n = col(mask), col(length)
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _bit(m, i) == 1)
    return n - 1 - F.array_max(places)


def exact_three_prime_run(mask: ColumnLike, length: ColumnLike) -> Column:
    return F.coalesce(nearest_to_three_prime(mask, length), col(length))


def positional_burden(mask: ColumnLike, length: ColumnLike) -> Column:
    """Mismatches weighed by their place from the 5' end, over the sum of all places."""
    m, n = col(mask), col(length)
    weights = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _bit(m, i) * (i + 1))
    return F.aggregate(weights, F.lit(0).cast("long"), lambda a, x: a + x) / (n * (n + 1) / 2.0)


def anchor_intact(mask_text: ColumnLike, n: int = 3) -> Column:
    """No X among the last n; null and empty masks count as intact."""
    return F.coalesce(F.instr(F.right(col(mask_text), F.lit(n)), "X") == 0, F.lit(True))


def mismatch_features(mask: ColumnLike, length: ColumnLike, anchor: int = 12) -> Column:
    m, n = col(mask), col(length)
    whole = F.bit_count(m)
    return F.struct(
        whole.alias("mismatches"), in_first(m, 5).alias("first5"), in_last(m, n, 1).alias("last1"), in_last(m, n, 2).alias("last2"), in_last(m, n, 3).alias("last3"),
        in_last(m, n, 5).alias("last5"), in_last(m, n, 8).alias("last8"), in_last(m, n, 12).alias("last12"), in_last(m, n, anchor).alias("in_anchor"),
        (in_last(m, n, 1) > 0).alias("terminal"), nearest_to_three_prime(m, n).alias("nearest_to_3p"), exact_three_prime_run(m, n).alias("exact_3p_run"),
        (whole / n).alias("fraction"), positional_burden(m, n).alias("positional_burden"),
    )


def tolerant_terminal(primer: ColumnLike, site: ColumnLike, window: int = 3) -> Column:
    """Mismatches in the last bases where the primer's base and the template's own are G and T, in either way."""
    p, t = F.right(col(primer), F.lit(window)), F.right(col(site), F.lit(window))
    pair = F.zip_with(letters(p), letters(F.translate(t, "ACGT", "TGCA")), lambda x, y: F.concat(x, y))
    differs = F.zip_with(letters(p), letters(t), lambda x, y: x != y)
    return F.size(F.filter(F.arrays_zip(pair.alias("pair"), differs.alias("differs")), lambda z: z["differs"] & z["pair"].isin("GT", "TG")))


def disruptive_terminal(primer: ColumnLike, site: ColumnLike, window: int = 3) -> Column:
    p, t = F.right(col(primer), F.lit(window)), F.right(col(site), F.lit(window))
    return F.size(F.filter(F.zip_with(letters(p), letters(t), lambda x, y: x != y), lambda d: d)) - tolerant_terminal(primer, site, window)
