"""Binding-site search: k-mer seeds as equi-joins, then a Hamming check of the whole primer.

A contig is cut into chunks that overlap by the longest primer, so that a site lies whole in the chunk that owns its start.
Cuts are made in bytes, which takes as long as what is cut; a cut of a string would walk over all that lies before it.
Seeds are joined from the primers' side, which is small and broadcast behind a check of its size; chunks beyond meet in a
shuffle on the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.dna import hamming, is_strict, normalized, reverse_complement
from strandlake.functions.masks import WORD, base_bits, mismatch_mask_of_bits, mismatches_of_packed, numbers_of, packed, rendered, strict_run, unpacked, window_of, words

from .intervals import containment_join, merge_intervals
from .tables import many_tasks, settled

#: Starts that a chunk owns, rows of seeds that are broadcast, the most mismatches of the anchored search, and the longest seed of
#: the unanchored one.
CHUNK, BROADCAST_SEEDS, MOST_ANCHORED, MOST_SEED = 1 << 12, 2_000_000, 3, 10
#: Rows of neighbourhoods that are broadcast: they are wide, and the driver holds them twice. Beyond, joins are hinted as shuffles, as
#: the planner takes exploded seeds for as small as the primers they come from.
BROADCAST_NEAR = 250_000


def _cut(data: str, at: Column, n: Column) -> Column:
    """A part of a binary column of ASCII letters, as a string; at counts from 0."""
    return F.substring(F.col(data), at + 1, n).cast("string")


def chunks(contigs: DataFrame, longest: int, size: int = CHUNK, as_is: bool = False) -> DataFrame:
    """chrom, chunk_start, seq (with longest - 1 bases of the next chunk), owned (how many starts). Letters beyond ASCII are N,
    and others normalised unless as_is. Contigs that were read as chunks (sources.indexed_fasta) are taken as they come; their
    overlap must be longest - 1 at least."""
    if {"chunk_start", "owned"} <= set(contigs.columns):
        return contigs.select("chrom", "chunk_start", "seq", "owned")
    letters = F.col("seq") if as_is else normalized("seq")
    flat = contigs.select("chrom", F.regexp_replace(letters, "[^\\x00-\\x7F]", "N").cast("binary").alias("data")).where("length(data) > 0")
    each = flat.select("chrom", "data", F.length("data").alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.length("data") - 1) / size))).alias("k"))
    at = (F.col("k") * size).cast("int")
    return each.select("chrom", at.cast("long").alias("chunk_start"), _cut("data", at, F.lit(size + longest - 1)).alias("seq"), F.least(F.lit(size), F.col("n") - at).alias("owned"))


def starts_of(parts: DataFrame, k: int) -> DataFrame:
    """parts with at (every start of k letters in a chunk), seed (these) and data (the chunk's bytes)."""
    flat = parts.where(F.length("seq") >= k).withColumn("data", F.col("seq").cast("binary"))
    return flat.select("*", F.explode(F.sequence(F.lit(0), F.length("data") - k)).alias("at")).withColumn("seed", _cut("data", F.col("at"), F.lit(k)))


def kmers(parts: DataFrame, k: int) -> DataFrame:
    """chrom, pos, kmer of every owned start; windows with an N have none. The persisted form is an index: write it by chrom."""
    return starts_of(parts, k).where("at < owned").select("chrom", (F.col("chunk_start") + F.col("at")).alias("pos"), F.col("seed").alias("kmer")).where(is_strict("kmer"))


def _sites(parts: DataFrame, seeds: DataFrame, k: int, longest: int) -> DataFrame:
    """The columns of seeds (primer, strand, bits, shift, seed), chrom, start and site of every start at which a seed, of k letters,
    fits. Up to BROADCAST_SEEDS of them are broadcast."""
    few = seeds.count() <= BROADCAST_SEEDS
    starts = starts_of(parts, k)
    if few:
        starts = starts.join(F.broadcast(seeds.select("seed").distinct()), "seed", "left_semi")
    # What meets the seeds is no chunk, but the bases that a primer on this start can reach.
    low = F.greatest(F.col("at") - (longest - k), F.lit(0))
    near = starts.select("chrom", "chunk_start", "owned", "at", "seed", low.alias("low"), _cut("data", low, F.col("at") + longest - low).alias("near"))
    hits = near.join(F.broadcast(seeds) if few else seeds.hint("merge"), "seed").withColumn("local", F.col("at") - F.col("shift")).where("local >= 0 and local < owned")
    site = F.substring(F.col("near"), F.col("local") - F.col("low") + 1, F.length("primer"))
    placed = hits.select("primer", "strand", "bits", "chrom", (F.col("chunk_start") + F.col("local")).alias("start"), site.alias("site"))
    return placed.where(F.length("site") == F.length("primer")).where(is_strict("site"))


def numbered_starts(parts: DataFrame, lengths: list[int], flank: int) -> DataFrame:
    """chrom, pos, key, over, n_before, n_after, before0, ..., after0, ... of every strict start of so many letters in a chunk.

    key is the letters' number behind a one, which tells lengths apart. before and after are the flank bases on both sides as
    words from the start outwards, n_ how many of them are strict up to the first that isn't; beyond a chunk stand Ns. over says
    how far a start lies behind those that the chunk owns. Chunks are dealt out before their starts become rows.
    """
    pad = "N" * flank
    text = F.concat(F.lit(pad), F.regexp_replace("seq", "[^ACGT]", "N"), F.lit(pad))
    dealt = parts.repartition(many_tasks(parts), "chrom", "chunk_start").select("chrom", "chunk_start", "owned", F.length("seq").alias("n"), text.alias("text"))
    read = dealt.select("chrom", "chunk_start", "owned", "n", *[x.alias(name) for name, x in numbers_of("text").items()])
    starts = read.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    first = F.col("at") + flank

    def of(k: int) -> Column:
        # The text backwards begins with what is behind a start.
        back = F.col("n") + flank - F.col("at") - k
        sides = {"before": [("ahead", first - at - m, m) for at, m in words(flank)], "after": [("back", back - at - m, m) for at, m in words(flank)]}
        key = F.when(window_of("ahead_n", first, k) == 0, window_of("ahead", first, k) + (1 << 2 * k))
        told = [strict_run([(window_of(f"{way}_n", at, m), m) for way, at, m in side]).alias(f"n_{name}") for name, side in sides.items()]
        return F.struct(key.alias("key"), *told, *[window_of(way, at, m).alias(f"{name}{i}") for name, side in sides.items() for i, (way, at, m) in enumerate(side)])

    kept = ["chrom", (F.col("chunk_start") + F.col("at")).alias("pos"), F.greatest(F.col("at") - F.col("owned") + 1, F.lit(0)).alias("over")]
    if len(lengths) == 1:
        return starts.where(F.col("at") + lengths[0] <= F.col("n")).select(*kept, of(lengths[0]).alias("x")).select("chrom", "pos", "over", "x.*").where("key is not null")
    each = starts.select(*kept, "n", "at", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), of(k).alias("x")) for k in lengths])).alias("y"))
    return each.where("at + y.k <= n").select("chrom", "pos", "over", "y.x.*").where("key is not null")


def verified(sites: DataFrame, most: int) -> DataFrame:
    oriented = F.when(F.col("strand") == "+", F.col("site")).otherwise(reverse_complement("site"))
    # An explode of one value computes it once, however often it is looked at behind.
    masked = sites.select("*", F.explode(F.array(oriented)).alias("oriented"))
    masked = masked.select("*", F.explode(F.array(mismatch_mask_of_bits(F.col("bits"), base_bits("oriented"), F.length("primer")))).alias("mask_bits"))
    found = masked.withColumn("mismatches", F.bit_count("mask_bits")).where(F.col("mismatches") <= most)
    extra = [c for c in sites.columns if c not in ("primer", "chrom", "start", "strand", "bits", "site")]
    return found.select("primer", "chrom", "start", (F.col("start") + F.length("primer")).alias("end"), "strand", "mismatches", "mask_bits", "oriented", F.col("site").alias("site_plus"), *extra).withColumn("mask", rendered("mask_bits", F.length("primer")))


def primers_of(primers: DataFrame, least: int) -> DataFrame:
    return primers.select(F.upper(F.trim("primer")).alias("primer")).where(is_strict("primer") & F.length("primer").between(least, 63)).distinct()


def strict_search(contigs: DataFrame, primers: DataFrame, anchor: int = 12, most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Sites on both strands whose last anchor bases match exactly, with at most so many mismatches in all.

    primer, chrom, start, end, strand, mismatches, mask_bits, oriented, site_plus, mask. An N never matches; sites lie whole
    in their contig; each comes once. Primers with other letters, shorter than the anchor or over 63 bases have none.
    """
    if not 0 <= most <= MOST_ANCHORED:
        raise ValueError(f"the anchored search allows {MOST_ANCHORED} mismatches at most")
    wanted = primers_of(primers, anchor)
    longest = wanted.agg(F.max(F.length("primer"))).first()[0] or anchor
    last = F.right("primer", F.lit(anchor))
    seeds = wanted.withColumn("bits", base_bits("primer")).select("primer", "bits", F.inline(F.array(F.struct(last.alias("seed"), F.lit("+").alias("strand"), (F.length("primer") - anchor).alias("shift")), F.struct(reverse_complement(last).alias("seed"), F.lit("-").alias("strand"), F.lit(0).alias("shift")))))
    # A primer has one seed a strand, and a start one owner: each site comes once.
    return verified(_sites(chunks(contigs, longest, chunk), seeds, anchor, longest), most)


def _segments(most: int) -> tuple[int, int]:
    """Segments of a primer, and mismatches in one of them, so that a site with at most so many in all has one such segment."""
    each = 1 if most >= 2 else 0
    return most // (each + 1) + 1, each


def within_one(seed: Column) -> Column:
    """All strict strings that differ from a strict one, of a letter at least, in one place at most; the string first."""
    at = F.sequence(F.lit(1), F.length(seed))
    others = lambda j: F.filter(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: b != F.substring(seed, j, F.lit(1)))
    changed = F.flatten(F.transform(at, lambda j: F.transform(others(j), lambda b: F.concat(F.substring(seed, F.lit(1), j - 1), b, F.substring(seed, j + 1, F.length(seed))))))
    return F.concat(F.array(seed), changed)


def numbers_within_one(number: Column, k: Column) -> Column:
    """within_one() of the packed() number of k letters, MOST_SEED at most."""
    return F.slice(F.array(number, *[number.bitwiseXOR(F.lit(d << 2 * i).cast("long")) for i in range(MOST_SEED) for d in (1, 2, 3)]), F.lit(1), 3 * k + 1)


def _cut_primers(primers: DataFrame, most: int) -> DataFrame:
    """primer, strand, segment, step, k, shift and part (k letters from shift on of text, what the plus strand reads) of the segments
    of primers (that are distinct and strict), two for two or three mismatches; step is their distance, shift where one begins."""
    n, _ = _segments(most)
    step = F.floor(F.length("primer") / n).cast("int")
    both = F.array(F.struct(F.col("primer").alias("text"), F.lit("+").alias("strand")), F.struct(reverse_complement("primer").alias("text"), F.lit("-").alias("strand")))
    texts = primers.select("primer", step.alias("step"), F.least(step, F.lit(MOST_SEED)).alias("k"), F.inline(both))
    cut = texts.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("segment")).withColumn("shift", F.col("segment") * F.col("step"))
    return cut.withColumn("part", F.substring(F.col("text"), F.col("shift") + 1, F.col("k")))


def neighbourhood(primers: DataFrame, most: int, flank: int = 0) -> DataFrame:
    """primer, strand, shift, rest, key, flaw, and words of both sides (asked_before0, ..., asked_after0, ...), as numbered_starts()
    has them: what a site with at most so many mismatches must hold.

    A primer is cut into segments, one of which has one mismatch at most: all strings this near to it are seeds, of MOST_SEED
    letters at most. shift and rest are the bases before and behind one, flaw its mismatches.
    """
    each = _segments(most)[1]
    cut = _cut_primers(primers, most).withColumn("rest", F.length("primer") - F.col("shift") - F.col("k"))
    beside = {"before": F.left("text", "shift"), "after": F.reverse(F.right("text", "rest"))}
    asked = [packed(F.substring(F.lpad(side, flank, "A"), flank - at - m + 1, m)).alias(f"asked_{name}{i}") for name, side in beside.items() for i, (at, m) in enumerate(words(flank))]
    exact = cut.select("primer", "strand", "shift", "rest", "k", packed("part").alias("number"), *asked)
    near = numbers_within_one(F.col("number"), F.col("k")) if each else F.array("number")
    keys = exact.select("*", F.posexplode(near).alias("flaw", "key"))
    return keys.withColumns({"flaw": F.least("flaw", F.lit(1)), "key": F.col("key") + F.call_function("shiftleft", F.lit(1).cast("long"), 2 * F.col("k"))}).drop("number", "k")


def _asked(primers: DataFrame, most: int) -> tuple[DataFrame, int, list[int], int]:
    """Primers that can be searched, how many seeds they have, of which lengths (MOST_SEED of them at most), and the longest primer."""
    n, each = _segments(most)
    wanted = settled(primers_of(primers, n).repartition(many_tasks(primers), "primer"))  # a row becomes many
    k = F.least(F.floor(F.length("primer") / n), F.lit(MOST_SEED)).cast("int")
    count, lengths, longest = wanted.agg(F.sum(3 * k * each + 1), F.array_sort(F.collect_set(k)), F.max(F.length("primer"))).first()
    return wanted, 2 * n * (count or 0), lengths or [1], longest or 1


def _first_to_fit(most: int) -> Column:
    """Of a verified site: no earlier segment is as near, so that a site which several segments find is kept once."""
    n, each = _segments(most)
    step = F.floor(F.length("primer") / n).cast("int")
    k = F.least(step, F.lit(MOST_SEED))
    out = F.lit(True)
    for i in range(n - 1):
        begin = F.when(F.col("strand") == "+", i * step).otherwise(F.length("primer") - i * step - k)
        part = F.call_function("shiftrightunsigned", "mask_bits", begin.cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1)
        out = out & ((F.col("shift") <= i * step) | (F.bit_count(part) > each))
    return out


def sensitive_search(contigs: DataFrame, primers: DataFrame, most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Sites on both strands with at most so many mismatches anywhere, by the neighbourhoods of the primers' segments.

    For three mismatches and a primer of 20 bases that is 124 seeds of 10 letters: a base meets one of them with 1.2e-4, where
    four exact seeds of 5 letters would meet with 7.8e-3. A hit is told by numbers, and only sites become letters. Columns as of
    strict_search().
    """
    wanted, n_seeds, lengths, longest = _asked(primers, most)
    starts, seeds = numbered_starts(chunks(contigs, longest, chunk), lengths, longest), neighbourhood(wanted, most, longest)
    inside = (F.col("n_before") >= F.col("shift")) & (F.col("n_after") >= F.col("rest")) & (F.col("over") <= F.col("shift"))
    differ = F.col("flaw")
    for name, n in (("before", F.col("shift")), ("after", F.col("rest"))):
        for i, _ in enumerate(words(longest)):
            differ = differ + mismatches_of_packed(F.col(f"asked_{name}{i}"), F.col(f"{name}{i}"), F.least(n - i * WORD, F.lit(WORD)))
    hits = starts.join(F.broadcast(seeds) if n_seeds <= BROADCAST_NEAR else seeds.hint("merge"), "key").where(differ <= most).where(inside)
    # Few are left. They are dealt out anew and their letters come of an explode, which no later filter passes: so the join stays a
    # small loop, which the JVM compiles, and what is done with a site isn't done with every candidate.
    hits = hits.drop("over", "n_before", "n_after", "flaw").repartition(many_tasks(contigs), "primer", "chrom", "pos")
    # Words hold the bases from the start outwards: those before it end with the nearest one, those behind it stand backwards.
    letters = lambda name: F.concat(F.lit(""), *[unpacked(f"{name}{i}", m) for i, (_, m) in reversed(list(enumerate(words(longest))))])
    k = F.length("primer") - F.col("shift") - F.col("rest")
    middle = F.right(unpacked(F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), 2 * k)), MOST_SEED), k)
    site = F.concat(F.right(letters("before"), F.col("shift")), middle, F.reverse(F.right(letters("after"), F.col("rest"))))
    placed = hits.select("primer", "strand", base_bits("primer").alias("bits"), "shift", "chrom", (F.col("pos") - F.col("shift")).alias("start"), F.explode(F.array(site)).alias("site"))
    return verified(placed, most).where(_first_to_fit(most)).drop("shift")


def search_difficulty(contigs: DataFrame, primers: DataFrame, anchor: int = 12, easy: int = 10, moderate: int = 100, hard: int = 1000) -> DataFrame:
    """primer, n_anchor (places of its anchor on both strands), difficulty."""
    exact = primers_of(primers, anchor).withColumn("last", F.right("primer", F.lit(anchor)))
    places = strict_search(contigs, exact.select(F.col("last").alias("primer")), anchor, 0).groupBy(F.col("primer").alias("last")).agg(F.count("*").alias("k"))
    n = F.coalesce("k", F.lit(0))
    level = F.when(n <= easy, "EASY").when(n <= moderate, "MODERATE").when(n <= hard, "HARD").otherwise("REPEAT_RICH")
    return exact.join(places, "last", "left").select("primer", n.alias("n_anchor"), level.alias("difficulty"))


def valid_bindings(bindings: DataFrame, contigs: DataFrame, most: int = 3, anchor: int = 12, size: int = CHUNK) -> DataFrame:
    """bindings with ok: whether the contig's own bases at the place give the stated mismatches, without N, anchor exact.

    A binding meets the chunk that owns its start, not the contig."""
    owner = (F.floor(F.col("start") / size) * size).cast("long")
    parts = chunks(contigs, 63, size).select("chrom", F.col("chunk_start").alias("_chunk"), F.col("seq").alias("_seq"))
    at = bindings.withColumn("_chunk", owner).join(parts, ["chrom", "_chunk"], "left")
    site = F.substring(F.col("_seq"), (F.col("start") - F.col("_chunk") + 1).cast("int"), F.length("primer"))
    oriented = F.when(F.col("strand") == "+", site).otherwise(reverse_complement(site))
    right = is_strict(oriented) & (F.length(site) == F.length("primer")) & (hamming("primer", oriented) == F.col("mismatches")) & (F.col("mismatches") <= most) & (F.right(oriented, F.lit(anchor)) == F.right("primer", F.lit(anchor)))
    return at.withColumn("ok", F.coalesce(right, F.lit(False))).select(*bindings.columns, "ok")


def contig_sites(contigs: DataFrame, primers: DataFrame, most: int = 2, anchor: int = 3) -> DataFrame:
    """Unanchored sites with scan_start, where a scan of each strand from its own 5' end meets them (on "-" counted from the
    contig's end), and anchored: whether the last anchor bases match."""
    sizes = contigs.select("chrom", F.length(normalized("seq")).cast("long").alias("_n"))
    found = sensitive_search(contigs, primers, most).join(sizes.hint("merge"), "chrom")
    scan = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("_n") - F.col("end"))
    return found.withColumns({"scan_start": scan, "anchored": F.right("primer", F.lit(anchor)) == F.right("oriented", F.lit(anchor))}).drop("_n")


def profiled(contigs: DataFrame, primers: DataFrame, profile: str = "STRICT", most: int = 3, anchor: int = 12) -> DataFrame:
    """The anchored (STRICT) or the unanchored (SENSITIVE) search."""
    if profile == "STRICT":
        return strict_search(contigs, primers, anchor, most)
    if profile == "SENSITIVE":
        return sensitive_search(contigs, primers, most)
    raise ValueError(f"no such profile: {profile}")


def strategy(difficulty: DataFrame, most: int = 3) -> DataFrame:
    """difficulty with strategy: candidate where three mismatches meet few anchors, else branching. A label; the plan is the same."""
    few = F.col("difficulty").isin("EASY", "MODERATE") & F.lit(most == 3)
    return difficulty.withColumn("strategy", F.when(few, "candidate").otherwise("branching"))


def near_contigs(contigs: DataFrame, sites: DataFrame, reach: int, longest: int, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Where a mate can lie: the chunks (chrom, chunk_start, seq) within reach of sites, and the merged ranges around these."""
    around = merge_intervals(sites.select("chrom", "start", "end"), ["chrom"], pad=reach + longest)
    touched = around.select("chrom", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("k")).select("chrom", (F.col("k") * size).alias("chunk_start")).distinct()
    return chunks(contigs, longest, size).join(touched, ["chrom", "chunk_start"], "left_semi"), around


def constrained_search(contigs: DataFrame, first: DataFrame, mates: DataFrame, most: int = 3, reach: int = 3000, longest: int = 63) -> DataFrame:
    """Unanchored sites of mates, looked for only within reach of the sites of first (which were found before).

    What pairs within reach is the same as after two global searches; the mate's candidates are fewer.
    """
    near, around = near_contigs(contigs, first, reach, longest)
    parts = near.select("chrom", F.concat_ws(":", "chrom", F.col("chunk_start").cast("string")).alias("part"), "chunk_start", "seq")
    found = sensitive_search(parts.select(F.col("part").alias("chrom"), "seq"), mates, most).withColumnRenamed("chrom", "part").join(parts.drop("seq"), "part")
    moved = found.withColumns({"start": F.col("start") + F.col("chunk_start"), "end": F.col("end") + F.col("chunk_start")}).drop("part", "chunk_start").distinct()
    inside = containment_join(moved, around.select("chrom", "start", "end"), ["chrom"], left_prefix="", right_prefix="_r_")
    return inside.select("primer", "chrom", "start", "end", "strand", "mismatches", "mask_bits", "oriented", "site_plus", "mask")


def seed_cost(contigs: DataFrame, primers: DataFrame, most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """primer, n_candidates: starts at which a seed of the unanchored search fits, on both strands; what its check costs.

    One pass over the contigs: starts are counted by their letters, of which there are 4 ** MOST_SEED at most, and a count goes to
    every primer in whose neighbourhood it is.
    """
    wanted, _, lengths, _ = _asked(primers, most)
    counts = numbered_starts(chunks(contigs, MOST_SEED, chunk), lengths, 0).where("over = 0").groupBy("key").agg(F.count("*").alias("n"))
    found = neighbourhood(wanted, most).select("primer", "key").join(F.broadcast(counts), "key").groupBy("primer").agg(F.sum("n").alias("n"))
    return wanted.join(found, "primer", "left").select("primer", F.coalesce("n", F.lit(0)).alias("n_candidates"))


def anchors(pairs: DataFrame, cost: DataFrame) -> DataFrame:
    """pair_id, anchor, mate: of each pair (pair_id, primer1, primer2) the primer whose search costs less, ties by the primer."""
    each = pairs.select("pair_id", "primer1", "primer2", F.explode(F.array("primer1", "primer2")).alias("primer"))
    best = each.join(cost, "primer").groupBy("pair_id", "primer1", "primer2").agg(F.min_by("primer", F.struct("n_candidates", "primer")).alias("anchor"))
    return best.select("pair_id", "anchor", F.when(F.col("anchor") == F.col("primer1"), F.col("primer2")).otherwise(F.col("primer1")).alias("mate"))


def paired_search(contigs: DataFrame, pairs: DataFrame, most: int = 3, reach: int = 3000, chunk: int = CHUNK) -> DataFrame:
    """Unanchored sites of a panel's primers, as far as they can make products: of each pair the cheaper primer is searched
    everywhere, and the other one within reach of what was found. Every product of up to reach bases keeps both of its sites.

    Pairs with a primer that can't be searched have no sites.
    """
    able = pairs.select("pair_id", F.upper(F.trim("primer1")).alias("primer1"), F.upper(F.trim("primer2")).alias("primer2")).where(is_strict("primer1") & is_strict("primer2"))
    chosen = settled(anchors(able, seed_cost(contigs, able.select(F.explode(F.array("primer1", "primer2")).alias("primer")), most, chunk)))
    first = settled(sensitive_search(contigs, chosen.select(F.col("anchor").alias("primer")), most, chunk))
    # A mate that is another pair's anchor has all its sites already.
    mates = chosen.select(F.col("mate").alias("primer")).distinct().join(chosen.select(F.col("anchor").alias("primer")), "primer", "left_anti")
    return first.unionByName(constrained_search(contigs, first, mates, most, reach))
