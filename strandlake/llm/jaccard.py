"""N-gram Jaccard join over a token-group matrix.

A text is its set of distinct 5-word shingles. Texts with equal sets form one class, whose smallest doc_id stands for it.
Classes that agree in a min-hash, or share most of their rare tokens, are compared with one of them; those that are similar
(NEAR or more) form the groups. The matrix tells which groups hold a token among the tokens that a partner must share (the
rarest quarter of each set, by an order that puts frequent tokens last). A class queries the groups that hold one of its own;
a group is opened only if the query's overlap with the union of the group's tokens can reach the threshold. An opened group is
compared with its queries exactly, block by block, and so are the parts of a group that no link joins yet: classes that are
similar, but not linked, to very many others meet these in blocks, and never as pairs. Every link between parts is found this
way; links inside a part change no component.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, forget, written
from .graphs import components
from .sharing import shared_tags, tagged

WORDS, PERCENT = 5, 75
#: The percentage from which classes share a group; min-hashes by which classes meet first; rounds, at most, in which they then
#: meet classes of other groups, how many for a token, the share of the tokens to be shared (one in so many) from which they do,
#: and the share of meetings (one in so many) that must be similar for another round.
NEAR, BANDS, ROUNDS, PIVOTS, SHARE, WORTH = 50, 4, 8, 4, 3, 4
#: Members of a block of an opened group, queries that meet a block in one task, and tokens of either, all at most about.
MEMBERS, QUERIES, TOKENS = 256, 256, 1 << 18
#: Counters of the frequency sketch, whatever the input's size, and how they are cut into rows.
COUNTERS, CHUNK = 1 << 20, 1 << 12
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
#: Tokens for each bucket of the exchange, and ids up to which a list of them is broadcast.
BUCKET_TOKENS, BROADCAST_IDS = 1 << 20, 1_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_P = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)], np.int8)
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base, and of its inverse, modulo 2^64; 2^bits of each."""
    base = 0xA0761D6478BD642F
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << bits) - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))


def _block_hashes(data: np.ndarray) -> np.ndarray:
    edge = np.diff(_IN_WORD[data], prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(max(14, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * inverse[start])


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone."""
    whole = np.frombuffer(data, np.uint8)
    if len(whole) <= BLOCK:
        return _block_hashes(whole)
    parts, at = [], 0
    while at < len(whole):
        cut = _WHITE.search(data, at + BLOCK)
        end = cut.start() if cut else len(whole)
        parts.append(_block_hashes(whole[at:end]))
        at = end
    return np.concatenate(parts)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0x94D049BB133111EB)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes; with fewer words the whole sequence as one, without words none."""
    h = word_hashes((text or "").encode().translate(_LOWER))
    if not len(h):
        return h
    if len(h) < words:
        out = np.array([len(h)], np.uint64)
        for x in h:
            out = _mixed(out * _P + x)
        return out
    n = len(h) - words + 1
    out = h[:n].copy()
    for k in range(1, words):
        out = out * _P + h[k : k + n]
    return np.unique(_mixed(out))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """So many of the first tokens in a common order; two linked sets share one of them."""
    return n - -(-percent * n // 100) + 1


def _longs(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


_BAND_KEYS = [np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 % 2**64) for k in range(BANDS)]


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    return np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)


def _surveyed(docs: DataFrame) -> DataFrame:
    """A row for each document, and each task's counts of tokens by their lowest bits.

    folds: how many of its tokens share their lowest 32 bits with another, and so may share a tag.
    """

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        counts, held, n_held = np.zeros(COUNTERS, np.int64), [], 0
        for doc_id, text in it:
            s = shingles(text)
            if not len(s):
                yield doc_id, 0, 0, None, None, None, None
                continue
            held.append(s)
            n_held += len(s)
            if n_held >= COUNTERS:
                counts += _counted(held)
                held, n_held = [], 0
            folds = len(s) - len(np.unique(s.astype(np.uint32)))
            yield doc_id, len(s), folds, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), [int(((s ^ k) * _P).min() >> np.uint64(1)) for k in _BAND_KEYS], None, None
        if held:
            counts += _counted(held)
        if counts.any():
            for at in range(0, COUNTERS, CHUNK):
                yield None, None, None, None, None, at // CHUNK, counts[at : at + CHUNK].astype("<u4").tobytes()

    return arrow_rows(docs, "doc_id long, n long, folds int, sig binary, mins array<long>, chunk int, counts binary", rows)


def _levels(survey: DataFrame) -> np.ndarray:
    """How far a counter stands out, as a power of two; 0 for the bulk. One byte for each counter, at every input size."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict[int, np.ndarray] = {}
        for chunk, counts in it:
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        for chunk, total in sums.items():
            yield chunk, total.tobytes()

    chunks = survey.where("chunk is not null").select("chunk", "counts").repartition(F.col("chunk"))
    total = np.zeros(COUNTERS, np.int64)
    for chunk, data in arrow_rows(chunks, "chunk int, counts binary", rows).collect():  # COUNTERS / CHUNK rows
        total[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(data, np.int64)
    over = (total - np.median(total)) / max(1.0, 4 * float(np.sqrt(total.mean())))
    return np.where(over > 1, np.floor(np.log2(np.maximum(over, 1))) + 1, 0).astype(np.uint8)


def _prefix_tags(levels, buckets: int, percent: int):
    """Of a partition's documents, the tokens that a partner must share one of."""

    def tags_of(it: Iterator[tuple]) -> Iterator[tuple]:
        level = levels.value
        for doc_id, text in it:
            s = shingles(text) if doc_id is not None else ()
            if len(s):
                order = np.argsort(level[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                yield doc_id, np.uint64(xxhash.xxh64_intdigest(s.tobytes())), np.unique(tagged(s[order[: prefix_length(len(s), percent)]], buckets))

    return tags_of


def _few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast where they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The whole sets of the documents of a list (its one column), once for each text."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in it:
            yield doc_id, shingles(text).tobytes()

    wanted = ids.toDF("doc_id").distinct()
    sets = arrow_rows(docs.join(_few(wanted), "doc_id", "left_semi"), "id long, tokens binary", rows, out_batch=256)
    return written(sets.dropDuplicates(["id", "tokens"]), "sets")


def _opened(asked: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the queries (a, h, ca) and the members (h, b, cb) of the groups they ask, ca and cb being the parts
    that they belong to: of a lot and a block, as few as join all parts that their links join.

    A group is cut into blocks of about MEMBERS and the queries of a group into lots of about QUERIES, or fewer where their sets
    are large (TOKENS); a task compares a lot with a block through the block's inverted index, so that neither grows with the
    group and no pair becomes a row.
    """
    sizes = sets.select(F.col("id"), (F.length("tokens") / 8).alias("n"))
    parts = lambda most: F.ceil(F.greatest(F.count("*") / F.lit(most), F.sum("n") / F.lit(TOKENS))).cast("int")
    blocks = members.join(sizes, F.col("b") == F.col("id")).groupBy("h").agg(parts(MEMBERS).alias("blocks"))
    lots = asked.join(sizes, F.col("a") == F.col("id")).groupBy("h").agg(parts(QUERIES).alias("lots"))
    plan = blocks.join(lots, "h")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(plan, "h").select("a", "ca", "h", F.pmod(F.xxhash64("a"), F.col("lots")).cast("int").alias("lot"), spread("blocks").alias("block"))
    right = members.join(plan, "h").select("b", "cb", "h", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), spread("lots").alias("lot"))
    left = left.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").select("h", "block", "lot", "a", "ca", "ta")
    right = right.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b").select(F.col("h").alias("h2"), F.col("block").alias("block2"), F.col("lot").alias("lot2"), "b", "cb", "tb")

    def compare(queries: pa.Table, block: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        if queries.num_rows and block.num_rows:
            owned = [np.frombuffer(x, np.uint64) for x in block["tb"].to_pylist()]
            names, part, n = block["b"].to_pylist(), np.array(block["cb"].to_pylist()), np.array([len(x) for x in owned])
            tokens, owner = np.concatenate(owned), np.repeat(np.arange(len(owned)), n)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            for a, own, data in zip(*(queries[c].to_pylist() for c in ("a", "ca", "ta")), strict=True):
                s = np.frombuffer(data, np.uint64)
                low, high = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
                held = np.flatnonzero(high > low)
                each = high[held] - low[held]
                # The places low..high of all the query's tokens, one run after another.
                at = np.repeat(low[held] - np.cumsum(each) + each, each) + np.arange(each.sum())
                same = np.bincount(owner[at], minlength=len(n))
                linked = np.flatnonzero((100 * same >= percent * (n + len(s) - same)) & (part != own))
                for k in linked[np.unique(part[linked], return_index=True)[1]]:
                    x, y = top(own), top(int(part[k]))
                    if x != y:
                        above[x] = y
                        found.append((a, names[k]))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("h", "block", "lot").cogroup(right.groupBy("h2", "block2", "lot2")).applyInArrow(compare, "a long, b long")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar by their whole sets, and whether they link."""
    tokens = sets.select("id", "tokens")
    both = pairs.join(tokens.withColumnsRenamed({"id": "a", "tokens": "ta"}), "a").join(tokens.withColumnsRenamed({"id": "b", "tokens": "tb"}), "b")

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, ta, tb in it:
            x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
            same = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - same
            if 100 * same >= min(percent, NEAR) * union:
                yield a, b, 100 * same >= percent * union

    return arrow_rows(both.select("a", "b", "ta", "tb"), "a long, b long, linked boolean", rows)


def _bound(n: Column, least: Column, most: Column, percent: int, slack: Column) -> Column:
    """So many tokens among their first ones does a set of n share with a linked set of least to most tokens.

    Linked sets share percent / (100 + percent) of n + m tokens, all but so many of either; so their first ones, of which
    there are prefix_length(), share the rest; less those of the set's tokens that share a tag.
    """
    first = lambda x: x - F.ceil(percent * x / F.lit(100)) + 1
    both = lambda m: F.ceil(percent * (n + m) / F.lit(100 + percent) - 1e-9)
    low, high = F.greatest(least, F.ceil(percent * n / F.lit(100) - 1e-9)), F.least(most, F.floor(100 * n / F.lit(percent) + 1e-9))
    return F.greatest(F.lit(1), F.least(first(n) - n + both(low), first(high) - high + both(high)) - slack)


def _fits(n: str, m: str, percent: int) -> Column:
    return (100 * F.col(m) >= percent * F.col(n)) & (100 * F.col(n) >= percent * F.col(m))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document: links are 100 * intersection >= percent * union.

    Null, empty and blank texts have no shingles and link with nothing; they are their own component. Rows that repeat come
    back as often; rows that share a doc_id count as one document. A null id stays null and takes part through its text's
    class alone. An empty table gives none. Other columns of docs are not read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    survey = written(_surveyed(docs), "survey")
    each = survey.where("chunk is null").select("doc_id", "n", "folds", "sig", "mins")
    classes = written(each.where("n > 0").groupBy("n", "sig").agg(F.min("doc_id").alias("id"), F.first("mins").alias("mins"), F.first("folds").alias("folds")), "classes")

    # Tokens that a partner must share one of, where another class has them too.
    tokens = each.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-tokens * (100 - percent) // (100 * BUCKET_TOKENS)))
    levels = docs.sparkSession.sparkContext.broadcast(_levels(survey))  # COUNTERS bytes
    known = classes.where("id is not null").select("id", "n", "folds")
    rare = shared_tags(docs, _prefix_tags(levels, buckets, percent), buckets).select(F.col("doc_id").alias("id"), F.col("tag").alias("token"))
    shared = written(rare.join(known, "id").select("token", "id", "n", "folds").distinct(), "tokens")

    # Groups: classes that a min-hash brings together and the whole sets find similar.
    met = classes.where("id is not null").select("id", "n", F.posexplode("mins").alias("band", "low"))
    pivots = met.groupBy("band", "low").agg(F.min(F.struct(F.xxhash64("band", "id").alias("h"), F.col("id").alias("b"), F.col("n").alias("m"))).alias("p"), F.count("*").alias("k")).where("k > 1").select("band", "low", "p.b", "p.m")
    first = written(met.join(pivots, ["band", "low"]).where("id <> b").where(_fits("n", "m", percent)).select(F.col("id").alias("a"), "b").distinct(), "pairs")
    sets = _sets_of(docs, first.select("a").union(first.select("b")))
    similar = [written(_compared(first, sets, percent), "similar")]
    forget(first, sets)

    def pairs(linked: bool) -> DataFrame:
        all_pairs = functools.reduce(DataFrame.union, similar)
        return (all_pairs.where("linked") if linked else all_pairs).select("a", "b")

    group = components(pairs(False), 2)

    def sized(group: DataFrame) -> DataFrame:
        """id, g, size of the classes that are in a group with others."""
        return group.join(group.groupBy("component").agg(F.count("*").alias("size")), "component").select(F.col("node").alias("id"), F.col("component").alias("g"), "size")

    def between_groups(base: DataFrame, group: DataFrame) -> DataFrame:
        """token, id, n, folds, g, size of tokens that two groups still share."""
        placed = base.select("token", "id", "n", "folds").join(sized(group), "id", "left").select("token", "id", "n", "folds", F.coalesce("g", "id").alias("g"), F.coalesce("size", F.lit(1)).alias("size"))
        # Aggregated and joined, so that a frequent token is no one task's.
        ends = placed.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")).where("lo < hi").drop("lo", "hi")
        each = written(placed.join(ends, "token"), "shared")
        # A class must hold as many such tokens as it has to share with a partner of any size that they are shared with.
        able = each.groupBy("id", "n", "folds").agg(F.count("*").alias("k"), F.min("least").alias("least"), F.max("most").alias("most"))
        able = able.where(F.col("k") >= _bound(F.col("n"), F.col("least"), F.col("most"), percent, F.col("folds"))).select("id", "n")
        kept = written(each.drop("least", "most").join(able, ["id", "n"], "left_semi"), "kept")
        still = kept.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("token")
        out = written(kept.join(still, "token", "left_semi"), "between")
        forget(each, kept)
        return out

    # Groups grow: of a few classes for each token every class meets the one of another group with which it shares most, as
    # many pairs as there are classes. What is similar needs no look at the other pairs between the two groups.
    between = between_groups(shared, group)
    forget(shared)
    for r in range(ROUNDS):
        dealt = between.repartition("token")
        seen = F.struct(F.col("id").alias("b"), F.col("n").alias("m"), F.col("g").alias("h_g"))
        least = [F.min_by(seen, F.xxhash64("id", F.lit(r * PIVOTS + k))).alias(f"p{k}") for k in range(PIVOTS)]
        chosen = dealt.groupBy("token").agg(*least).select("token", F.inline(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))))
        meeting = dealt.join(chosen, "token").where("g <> h_g").where(_fits("n", "m", percent)).groupBy(F.col("id").alias("a"), "b", "n", "m").agg(F.count("*").alias("k"))
        meeting = meeting.where(SHARE * F.col("k") >= _bound(F.col("n"), F.col("m"), F.col("m"), percent, F.lit(0))).groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
        meeting = written(meeting, "meeting")
        sets = _sets_of(docs, meeting.select("a").union(meeting.select("b")))
        found = written(_compared(meeting, sets, percent), "similar")
        n_met, n_found = meeting.count(), found.count()
        forget(meeting, sets)
        similar.append(found)
        if n_found:
            group = components(pairs(False), 2)
            last, between = between, between_groups(between, group)
            forget(last)
        if WORTH * n_found < n_met:
            break

    # The matrix, and the queries that may reach another group: classes of the smaller of two groups ask the larger.
    part = components(pairs(True), 2).select(F.col("node").alias("id"), F.col("component").alias("c"))
    placed = known.join(group.withColumnRenamed("node", "id"), "id", "left").join(part, "id", "left").select("id", F.coalesce("component", "id").alias("g"), F.coalesce("c", "id").alias("c"))
    placed = written(placed, "placed")
    dealt = between.select("token", "id", "n", "folds", F.struct("size", "g").alias("rank")).repartition("token")
    matrix = dealt.groupBy("token", F.col("rank").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    reach = dealt.join(matrix, "token").where("rank < other").where((100 * F.col("most") >= percent * F.col("n")) & (percent * F.col("least") <= 100 * F.col("n")))
    overlap = reach.groupBy("id", "n", "folds", F.col("other.g").alias("h")).agg(F.count("*").alias("k"), F.min("least").alias("least"), F.max("most").alias("most"))
    across = overlap.where(F.col("k") >= _bound(F.col("n"), F.col("least"), F.col("most"), percent, F.col("folds"))).select("id", "h")
    # Within a group, all parts but the largest ask for the others.
    parts = placed.groupBy("g", "c").agg(F.count("*").alias("k"))
    whole = parts.groupBy("g").agg(F.max_by("c", F.struct("k", "c")).alias("largest"), F.count("*").alias("parts")).where("parts > 1").select("g", "largest")
    within = placed.join(whole, "g").where("c <> largest").select("id", F.col("g").alias("h"))
    asked = written(across.union(within).join(placed.select("id", "c"), "id").select(F.col("id").alias("a"), F.col("c").alias("ca"), "h"), "asked")

    # Open them: whole sets, block by block.
    members = written(placed.select(F.col("g").alias("h"), F.col("id").alias("b"), F.col("c").alias("cb")).join(asked.select("h").distinct(), "h", "left_semi"), "members")
    sets = _sets_of(docs, asked.select("a").union(members.select("b")))
    whole = components(pairs(True).union(_opened(asked, members, sets, percent)))
    forget(between, placed, asked, members, sets, *similar)

    named = classes.select("n", "sig", "id").join(whole.withColumnRenamed("node", "id"), "id", "left").select("n", "sig", F.coalesce("component", "id").alias("component_id"))
    full = each.where("n > 0").join(named, ["n", "sig"]).select("doc_id", "n", "component_id")
    return full.union(each.where("n = 0").selectExpr("doc_id", "n", "doc_id")).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document (the smallest doc_id) of each component; documents without shingles all stay."""
    found = jaccard_components(docs, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
