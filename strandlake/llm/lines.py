"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines within k edits share one of k + 1 segments of the shorter, at nearly the same place; k grows with the shorter line's
length, up to EDITS. Every distinct line offers its segments to an index by length, place and content, and probes it with the
substrings where a shorter or equally long line's segments can lie. Lines that meet are verified with a banded bit-parallel
edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, forget, let, written

#: Edits up to which lines are alike at most, and the characters of the shorter line for each edit: one line may differ from
#: another in so many of its characters, at every length; below the first CHARACTERS that is none, so these repeat exactly.
EDITS, CHARACTERS = 2, 20
#: A line that makes up more than a HEAVY-th of all lines is looked at once; lines (24 bytes each) that are broadcast at most.
HEAVY, BROADCAST_LINES = 1000, 250_000


def _flat(line: str) -> Column:
    """One byte for each code point, alike for all that aren't ASCII: equal segments stay equal, and bytes are cut in no time."""
    return F.regexp_replace(line, "[^\\x00-\\x7F]", "?").cast("binary")


#: Letters that are counted; a line within so many edits of another differs from it in twice as many counts at most.
COUNTED = "etaoinshrdlucmfwypvbgk"


def _counts(line: str) -> list[Column]:
    return [(F.length(line) - F.length(F.translate(line, c, ""))).alias(f"n_{c}") for c in COUNTED]


def _profiles(edits: int, characters: int) -> list[tuple[int, list[int]]]:
    """Lengths from which on, and the edits that are allowed to lines shorter by 0, 1, ... characters; -1 where these are too few."""
    allowed = lambda n: min(edits, n // characters)
    of = lambda n: [e if n >= gap and (e := allowed(n - gap)) >= max(gap, 1) else -1 for gap in range(edits + 1)]
    out: list[tuple[int, list[int]]] = []
    for n in range(edits * (characters + 1) + 1):
        if not out or out[-1][1] != of(n):
            out.append((n, of(n)))
    return out


def _keyed(flat: DataFrame, edits: int, characters: int) -> DataFrame:
    """h, role, key of flat (h, flat, n): the key of each of a line's segments (role 0) and of each substring that can be another's
    segment (role 1). A segment of the line itself is both (role 2), as one row.

    What there is to cut is a constant list for each profile of lengths; a row of it becomes a key by one short expression,
    which stays within what the JVM compiles.
    """

    def cuts(profile: list[int]) -> Column:
        out = []
        for gap, most in enumerate(profile):
            for k in range(most + 1) if most > 0 else ():
                for move in range(max(-k, gap - (most - k)), min(k, gap + (most - k)) + 1):
                    role = 2 if gap == 0 and move == 0 else 1
                    out.append(f"named_struct('role', {role}, 'gap', {gap}, 'pieces', {most + 1}, 'k', {k}, 'move', {move})")
        return F.expr(f"array({', '.join(out)})") if out else F.expr("cast(array() as array<struct<role:int,gap:int,pieces:int,k:int,move:int>>)")

    first, *more = _profiles(edits, characters)
    lists = cuts(first[1])
    for least, profile in more:
        lists = F.when(F.col("n") >= least, cuts(profile)).otherwise(lists)
    each = flat.select("h", "flat", "n", F.inline(lists)).withColumn("size", F.col("n") - F.col("gap"))
    # The even segments; the last ones take the rest.
    rest, pieces, k = F.col("size") % F.col("pieces"), F.col("pieces"), F.col("k")
    base = F.expr("size div pieces").cast("int")
    at = base * k + F.greatest(F.lit(0), k - (pieces - rest)) + 1 + F.col("move")
    # The length of the shorter line, the segment's number and its text.
    return each.select("h", "role", F.xxhash64("size", "k", F.substring(F.col("flat"), at, base + (k >= pieces - rest).cast("int"))).alias("key"))


def banded_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """The edit distance in code points if it is edits at most, else a larger number; nulls give null.

    Common ends are cut; the rest runs through a bit-parallel automaton whose words hold the 2 * edits + 1 cells around the
    diagonal of a column. Once the band can't come back to edits, its state is left alone.
    """
    width = 2 * edits + 2
    ones = (1 << width) - 1
    flip = lambda x: x.bitwiseXOR(F.lit(ones))
    bit = lambda x, at: F.call_function("shiftright", x, at if isinstance(at, Column) else F.lit(at)).bitwiseAND(F.lit(1))

    def middle(x: Column) -> Column:
        """x: struct of the two lines' characters, a no shorter than b; where they differ."""
        n = F.size(x["b"])
        same = F.zip_with(F.slice(x["a"], 1, n), x["b"], lambda p, q: p == q)
        ahead = let(F.array_position(same, F.lit(False)), lambda k: F.when(k == 0, n).otherwise((k - 1).cast("int")))

        def cut(k: Column) -> Column:
            back = F.zip_with(F.slice(F.reverse(x["a"]), 1, n - k), F.slice(F.reverse(x["b"]), 1, n - k), lambda p, q: p == q)
            return let(F.array_position(back, F.lit(False)), lambda r: F.struct(F.slice(x["a"], k + 1, F.size(x["a"]) - k - F.when(r == 0, n - k).otherwise((r - 1).cast("int"))).alias("a"), F.slice(x["b"], k + 1, n - k - F.when(r == 0, n - k).otherwise((r - 1).cast("int"))).alias("b")))

        return let(ahead, cut)

    def distance(x: Column) -> Column:
        m, n = F.size(x["a"]), F.size(x["b"])  # a is the pattern, down the matrix; b runs along it

        def step(state: Column, j: Column) -> Column:
            c = F.get(x["b"], j)
            equal = F.lit(0)
            for r in range(width):  # the cell of bit r lies in row j - edits - 1 + r, counted from 0
                at = j + (r - edits - 1)
                equal = equal + F.when((at >= 0) & (F.get(x["a"], F.greatest(at, F.lit(0))) == c), 1 << r).otherwise(0)

            def moved(pm: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                d0 = (((pm.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(ones))

                def across(d: Column) -> Column:
                    hp, hn = vn.bitwiseOR(flip(d.bitwiseOR(vp))), d.bitwiseAND(vp)

                    def down(h: Column) -> Column:
                        # Down the band's lower edge while it lies in the matrix, then along the last row.
                        last = (m - 1) - (j - edits - 1)
                        more = F.when(last >= width - 1, 1 - bit(d, width - 1)).otherwise(bit(h["p"], last) - bit(h["n"], last))
                        shifted = F.shiftright(d, 1)
                        return F.struct(h["n"].bitwiseOR(flip(shifted.bitwiseOR(h["p"]))).bitwiseAND(F.lit(ones)).alias("vp"), shifted.bitwiseAND(h["p"]).alias("vn"), (state["d"] + more).cast("int").alias("d"))

                    return let(F.struct(hp.alias("p"), hn.alias("n")), down)

                return let(d0, across)

            return F.when(state["d"] > 3 * edits, state).otherwise(let(equal, moved))

        start = F.struct(F.lit(ones & ~((1 << (edits + 1)) - 1)).alias("vp"), F.lit((1 << (edits + 1)) - 1).alias("vn"), F.least(F.lit(edits), m).alias("d"))
        run = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["d"])
        return F.when(m - n > edits, m - n).when(n == 0, m).otherwise(run)

    swap = F.char_length(a) < F.char_length(b)
    chars = F.struct(F.split(F.when(swap, b).otherwise(a), "").alias("a"), F.split(F.when(swap, a).otherwise(b), "").alias("b"))
    # split("", "") is one empty string, which stands for no character.
    empty = (F.char_length(a) == 0) | (F.char_length(b) == 0)
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) > edits, F.abs(F.char_length(a) - F.char_length(b))).when(empty, F.greatest(F.char_length(a), F.char_length(b))).otherwise(let(chars, lambda x: let(middle(x), distance)))


def allowed_edits(a: Column, b: Column, edits: int = EDITS, characters: int = CHARACTERS) -> Column:
    """So many edits may lie between two lines."""
    return F.least(F.lit(edits), F.floor(F.least(F.char_length(a), F.char_length(b)) / characters).cast("int"))


def _near(pairs: DataFrame, texts: DataFrame, edits: int, characters: int) -> DataFrame:
    """doc_id, at of the targets (doc_id, at) that lie within the allowed edits of their witness (w_doc, w_at)."""
    both = pairs.join(texts, ["doc_id", "at"]).join(texts.selectExpr("doc_id w_doc", "at w_at", "line other"), ["w_doc", "w_at"])
    line, other = F.col("line"), F.col("other")
    return both.where(banded_distance(line, other, edits) <= allowed_edits(line, other, edits, characters)).select("doc_id", "at").distinct()


def repeated_lines(docs: DataFrame, edits: int = EDITS, characters: int = CHARACTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, gone (numbers from 0, sorted) of the lines that repeat an earlier one; documents without any are left out.

    Lines end at \\n; those with a word are compared with all of the corpus, those without one never repeat. A line repeats if
    an earlier line (by doc_id, then place) is within min(edits, n / characters) edits, n being the shorter one's length in
    code points, whether that one itself repeats or not. Under so many characters lines thus repeat if they are the same. A
    doc_id names one text; rows that repeat are treated alike. Null texts and null ids have no lines. Other columns are not
    read. The tables on the way are deleted; what comes back is a written table.
    """
    if characters <= edits:
        raise ValueError("an edit needs more characters than there are edits")
    given = docs.where(docs[id_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    every = given.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(WORD))
    compared = F.char_length("line") >= characters
    lines = every.where(compared)

    # Each distinct line by its hash, with its first place and how often it comes.
    place, h = F.struct("doc_id", "at"), F.xxhash64("line").alias("h")
    hashed = every.select(h, compared.alias("compared"), "doc_id", "at")
    first_of_all = written(hashed.groupBy("h", "compared").agg(F.min(place).alias("first"), F.count("*").alias("k")).select("h", "first.*", "k", "compared"), "lines")
    firsts = first_of_all.where("compared").drop("compared")

    # Of lines that make up a HEAVY-th of all, at most HEAVY different ones, only the first gives keys.
    total = firsts.agg(F.sum("k")).first()[0] or 0
    heavy = firsts.where(F.col("k") * HEAVY > total).select("h", F.col("doc_id").alias("f_doc"), F.col("at").alias("f_at"))
    given_once = lines.select(h, "doc_id", "at", "line").join(F.broadcast(heavy), "h", "left").where("f_doc is null or (doc_id = f_doc and at = f_at)")
    flat = given_once.select("h", _flat("line").alias("flat"), F.char_length("line").alias("n"))
    keyed = _keyed(flat, edits, characters)

    # Keys at which different lines meet, in one pass over each key's rows.
    by_key = Window.partitionBy("key")
    met = keyed.withColumn("lo", F.min("h").over(by_key)).withColumn("hi", F.max("h").over(by_key)).where("lo < hi")
    roles = F.when(F.col("role") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array("role"))
    met = met.select("key", F.explode(roles).alias("role"), "h").distinct()
    met = written(met.join(firsts.drop("k"), "h"), "met")
    ends = met.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, place)).alias(f"e{r}") for r in (0, 1)]).where("e0 is not null and e1 is not null")

    # First against the earliest of the other role: most of a large group ends here.
    towards = F.when(F.col("role") == 1, F.col("e0")).otherwise(F.col("e1"))
    once = met.join(ends, "key").select("doc_id", "at", towards.alias("w")).where(F.col("w") < place).select("doc_id", "at", F.col("w.doc_id").alias("w_doc"), F.col("w.at").alias("w_at")).distinct()
    wanted = met.select("h", "doc_id", "at").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_LINES else wanted
    lines_met = written(lines.select(h, "doc_id", "at", "line").join(wanted, ["h", "doc_id", "at"]).select("doc_id", "at", "line", *_counts("line")).distinct(), "texts")
    once = written(once, "once")
    near_first = written(_near(once, lines_met, edits, characters), "near")

    # Then what is left against every earlier line of its keys whose letters are nearly the same.
    counted = met.drop("h").join(lines_met.drop("line"), ["doc_id", "at"])
    rest = counted.join(near_first, ["doc_id", "at"], "left_anti")
    other = counted.select("key", (1 - F.col("role")).alias("role"), F.col("doc_id").alias("w_doc"), F.col("at").alias("w_at"), *[F.col(f"n_{c}").alias(f"w_{c}") for c in COUNTED])
    apart = sum((F.abs(F.col(f"n_{c}") - F.col(f"w_{c}")) for c in COUNTED), F.lit(0))
    pairs = rest.join(other, ["key", "role"]).where("w_doc < doc_id or (w_doc = doc_id and w_at < at)").where(apart <= 2 * edits).select("doc_id", "at", "w_doc", "w_at").distinct().join(once, ["doc_id", "at", "w_doc", "w_at"], "left_anti")
    pairs = written(pairs, "rest")
    near_rest = written(_near(pairs, lines_met, edits, characters), "near")
    near = near_first.union(near_rest)

    named = first_of_all.join(near.withColumn("near", F.lit(True)), ["doc_id", "at"], "left").where("near or k > 1").select("h", F.col("doc_id").alias("f_doc"), F.col("at").alias("f_at"), "near")
    gone = every.select(h, "doc_id", "at").join(named, "h").where("near or doc_id > f_doc or at > f_at")
    gone = written(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("gone")), "gone")
    forget(first_of_all, met, lines_met, once, near_first, pairs, near_rest)
    return gone


def dedup_lines(docs: DataFrame, edits: int = EDITS, characters: int = CHARACTERS) -> DataFrame:
    """docs with the text of what lines are left (repeated_lines says which go), n_lines before and n_removed; n_chars, where
    there is such a column, follows.

    Null texts stay null and have no lines; a null doc_id keeps its text. Every row comes back, and an empty table stays empty.
    """
    # Names that no column of docs has.
    key, gone = (f"_{name}{len(docs.columns)}_{'_'.join(docs.columns)}" for name in ("id", "gone"))
    found = repeated_lines(docs, edits, characters).select(F.col("doc_id").alias(key), F.col("gone").alias(gone))
    lines = F.split(docs["text"], "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"`{gone}`"))
    text = F.when(F.col(f"`{gone}`").isNull(), docs["text"]).otherwise(let(lines, lambda x: F.array_join(F.transform(left, lambda k: F.get(x, k)), "\n")))
    counted = {"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_removed": F.coalesce(F.size(F.col(f"`{gone}`")), F.lit(0)), "text": text}
    # Merged at every size: what goes grows with docs.
    out = docs.join(found.hint("merge"), docs["doc_id"] == found[f"`{key}`"], "left").withColumns(counted).drop(key, gone)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
