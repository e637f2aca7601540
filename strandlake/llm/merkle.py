"""A Merkle manifest of a dataset: a tree of eights for each group, a tree of eights over the groups' roots, and a proof for each row.

Levels are made by windows. A level's nodes are numbered within their group; a window over (group, parent's number) lists the
run of a node in order, over its full frame, and that one list gives the parent's preimage and the node's siblings alike. The
first node of each run stands for the parent on the next level. Then the siblings go back down: every node has its own and its
parent's path, so a row meets one node of the level above it, however high the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, lowered, written

#: Children of a node, and rows of a task that numbers the leaves.
ARITY, ROWS_A_TASK = 8, 250_000
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields, each with its length before it, so that no two rows have one preimage."""
    return digest(F.concat(*map(_field, fields)))


def numbered(df: DataFrame, group: str, order: list[str], tasks: int) -> DataFrame:
    """df with idx (a row's place in its group, from 0) and n (rows of the group), written to the shared folder.

    Rows are dealt by ranges of (group, order), so that a large group is many tasks; a row's place in its task and the counts
    of the tasks before it give its place in the group. Only rows that are equal in group and order must share a task.
    """
    dealt = df.repartitionByRange(tasks, group, *order).sortWithinPartitions(group, *order)
    at = F.monotonically_increasing_id()
    rows = written(dealt.withColumn("_at", at).withColumn("_task", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    each = rows.groupBy("_task", group).agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    # A row for each task and group: as many as tasks and groups together.
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_k").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = each.select("_task", group, (before - F.col("_first")).alias("_shift"), F.sum("_k").over(whole).alias("n"))
    out = rows.join(places, ["_task", group]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift")
    out.written_path = rows.written_path
    return out


def _level(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes (g, idx, n, hash, ...): each with up (its parent's number) and path (left, right: the others of its run), and
    the parents. A node that is alone in its group stays as it is."""
    run = Window.partitionBy("g", "up").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = nodes.withColumn("up", F.floor(F.col("idx") / ARITY)).withColumn("run", F.collect_list("hash").over(run))
    place = (F.col("idx") % ARITY).cast("int")
    joined = lambda start, n: F.array_join(F.slice("run", start, n), "")
    sides = F.struct(joined(F.lit(1), place).alias("left"), joined(place + 2, F.lit(ARITY)).alias("right"))
    alone = F.col("n") == 1
    own = listed.withColumn("path", F.when(alone, F.array().cast(PATH)).otherwise(F.array(sides))).drop("run")
    parent = F.when(alone, F.col("hash")).otherwise(digest(F.array_join("run", "")))
    first = listed.where(place == 0)
    return own, first.select("g", F.col("up").alias("idx"), F.ceil(F.col("n") / ARITY).alias("n"), parent.alias("hash"))


def grown(leaves: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels over leaves (g, idx, n, hash, ...), the largest group of which has so many, and the roots (g, hash)."""
    levels, nodes = [], leaves
    while largest > 1:
        own, parents = _level(nodes)
        levels.append(own)
        nodes, largest = written(parents, "level"), -(-largest // ARITY)
    return levels or [leaves.withColumns({"up": F.lit(0).cast("long"), "path": F.array().cast(PATH)})], nodes.select("g", "hash")


def with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with path (an array of left, right for each level on which their nodes have siblings, from the leaf up, and
    then what above says) and all other columns of above, a row (g, path, ...) for each group's root."""
    above = above.withColumn("idx", F.lit(0).cast("long"))
    kept = [c for c in above.columns if c not in ("g", "idx", "path")]
    for k, own in reversed(list(enumerate(levels))):
        columns = [c for c in own.columns if c not in ("up", "path")] if k == 0 else ["g", "idx"]
        up = above.select("g", F.col("idx").alias("up"), F.col("path").alias("rest"), *kept)
        above = own.join(up, ["g", "up"]).select(*columns, F.concat("path", "rest").alias("path"), *kept)
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda h, side: digest(F.concat(side["left"], h, side["right"])))


def manifest(docs: DataFrame, tampered_text: Column | None = None, group_col: str = "lang", rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (left and right siblings of each level, up to the root), folded_root, verified.

    Groups go by group_col, nulls first, then by their bytes; leaves by doc_id (null first), equal ones by their digest, so
    rows that repeat are leaves of their own beside each other. With tampered_text, a leaf is folded with that text in place
    of its own. A null field hashes as "-", an empty one as "0:". An empty table gives no rows. Columns beyond FIELDS are not
    read.
    """
    fields = [docs[c] for c in FIELDS]
    changed = [*fields[:-1], docs["text"] if tampered_text is None else tampered_text]
    group = F.coalesce(F.concat(F.lit("."), docs[group_col].cast("string")), F.lit(""))
    slim = written(docs.select(group.alias("g"), docs["doc_id"], leaf(fields).alias("hash"), leaf(changed).alias("shown")), "leaves")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slim.count() // rows_a_task))
    leaves = numbered(slim, "g", ["doc_id", "hash", "shown"], tasks)
    sizes = leaves.groupBy("g").agg(F.max("n").alias("n"))
    largest, groups = sizes.agg(F.max("n"), F.count("*")).first()
    levels, subroots = grown(leaves, largest or 0)
    # A row for each group from here to the root. Its path starts the paths below, so that nothing is joined by group alone.
    named = subroots.select(F.lit("").alias("all"), F.col("g").alias("of"), F.col("hash"))
    tops, roots = grown(numbered(named, "all", ["of"], 1).withColumnRenamed("all", "g"), groups)
    heads = with_paths(tops, roots.select("g", F.array().cast(PATH).alias("path"), F.col("hash").alias("root")))
    full = with_paths(levels, heads.select(F.col("of").alias("g"), "path", F.col("hash").alias("subroot"), "root"))
    full = full.withColumnRenamed("path", "proof")
    out = full.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "proof", folded(F.col("shown"), F.col("proof")).alias("folded_root"))
    forget(slim)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proofs(docs: DataFrame, tamper_by: int = 3) -> DataFrame:
    """The manifest's digests, where every row of which tamper_by divides the crc32 of its id shows its text in lower case."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % tamper_by == 0
    found = manifest(docs, F.when(hit, lowered(docs["text"])).otherwise(docs["text"]))
    whole = F.array_join(F.transform("proof", lambda side: F.concat(side["left"], side["right"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", digest(whole).alias("proof_sha256"), "folded_root", "verified")
