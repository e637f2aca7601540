"""Repair of a conversation's structure: the cheapest edits that make its roles (s?(ua)+)?, and of these the ASCII-least.

The DP runs over a conversation's rows; its states are what the roles so far end in (nothing, s, u, a). One macro edit is a run of
inserts and what becomes of one row: D, IK, IR, K or R. These codes are prefix-free, so of two edit strings of as many rows the
first code that differs decides: in each layer a state needs no string, only the rank of its string among the layer's, the code
and the state before. The next layer's ranks come from sorting (rank before, code). The strings are reconstructed afterwards.

No cheapest edit string has a run of more than one insert before a row, or an insert before a deletion that is ASCII-least: two
inserts lead to where none does (from the start to a state that allows less), and an insert moves behind the deletion at the
same cost. Deletions that are forced change no state and no rank, so a row that repeats is one step however often it does.

A long conversation is cut into chunks of rows, wherever the range partitioner and CHUNK_ROWS say. A chunk gives, for each state
before and behind it, its cost and the rank of its string: small matrices, which are folded along the conversation by the same
rule. The states between chunks are then known, and each chunk is repaired where it lies.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, forget, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows and characters of a chunk, rows of a task that forms chunks, and characters of a text by which it is dealt.
CHUNK_ROWS, CHUNK_CHARS, ROWS_A_TASK, HEAD = 4096, 1 << 20, 250_000, 64
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)

#: States: nothing yet, behind a system's, a user's, an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
CODES = ["D", "IK", "IR", "K", "R"]  # in ASCII order
LEGAL = {"su", "ua", "au"}
#: What is left to insert at the end.
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _next(state: int) -> int:
    """The state behind the one role, user or assistant, that may follow."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The state behind a row that keeps its role, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    behind = {"u": USER, "a": ASSISTANT}.get(initial)
    return behind if behind == _next(state) else None


def _moves(initial: str) -> list[tuple[int, int, int, int]]:
    """(state before, state behind, cost, code) of all macro edits of a row that need not go, without what it is cut off."""
    found = []
    for state in range(4):
        found.append((state, state, DELETE, 0))
        for run in (0, 1):
            at, paid = (_next(state), INSERT) if run else (state, 0)
            if (behind := _kept(at, initial)) is not None:
                found.append((state, behind, paid + KEEP, 1 if run else 3))
            found.append((state, _next(at), paid + REROLE, 2 if run else 4))
    return found


_MOVES = {x: _moves(x) for x in ("s", "u", "a", "")}
_NEVER = float("inf")


def ranked(found: dict[int, tuple]) -> dict[int, int]:
    """The rank of each state by a key that orders its string."""
    return {t: r for r, t in enumerate(sorted(found, key=found.get))}


def paths(rows: list[tuple[str, int, int]], entry: int) -> dict[int, tuple[int, int, list[int]]]:
    """state behind: (cost, rank, codes) of the best edits of rows (initial, fault of the first copy, copies) from entry on.

    A row of copies has one code, that of its first; its other copies are deleted.
    """
    cost, rank, layers = {entry: 0}, {entry: 0}, []
    for initial, fault, copies in rows:
        if fault in (BLANK, DUPLICATE):
            cost = {t: c + DELETE * copies for t, c in cost.items()}
            layers.append(None)
            continue
        more, cut = DELETE * (copies - 1), TRUNCATED if fault == CUT_OFF else 0
        best: dict[int, tuple] = {}
        for before, behind, paid, code in _MOVES.get(initial, _MOVES[""]):
            if before in cost:
                step = (cost[before] + paid + more + (cut if code else 0), rank[before], code, before)
                if behind not in best or step < best[behind]:
                    best[behind] = step
        cost, rank = {t: x[0] for t, x in best.items()}, ranked({t: x[1:3] for t, x in best.items()})
        layers.append({t: x[2:] for t, x in best.items()})
    out = {}
    for last in cost:
        state, codes = last, []
        for layer in reversed(layers):
            code, state = layer[state] if layer else (0, state)
            codes.append(code)
        out[last] = cost[last], rank[last], codes[::-1]
    return out


def finished(ends: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """The best of the states behind all rows, by cost with what is left to insert and then by rank; and that cost."""
    cost = {t: c + INSERT * len(ENDS[t]) for t, (c, _) in ends.items()}
    best = min(cost, key=lambda t: (cost[t], ends[t][1]))
    return best, cost[best]


def edited(rows: Iterable[tuple[str, str, int]], codes: Iterable[int], state: int, end: str = "") -> tuple[str, list[str]]:
    """The audit and the repaired lines of rows (role, text, copies) under their codes from a state on."""
    audit, lines = [], []

    def speak(role: str | None, text: str) -> None:
        nonlocal state
        behind = _next(state) if role is None else _kept(state, role[:1])
        lines.append(f"{role if role is not None else 'assistant' if behind == ASSISTANT else 'user'}:{text}")
        state = behind

    for (role, text, copies), code in zip(rows, codes, strict=True):
        audit.append(CODES[code] + "D" * (copies - 1))
        if CODES[code][0] == "I":
            speak(None, "")
        if CODES[code][-1] == "K":
            speak(role, text)
        elif CODES[code][-1] == "R":
            speak(None, text)
    for _ in end:
        speak(None, "")
    return "".join(audit) + end, lines


class Tally:
    """Faults, illegal neighbours and turns of rows in order; tallies of neighbouring chunks add up."""

    def __init__(self, blank=0, duplicate=0, truncated=0, illegal=0, first=None, last=None, low=None, high=None, turns=0):
        self.blank, self.duplicate, self.truncated, self.illegal = blank, duplicate, truncated, illegal
        self.first, self.last, self.low, self.high, self.turns = first, last, low, high, turns

    def fields(self) -> tuple:
        return self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns

    def add(self, other: Tally) -> None:
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.illegal += other.illegal
        if other.first is not None:
            if self.last is not None and self.last + other.first not in LEGAL:
                self.illegal += 1
            self.first = other.first if self.first is None else self.first
            self.last = other.last
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    @classmethod
    def of(cls, turn: int | None, role: str, fault: int, copies: int) -> Tally:
        if not copies:
            return cls()
        repeats = 0 if fault == BLANK else copies if fault == DUPLICATE else copies - 1
        return cls(copies if fault == BLANK else 0, repeats, int(fault == CUT_OFF), copies - 1, role[:1], role[:1], turn, turn, int(turn is not None))

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.low is not None else 0

    def counts(self) -> tuple:
        return self.gaps(), self.blank, self.duplicate, self.truncated, self.illegal


def faulty(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) with equal ones as one, n being how many (0 where a conversation has none there), and
    fault, that of the first copy."""
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("said", F.xxhash64("role", "text"))
    # Turns are told apart above, so that one phrase counts once a turn before its first turn is looked for.
    first = each.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("k")).where("k > 1")
    met = each.join(first, each["conv_id"].eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(later, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_OFF).otherwise(FINE)
    return met.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
_TALLY = "t_blank long, t_duplicate long, t_truncated long, t_illegal long, first string, last string, low long, high long, turns long"


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _chunks(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if len(held) >= most or size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _form(it: Iterator[tuple], chunk_rows: int) -> Iterator[tuple]:
    """Of a partition's rows in order (task, conv_id, turn, role, text, n, fault): each conversation that lies whole within it,
    repaired, and the chunks of all others.

    A conversation at either end of the partition may go on in the next one; those between are whole.
    """
    conversations = groupby(it, key=lambda r: r[:2])
    nothing, seq = (None,) * len(_NAMES), 0

    def opened(task, conv, chunk) -> tuple:
        nonlocal seq
        tally = Tally()
        for _, turn, role, _, n, fault in chunk:
            tally.add(Tally.of(turn, role, fault, n))
        there = [r for r in chunk if r[4]]
        initials = [(role[:1], fault, n) for _, _, role, _, n, fault in there]
        costs, ranks, codes = [None] * 16, [None] * 16, [None] * 16
        for entry in range(4):
            for behind, (cost, rank, best) in paths(initials, entry).items():
                k = 4 * entry + behind
                costs[k], ranks[k], codes[k] = cost, rank, bytes(best)
        seq += 1
        return task, conv, seq, *nothing, *tally.fields(), costs, ranks, codes, [r[2] for r in there], [r[3] for r in there], [r[4] for r in there]

    def whole(task, conv, chunk) -> tuple:
        tally = Tally()
        for _, turn, role, _, n, fault in chunk:
            tally.add(Tally.of(turn, role, fault, n))
        there = [r for r in chunk if r[4]]
        found = paths([(role[:1], fault, n) for _, _, role, _, n, fault in there], START)
        best, cost = finished({t: x[:2] for t, x in found.items()})
        audit, lines = edited([r[2:5] for r in there], found[best][2], START, ENDS[best])
        return task, conv, None, *tally.counts(), cost, audit, _sha(lines), *[None] * 15

    # A conversation's last chunk waits until it is known whether another conversation follows in this partition.
    waiting: tuple | None = None
    first = True
    for (task, conv), rows in conversations:
        if waiting is not None:
            yield (opened if waiting[0] else whole)(*waiting[1:])
        open_, n, last = first, 0, None
        for chunk in _chunks((r[1:] for r in rows), chunk_rows):
            if last is not None:
                yield opened(task, conv, last)
                open_ = True
            last, n = chunk, n + 1
        waiting, first = (open_, task, conv, last), False
    if waiting is not None:
        yield opened(*waiting[1:])


def _fold(it: Iterator[tuple]) -> Iterator[tuple]:
    """Of chunks in order (conv_id, task, seq, tally, costs, ranks): each chunk's states, and the conversation's counts."""
    for conv, chunks in groupby(it, key=lambda r: r[0]):
        cost, rank, tally, layers, places = {START: 0}, {START: 0}, Tally(), [], []
        for _, task, seq, *fields, costs, ranks in chunks:
            tally.add(Tally(*fields))
            best: dict[int, tuple] = {}
            for p in cost:
                for t in range(4):
                    if costs[4 * p + t] is not None:
                        step = (cost[p] + costs[4 * p + t], rank[p], ranks[4 * p + t], p)
                        if t not in best or step < best[t]:
                            best[t] = step
            cost, rank = {t: x[0] for t, x in best.items()}, ranked({t: x[1:3] for t, x in best.items()})
            layers.append({t: x[3] for t, x in best.items()})
            places.append((task, seq))
        state, paid = finished({t: (cost[t], rank[t]) for t in cost})
        end = ENDS[state]
        for k in range(len(layers) - 1, -1, -1):
            entry = layers[k][state]
            yield *places[k], k, entry, state, end, *tally.counts(), paid
            state, end = entry, ""


def _apply(it: Iterator[tuple]) -> Iterator[tuple]:
    """Each chunk's audit and lines under the states that are known by now."""
    for conv, k, counts, entry, behind, end, codes, roles, texts, copies in it:
        audit, lines = edited(zip(roles, texts, copies, strict=True), codes[4 * entry + behind], entry, end)
        yield conv, k, counts, audit, "\n".join(lines) if lines else None


def _join(it: Iterator[tuple]) -> Iterator[tuple]:
    """Each conversation's audit and digest, chunk after chunk."""
    for conv, chunks in groupby(it, key=lambda r: r[0]):
        digest, audits, counts, any_ = hashlib.sha256(), [], None, False
        for _, _, counts, audit, lines in chunks:
            audits.append(audit)
            if lines is not None:
                digest.update(f"\n{lines}".encode() if any_ else lines.encode())
                any_ = True
        yield conv, *counts, "".join(audits), digest.hexdigest()


def repaired(rows: DataFrame, rows_a_task: int = ROWS_A_TASK, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows (conv_id,
    turn, role, text, and n: how often the row comes, 0 for a row that only names its conversation).

    Rows go by turn (nulls first), then role and text, so that rows of one turn have an order too. A null conv_id is one
    conversation. A role's initial is its first character; an empty role has none and can't be kept. role and text aren't null.
    """
    kind = dict(rows.dtypes)["conv_id"]
    marked = written(faulty(rows), "marked")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-marked.count() // rows_a_task))
    order = ["conv_id", "turn", "role", "head", "text"]
    dealt = marked.withColumn("head", F.substring("text", 1, HEAD)).repartitionByRange(tasks, *order[:-1]).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("task"), "conv_id", "turn", "role", "text", "n", "fault")
    shape = f"task int, conv_id {kind}, seq int, {_RESULT}, {_TALLY}, costs array<long>, ranks array<int>, codes array<binary>, roles array<string>, texts array<string>, copies array<long>"
    formed = written(arrow_rows(dealt, shape, functools.partial(_form, chunk_rows=chunk_rows), out_batch=64), "formed")
    forget(marked)
    done = formed.where("seq is null").select("conv_id", *_NAMES)
    chunks = formed.where("seq is not null")
    # A row for each chunk, thousands of times fewer than rows: a conversation's go one after another.
    small = chunks.select("conv_id", "task", "seq", *[x.split()[0] for x in _TALLY.split(", ")], "costs", "ranks")
    states = arrow_rows(
        small.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq"),
        "task int, seq int, k int, entry int, behind int, end string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long", _fold,
    )
    known = states.select("task", "seq", "k", "entry", "behind", "end", F.array(*_NAMES[:6]).alias("counts"))
    ready = chunks.select("conv_id", "task", "seq", "codes", "roles", "texts", "copies").join(known, ["task", "seq"])
    parts = arrow_rows(ready.select("conv_id", "k", "counts", "entry", "behind", "end", "codes", "roles", "texts", "copies"), f"conv_id {kind}, k int, counts array<long>, audit string, lines string", _apply, out_batch=64)
    # SHA-256 reads a conversation from end to end: its chunks stream through one task, one at a time.
    whole = arrow_rows(parts.repartition("conv_id").sortWithinPartitions("conv_id", "k"), f"conv_id {kind}, {_RESULT}", _join)
    return done.union(whole)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with the faults that the crc32 of "conv_id:turn" deals out, as rows of repaired(); nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    said = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), lot.alias("lot"))
    text = F.when(F.col("lot").isin(0, 1), "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 0, "").when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("lot") == 0, 0).when(F.col("lot") == 3, 2).otherwise(1)
    return said.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("n"))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conversation's damage and its cheapest repair. An empty table gives no rows; other columns are not read."""
    return repaired(damaged(conversations.select(*[conversations[c] for c in ("conv_id", "turn", "role", "text")])))

