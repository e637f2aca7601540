import hashlib
import itertools
import random
import re
import zlib

import pytest

from strandlake.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def every_edit(rows):
    """The cheapest (cost, audit, lines) among all edits with up to two inserts between rows, of rows (role, text, fault)."""
    runs = [[(role, "") for role in run] for k in range(3) for run in itertools.product(["user", "assistant"], repeat=k)]
    best = None
    choices = []
    for role, text, fault in rows:
        own = [("D", 2, [])]
        if fault not in (R.BLANK, R.DUPLICATE):
            more = 5 if fault == R.CUT_OFF else 0
            own += [("K", more, [(role, text)]), ("R", 1 + more, [("user", text)]), ("R", 1 + more, [("assistant", text)])]
        choices.append([("I" * len(run) + code, 5 * len(run) + cost, run + said) for run in runs for code, cost, said in own])
    choices.append([("I" * len(run), 5 * len(run), run) for run in runs])
    for picked in itertools.product(*choices):
        said = [x for p in picked for x in p[2]]
        if GOOD.fullmatch("".join(role[:1] or "?" for role, _ in said)):
            found = sum(p[1] for p in picked), "".join(p[0] for p in picked), [f"{a}:{b}" for a, b in said]
            best = found if best is None else min(best, found)
    return best


def by_strings(rows):
    """The same by whole strings, row by row."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", [])}

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for st, (cost, audit, lines) in list(out.items()):
                for x in set(after[st]) & set("ua"):
                    step = cost + 5, audit + "I", [*lines, f"{names[x]}:"]
                    if x not in out or step < out[x]:
                        out[x] = step
        return out

    for role, text, fault in rows:
        more, new = (5 if fault == R.CUT_OFF else 0), {}
        steps = [(st, (cost + 2, audit + "D", lines)) for st, (cost, audit, lines) in best.items()]
        if fault not in (R.BLANK, R.DUPLICATE):
            # An insert run from a state of its own, so that the strings of this layer stay comparable.
            starts = [(st, v) for st, v in best.items()]
            starts += [(x, v) for st, v in best.items() for x, v in inserted({st: v}).items() if x != st]
            for st, (cost, audit, lines) in starts:
                x = role[:1]
                if x and x in after[st]:
                    steps.append((x, (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
                for y in set(after[st]) & set("ua"):
                    steps.append((y, (cost + 1 + more, audit + "R", [*lines, f"{names[y]}:{text}"])))
        for st, v in steps:
            if st not in new or v < new[st]:
                new[st] = v
        best = new
    ends = inserted(best)
    return min(ends[st] for st in ("", "a") if st in ends)


def classified(rows):
    """Rows (turn, role, text) of a conversation in order, with faults."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = R.BLANK if not bare else R.DUPLICATE if (role, text) in seen else R.CUT_OFF if bare[-1] not in ".!?" else R.FINE
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(conversations, solve=by_strings):
    damaged = {}
    for conv, turn, role, text in conversations:
        mine = damaged.setdefault(conv, [])
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        mine += [(turn, "user" if c == 4 else role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    out = []
    for conv, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found = classified(rows)
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, lines = solve(found)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
        faults = [f for *_, f in found]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(R.BLANK), faults.count(R.DUPLICATE), faults.count(R.CUT_OFF), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return by_repr(out)


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def talk(n, rng, turns=None):
    for k in range(n):
        yield (k if turns is None else rng.choice(turns)), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No!", "well", "a b?", " \n", "", f"t{k}.", f"u{k}", "é "])


def of_codes(rows):
    found = R.paths([(role[:1], fault, 1) for role, _, fault in rows], R.START)
    best, cost = R.finished({t: x[:2] for t, x in found.items()})
    audit, lines = R.edited([(role, text, 1) for role, text, _ in rows], found[best][2], R.START, R.ENDS[best])
    return cost, audit, lines


def test_equals_all_edits_of_short_conversations():
    rng = random.Random(8)
    for _ in range(60):
        rows = classified(list(talk(rng.randint(0, 3), rng)))
        want = every_edit(rows)
        assert of_codes(rows) == want and by_strings(rows) == want


def test_equals_whole_strings_of_longer_conversations():
    rng = random.Random(9)
    for _ in range(300):
        rows = classified(list(talk(rng.randint(4, 40), rng)))
        assert of_codes(rows) == by_strings(rows)


def some(n=60, seed=2, longest=12):
    rng = random.Random(seed)
    rows = [(c, *r) for c in range(n) for r in talk(rng.randint(1, longest), rng)]
    rows += [(c, *r) for c in range(1000, 1010) for r in talk(9, rng, [None, 1, 2, 7])]
    rows += [(None, 1, "user", "A."), (None, None, None, None), (None, 2, None, "B."), (2000, 5, "user", None), (2001, None, "assistant", "x" * 200_000 + ".")]
    return rows + rows[:20]


@pytest.mark.parametrize("tasks", [1, 40])
@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_chunks_and_tasks_change_nothing(spark, chunk_rows, tasks):
    rows = some()
    conversations = spark.createDataFrame(rows, SCHEMA)
    got = R.repaired(R.damaged(conversations), rows_a_task=len(rows) // tasks, chunk_rows=chunk_rows).collect()
    assert by_repr(got) == brute(rows)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(3)
    rows = some(20) + [(7777, *r) for r in talk(3000, rng)] + [(8888, k % 5, "user", "Same.") for k in range(3000)]
    got = R.repaired(R.damaged(spark.createDataFrame(rows, SCHEMA)), rows_a_task=300, chunk_rows=100).collect()
    assert by_repr(got) == brute(rows)


def test_all_dropped_empty_and_clashing_columns(spark):
    gone = [(c, t, "user", "A.") for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = R.damaged_and_repaired(spark.createDataFrame(gone, SCHEMA)).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == len({r[0] for r in gone})
    assert R.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = some(8)
    wide = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA + ", n int, said int, fault int, task int, lot int")
    assert by_repr(R.damaged_and_repaired(wide).collect()) == brute(rows)
