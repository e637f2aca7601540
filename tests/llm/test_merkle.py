import hashlib
import random
import zlib

import pytest

from strandlake.llm.merkle import manifest, proofs

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(*fields):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes):
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, place, strict=True):
            first = k // 8 * 8
            path.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 8])))
        nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        place = [k // 8 for k in place]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in langs]
    trees = [tree([leaf(*r) for r in g]) for g in groups]
    root, tops = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for g, (sub, paths), top in zip(groups, trees, tops, strict=True):
        for (d, s, lang, n, text), path in zip(g, paths, strict=True):
            hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
            h = leaf(d, s, lang, n, lower(text) if hit else text)
            for left, right in path + top:
                h = sha(left + h + right)
            out.append((d, leaf(d, s, lang, n, text), sub, root, sha("".join(a + b for a, b in path + top)), h, h == root))
    return out


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def some_rows(n, langs, seed=5):
    rng = random.Random(seed)
    rows = [(k * 3, f"s{k % 4}", rng.choice(langs), k, "Some Text " * rng.randint(0, 9)) for k in range(n)]
    return rows + [(None, "s", "en", 1, "A"), (None, None, None, None, None), (9, "s0", "en", 3, ""), (9, "s0", "en", 3, ""), (9, "s1", "en", 3, "É"), (7, "s", "", 0, "Long Text " * 30_000)]


@pytest.mark.parametrize("n", [0, 1, 80])
def test_equals_a_plain_tree(spark, n):
    rows = some_rows(n, ["en", "en", "en", "de", "fr"])
    assert by_repr(proofs(spark.createDataFrame(rows, SCHEMA)).collect()) == by_repr(brute(rows))


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_one_group_of_every_shape(spark, n):
    rows = [(k, "s", "en", k, f"T{k}") for k in range(n)]
    assert by_repr(proofs(spark.createDataFrame(rows, SCHEMA)).collect()) == by_repr(brute(rows))


def test_more_groups_than_a_run_and_one_group_of_most_rows(spark):
    rows = [(k, "s", f"l{k}" if k < 11 else "en", k, f"T{k}") for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert by_repr(proofs(docs).collect()) == by_repr(brute(rows))
    # The same when one group is dealt over very many tasks.
    one, many = (manifest(docs, rows_a_task=k).select("doc_id", "leaf", "subroot", "root", "folded_root") for k in (1000, 7))
    assert by_repr(one.collect()) == by_repr(many.collect())


def test_only_changed_rows_fail(spark):
    rows = [(k, "s", "en", k, "lower" if k % 2 else "Upper") for k in range(60)]
    found = {r.doc_id: r.verified for r in proofs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {k: not (k % 2 == 0 and zlib.crc32(str(k).encode()) % 3 == 0) for k in range(60)}
    assert all(r.verified for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect())


def test_empty_and_clashing_columns(spark):
    assert proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = some_rows(12, ["en", "de"])
    names = ["g", "idx", "n", "hash", "run", "path", "root", "up", "_task", "_at"]
    wide = spark.createDataFrame([(*r, *range(10)) for r in rows], SCHEMA + "".join(f", {c} int" for c in names))
    assert by_repr(proofs(wide).collect()) == by_repr(brute(rows))
