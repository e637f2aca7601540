import random

from pyspark.sql import functions as F

from strandlake.llm.lines import _keyed, banded_distance, dedup_lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, edits=2, characters=20):
    lines = sorted((d, k, x) for d, t in docs if d is not None and t is not None for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\v\f\r"))
    like = lambda x, y: x == y or abs(len(x) - len(y)) <= edits and levenshtein(x, y) <= min(edits, len(x) // characters, len(y) // characters)
    gone = {(d, k) for n, (d, k, x) in enumerate(lines) if any((e, i) != (d, k) and like(x, y) for e, i, y in lines[:n])}
    return [(d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in docs]


def edited(rng, x, n):
    for _ in range(n):
        at = rng.randrange(len(x) + 1)
        x = rng.choice([x[:at] + rng.choice("abé") + x[at:], x[:at] + x[at + 1 :], x[:at] + rng.choice("abé") + x[at + 1 :]])
    return x


def test_distance(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("", "ab"), ("a", ""), ("abc", "abc"), ("ab", "ba"), (None, "a")]
    for _ in range(400):
        a = "".join(rng.choices("abé", k=rng.randint(0, 30)))
        pairs.append((a, edited(rng, a, rng.randint(0, 6))))
        pairs.append((a, "".join(rng.choices("abé", k=rng.randint(0, 30)))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        for r in df.select("a", "b", banded_distance(F.col("a"), F.col("b"), edits).alias("d")).collect():
            if r.a is None:
                assert r.d is None
            else:
                want = levenshtein(r.a, r.b)
                assert r.d == want if want <= edits else r.d > edits, (r, want, edits)


def test_brute_force(spark):
    for seed, edits, low, high in ((1, 2, 36, 60), (2, 1, 18, 44), (3, 2, 18, 44)):
        rng = random.Random(seed)
        base = ["".join(rng.choices("abcdeé ", k=rng.randint(low, high))) for _ in range(12)]
        docs = [(d, "\n".join(rng.choice([edited(rng, rng.choice(base), rng.randint(0, 4)), "short", "", " \t\r", "}", "x" * 39, "x" * 40, " " * 44, "".join(rng.choices("ab ", k=50))]) for _ in range(rng.randint(0, 8)))) for d in range(40)]
        docs += [(50, None), (51, ""), (None, base[0]), (52, "\n".join([base[0]] * 5)), (53, "\n\n"), (52, "\n".join([base[0]] * 5))]
        rng.shuffle(docs)
        got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), edits)
        want = brute(docs, edits)
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
        assert sum(a != b for (_, a), (_, b) in zip(docs, want, strict=True)) > 15


def test_columns_and_empty(spark):
    line = "x" * 50
    docs = spark.createDataFrame([(1, line, "k", 50), (2, f"a\n{line}y\nb", "m", 56)], "doc_id long, text string, gone string, n_chars long")
    clashing = docs.withColumn("_id", docs["doc_id"]).withColumn("h", docs["gone"]).withColumn("at", docs["n_chars"])
    for given in (docs, clashing):
        out = dedup_lines(given)
        got = {r.doc_id: (r.text, r.n_chars, r.n_lines, r.n_removed, r.gone) for r in out.collect()}
        assert got == {1: (line, 50, 1, 0, "k"), 2: ("a\nb", 3, 3, 1, "m")} and set(given.columns) < set(out.columns)
    assert dedup_lines(docs.where("false")).collect() == []


def test_short_lines_repeat_exactly(spark):
    docs = spark.createDataFrame([(1, "All rights reserved."), (2, "All rights reserved.\nall rights reserved.\n}"), (3, "}\n{\nAll rights reserved!\nKurz\n"), (4, "Kurz\nkurz")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    # Twenty characters may differ in one, fewer in none.
    assert got == {1: "All rights reserved.", 2: "}", 3: "{\nKurz\n", 4: "kurz"}


def test_the_pipeline_removes_short_copies(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a\nAll rights reserved.", "en", "s", 22), (2, "All rights reserved.\nb\n", "en", "s", 23)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.without_repeated_lines(spark, docs, "").collect()}
    assert got == {1: ("a\nAll rights reserved.", 22), 2: ("b\n", 2)}


def test_a_segment_is_one_key_for_both_roles(spark):
    """Twelve keys for a line of two edits: its three segments stand for themselves and for what an equally long line may have."""
    flat = spark.createDataFrame([(1, "x" * 20 + "y" * 20 + "z" * 21, 61), (2, "ab" * 15, 30), (3, "short", 5)], "h long, s string, n int").select("h", F.col("s").cast("binary").alias("flat"), "n")
    found = _keyed(flat, 2, 20).groupBy("h").agg(F.count("*").alias("n"), F.count_if(F.col("role") == 2).alias("own")).collect()
    # One edit: two segments, and two for a line that is shorter by one.
    assert sorted(map(tuple, found)) == [(1, 12, 3), (2, 4, 2)]
