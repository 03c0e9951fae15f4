"""Stages decide by row, not by doc_id, where doc_ids are null or repeated."""

from collections import Counter

from tessella.llm import mixing, neardup
from tessella.llm.common import told_apart

KIND = "doc_id long, text string, source string"


def test_rows_are_told_apart(spark):
    rows = [(1, "a", "s"), (2, "b", "s"), (2, "c", "s"), (2, "c", "s"), (None, "a", "s"), (None, "b", "s"), (None, None, "s"), (None, "s", None)]
    marked, odd = told_apart(spark.createDataFrame(rows, KIND))
    keys = {}
    for r in marked.collect():
        keys.setdefault(r._row, []).append((r.doc_id, r.text, r.source))
    assert odd and sorted(map(len, keys.values())) == [1] * 6 + [2] and keys[1] == [rows[0]]
    assert not told_apart(spark.createDataFrame(rows[:2], KIND))[1]


def test_neardup_keeps_unlike_texts_of_one_id(spark):
    long, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    third = " ".join(f"u{k}" for k in range(60))
    rows = [(1, long, "s"), (2, long, "s"), (2, other, "s"), (None, long, "s"), (None, third, "s"), (None, third, "s"), (None, third, "t")]
    got = [(r.doc_id, r.text) for r in neardup.stage(spark, spark.createDataFrame(rows, KIND), "").collect()]
    assert sorted(got, key=str) == sorted([(1, long), (2, other), (None, third)], key=str)


def test_mixing_leaves_rows_without_an_id_whole(spark):
    text = lambda s, k: " ".join(f"{s}{k}x{i}" for i in range(50))
    rows = [(None if s == "b" else 7 if s == "c" else k, text(s, k), s) for s in "abc" for k in range(20)]
    got = mixing.stage(spark, spark.createDataFrame(rows, KIND), "").collect()
    words = Counter()
    for r in got:
        words[r.source] += len(r.text.split())
    plan = {r.source: r.target for r in mixing.mix(mixing.sized(spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], KIND)).drop("text")).collect()}
    assert all(abs(words[s] - plan[s]) <= mixing.BLOCK for s in "abc")
    sizes = Counter((r.source, len(r.text.split())) for r in got)
    assert all(sum(n for (x, size), n in sizes.items() if x == s and size < 50) <= 1 for s in "abc")


def test_mixing_takes_equal_rows_one_by_one(spark):
    rows = [(None, "one two three four five six seven eight nine ten", "a")] * 40 + [(None, f"b{k} " * 10, "b") for k in range(40)]
    got = mixing.stage(spark, spark.createDataFrame(rows, KIND), "").collect()
    assert sum(len(r.text.split()) < 10 for r in got) <= 2 and len(got) >= 100
