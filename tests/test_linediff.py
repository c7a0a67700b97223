"""Line edits restore the text, keep a longest subsequence where no anchors are, and hold on to unique lines."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import linediff as D
from lexmill.functions.text import drop_repeated_lines
from lexmill.plans import registry


def restored(before, script, after):
    a, b = before.split("\n"), after.split("\n")
    out, at, to = [], 0, 0
    for op, i, j, k, m in script:
        assert (i, k) == (at, to)
        assert op == ("equal" if a[i:j] == b[k:m] and j > i else "replace" if j > i and m > k else "delete" if j > i else "insert")
        out += a[i:j] if op == "equal" else b[k:m]
        at, to = j, m
    assert (at, to) == (len(a), len(b))
    return "\n".join(out)


@pytest.mark.parametrize("pairs", [1 << 20, 0])
def test_edits_restore_any_text(monkeypatch, pairs):
    monkeypatch.setattr(D, "PAIRS", pairs)
    rng = random.Random(8)
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz"])
        before = "\n".join(rng.choice(letters) * rng.randrange(2) for _ in range(rng.randrange(20)))
        lines = before.split("\n")
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(lines) + 1)
            lines[at : at + rng.randrange(3)] = [rng.choice(letters) for _ in range(rng.randrange(3))]
        after = "\n".join(lines)
        assert restored(before, D.edits(before, after), after) == after


def test_lines_that_were_only_removed_are_all_kept():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.choice("abcde") for _ in range(rng.randrange(1, 25))]
        b = [x for x in a if rng.random() < 0.6]
        assert len(D.matches(a, b)) == len(b)


def test_unique_lines_anchor():
    before = "{\n a\n}\n\nb\n{\n c\n}"
    after = "{\n c\n}\n\nb\n{\n a\n}"
    kept = D.matches(before.split("\n"), after.split("\n"))
    assert (4, 4) in kept


def test_many_equal_lines_are_paired_in_order():
    a, b = ["", "x"] * 3000, ["", "y"] * 3000
    kept = D.matches(a, b)
    assert len(kept) == 3000


def test_columns(spark):
    rows = [("a\nb\nc", "a\nc\nd"), (None, "x"), ("x", None), (None, None), ("", ""), ("one\ntwo", "one\n2")]
    df = spark.createDataFrame(rows, "b string, a string").withColumn("s", D.line_edits("b", "a"))
    out = df.select(D.applied(F.col("b"), F.col("s")).alias("after"), D.changed_lines(F.col("s")).alias("changed"), D.edited_lines(F.col("s"), ("delete",)).alias("gone")).collect()
    assert [r.after for r in out] == [a or "" for _, a in rows]
    assert [r.changed for r in out] == [0, 1, 1, 0, 0, 1]
    assert [r.gone for r in out] == [1, 0, 0, 0, 0, 0]


def test_edits_of_texts_that_were_dealt_out(spark):
    """A UDF's call over this expression was left in the plan."""
    rows = [(1, "a\na\nb"), (2, None), (3, ""), (4, "x\n\n\n1. x\n1. x\ny\ny\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, before string").repartition(8)
    out = D.with_edits(docs.withColumn("after", drop_repeated_lines(F.col("before"))), "before", "after", "s")
    gone = out.select("doc_id", D.edited_lines(F.col("s"), ("delete",)).alias("gone"), D.applied(F.col("before"), F.col("s")).alias("text"), F.coalesce("after", F.lit("")).alias("want"))
    got = {r.doc_id: (r.gone, r.text == r.want) for r in gone.collect()}
    assert got == {1: (1, True), 2: (0, True), 3: (0, True), 4: (2, True)}


@pytest.mark.parametrize("name, column", [("cleaning_diff", "changes"), ("document_diff", "lines_removed")])
def test_queries_over_texts_that_were_dealt_out(spark, tmp_path, name, column):
    rows = [(1, "a\na\nb"), (2, None), (3, ""), (4, "x\n\n\n1. x\n1. x\ny\ny\ny")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r[column] for r in registry.QUERIES[name](spark, str(tmp_path)).select("doc_id", column).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 2}
