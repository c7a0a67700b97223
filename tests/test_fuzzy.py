"""Fuzzy similarity and search against every window and every row."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import lexical as L
from lexmill.functions import windows as W
from lexmill.operators import fuzzy as Z


def slow_window(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return (100.0 if not long else 0.0), 0, 0
    best = (-1.0, 0, 0)
    for start in range(1 - len(short), len(long)):
        window = long[max(0, start) : start + len(short)]
        if (score := L.ratio_of(short, window)) > best[0]:
            best = (score, max(0, start), max(0, start) + len(window))
    return best


def slow_field(q, t):
    return round(max(L.token_set_ratio_of(q.lower(), t.lower()), slow_window(q.lower(), t.lower())[0]), 6)


def test_windows_equal_every_window():
    rng = random.Random(1)
    for _ in range(800):
        letters = rng.choice(["ab", "abcd", "abcdefgh é中"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(n))) for n in (14, 30))
        assert W.best_window(a, b) == slow_window(a, b)


@pytest.mark.parametrize("size", [1, 3, 63, 64, 65, 130])
def test_many_texts_at_once_equal_each(size, monkeypatch):
    monkeypatch.setattr(W, "HELD", 400)
    rng = random.Random(size)
    query = "".join(rng.choice("abcde") for _ in range(size))
    texts = ["".join(rng.choice("abcde\x00") for _ in range(rng.randrange(2 * size + 20))) for _ in range(12)]
    assert W.best_scores(query, texts).tolist() == [slow_window(query, t)[0] for t in texts]


def corpus(rng, n):
    words = "acme foods cotton mills general store sons and company dairy products ltd a b".split()

    def name():
        text = list(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice("xyz q")
        return "".join(text)

    return [(i, f, w, name()) for i in range(n) for f, w in (("name", 1.0), ("kind", 0.7))] + [(n, "name", 1.0, ""), (n, "kind", 0.7, None), (n + 1, "name", 1.0, "a"), (n + 2, "name", 1.0, "Acme\nFoods  Ltd")]


QUERIES = ["acme foods", "cotton mils", "sons  company and", "a", "b a", "zzzzzzzz", "general store dairy products ltd company", "DAIRY", "", " ", "acmefoods"]


@pytest.mark.parametrize("threshold, k", [(65.0, 5), (80.0, 400), (95.0, 3)])
def test_search_equals_scoring_every_row(spark, tmp_path, threshold, k):
    rows = corpus(random.Random(2), 120)
    index = Z.build_index(spark.createDataFrame(rows, "item long, field string, weight double, text string"), str(tmp_path), 4)
    got = Z.search(index, spark.createDataFrame(list(enumerate(QUERIES)), "query long, text string"), k, threshold).collect()
    for number, query in enumerate(QUERIES):
        best = {}
        for item, _, weight, text in rows:
            if text is not None and query.strip():
                best[item] = max(best.get(item, 0), round(weight * slow_field(query, text), 6))
        want = sorted(((-s, i) for i, s in best.items() if s >= threshold))[:k]
        own = sorted((r.rank, r.item, r.score) for r in got if r.query == number)
        assert [(i, s) for _, i, s in own] == [(i, pytest.approx(-s, abs=1e-5)) for s, i in want], query


def test_filters_leave_few_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "name", 1.0, "".join(rng.choice("abcdefghijklmnop") for _ in range(30))) for i in range(400)] + [(999, "name", 1.0, "the cotton mills of acme")]
    index = Z.build_index(spark.createDataFrame(rows, "item long, field string, weight double, text string"), str(tmp_path), 4)
    asked = Z.digested(spark.createDataFrame([(1, "cotton mils acme")], "query long, text string"))
    assert [r.item for r in Z.candidates(index, asked, 85.0).collect()] == [999]


def test_fuzzy_coverage(spark):
    rows = [(["licence", "food"], "a food license was given"), (["xyz"], "nothing"), ([], "x"), (None, "x"), (["a"], None)]
    df = spark.createDataFrame(rows, "n array<string>, t string")
    got = [r[0] for r in df.select(L.fuzzy_coverage(F.col("n"), F.col("t"))).collect()]
    want = [sum(slow_window(x, t or "")[0] >= 75 for x in n or []) / len(n) if n else 0.0 for n, t in rows]
    assert got == want == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_pairs_together_equal_each(monkeypatch):
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choice("abc é中") for _ in range(rng.randrange(n))) for n in (20, 40)) for _ in range(200)]
    want = [W.best_window(a, b) for a, b in pairs]
    assert W.best_windows(pairs) == want
    monkeypatch.setattr(W, "HELD", 100)
    assert W.best_windows(pairs) == want


def test_pairs_are_not_combed_one_by_one(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abcd") for _ in range(90)), "".join(rng.choice("abcd") for _ in range(99))) for _ in range(40)]
    assert len(list(W._groups(pairs))) == 1
    df = spark.createDataFrame([*pairs, (None, "x"), ("", ""), ("Ab", "aB c")], "a string, b string")
    own = df.select(L.ratio("a", "b"), L.partial_ratio("a", "b"), L.token_set_ratio("a", "b"), L.field_score("a", "b"), L.partial_alignment("a", "b")).collect()
    assert [tuple(r[0]) for r in df.select(L.all_scores("a", "b")).collect()] == [tuple(r) for r in own]


def test_equal_texts_are_scored_once(spark, tmp_path):
    """A thousand copies of two names are two rows of the index; their smallest items are found."""
    rows = [(i, "name", 1.0, ("acme cotton mills", "acme cotton milk")[i % 2]) for i in range(1000)] + [(i, "kind", 0.9, "acme cotton mills") for i in range(6)]
    index = Z.build_index(spark.createDataFrame(rows, "item long, field string, weight double, text string"), str(tmp_path), 4)
    assert index.table("fields").count() == 3
    asked = spark.createDataFrame([(f"q{i}", "acme cotton mills") for i in range(3)], "query string, text string")
    got = sorted(tuple(r)[:3] for r in Z.search(index, asked, 4).collect())
    assert got == [(f"q{i}", item, rank) for i in range(3) for rank, item in enumerate([0, 2, 4, 6], 1)]
    wide = Z.search(index, asked.where("query = 'q0'"), 502, 65.0).orderBy("rank").collect()
    assert [r.item for r in wide] == [*range(0, 1000, 2), 1, 3]
