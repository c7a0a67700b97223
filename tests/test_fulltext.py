"""Full-text search against a slow search over all texts, and what it reads."""

import glob
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.functions.stemming import stem
from lexmill.operators import fulltext as T


def slow(docs, expression, k, stemmed):
    words = {i: T.analysed(t, stemmed) for i, t in docs if T.analysed(t, stemmed)}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    idf = lambda t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5))
    weight = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))

    def score(w, kind, terms):
        if kind == "prefix":
            return sum(idf(t) * weight(n, len(w)) for t, n in Counter(w).items() if t.startswith(terms[0]))
        tf = sum(w[i : i + len(terms)] == terms for i in range(len(w)))
        return sum(map(idf, terms)) * weight(tf, len(w)) if tf else 0

    found = []
    options = T.alternatives(expression, stemmed)
    for item, w in words.items():
        if any(all((score(w, kind, terms) > 0) != no for no, kind, terms in parts) for parts in options):
            positive = {(kind, tuple(terms)) for parts in options for no, kind, terms in parts if not no}
            found.append((round(sum(score(w, kind, list(terms)) for kind, terms in positive), 9), item))
    return [(i, s) for s, i in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]


EXPRESSIONS = [
    "run", "running fox", "fox OR wolf", '"brown fox"', '"quick brown fox" OR slee*', "run* NOT dog", 'NOT fox OR "a fox"', "NOT fox", "", None, "-dog fox", "zebra", 'fo* -"brown fox"',
    '"fox fox"', "café", "state-of-art", "xyz123*", 'dog OR dog dog OR "dog"', "OR", '"" fox', "the",
]


def corpus(rng, n):
    words = "the quick brown fox foxes runs running ran dog dogs sleep sleeping wolf state of art café cafe a lazily".split()
    docs = [(i, " ".join(rng.choice(words[: rng.choice([4, 9, 18])]) for _ in range(rng.choice([1, 3, 10, 40])))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "fox fox fox"), (n + 3, "State-of-art!"), (n + 4, "xyz1234")]


@pytest.mark.parametrize("stemmed, range_items", [(False, 1 << 16), (True, 7)])
def test_search_equals_slow_search(spark, tmp_path, stemmed, range_items):
    docs = corpus(random.Random(6), 150)
    index = T.build_index(spark.createDataFrame(docs, "id long, body string"), str(tmp_path), "id", F.col("body"), stemmed, range_items, 5)
    queries = spark.createDataFrame(list(enumerate(EXPRESSIONS)), "query long, expression string")
    got = {}
    for r in T.search(index, queries, 6).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.item, r.score))
    for number, expression in enumerate(EXPRESSIONS):
        want = slow(docs, expression, 6, stemmed)
        assert [i for i, _ in got.get(number, [])] == [i for i, _ in want], expression
        assert [s for _, s in got.get(number, [])] == pytest.approx([s for _, s in want], abs=1e-6)


def test_ranges_that_cannot_win_are_not_opened(spark, tmp_path):
    """Short texts that hold the word several times leave no chance to long ones: the files of their ranges may be gone."""
    rng = random.Random(1)
    long = [(100 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(200 + i)) + " fox") for i in range(60)]
    docs = [(i, "fox fox fox den") for i in range(12)] + long
    index = T.build_index(spark.createDataFrame(docs, "id long, body string"), str(tmp_path), "id", F.col("body"), True, 20, 6)
    queries = spark.createDataFrame([(1, "fox")], "query long, expression string")
    want = T.search(index, queries, 10).collect()
    assert [r.item for r in want] == list(range(10))
    held = index.postings().where("term = 'fox'").groupBy("range").agg(F.max("w").alias("w")).collect()
    best = max(r.w for r in held)
    gone = [r.range for r in held if r.w < best]
    assert len(gone) >= 3
    for number in gone:
        for file in glob.glob(f"{tmp_path}/postings/range={number}/*.parquet"):
            os.remove(file)
    assert T.search(index, queries, 10).collect() == want


@pytest.mark.parametrize("stemmed", [False, True])
def test_terms_of_a_prefix_stay_off_the_driver(spark, tmp_path, monkeypatch, stemmed):
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(60)]
    index = T.build_index(spark.createDataFrame(docs, "id long, body string"), str(tmp_path), "id", F.col("body"), stemmed, 20, 3)
    queries = spark.createDataFrame([(1, "w* NOT w3*"), (2, "w7x1 OR w5*")], "query long, expression string")
    frame, rows = type(queries), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: rows.append(collect(df)) or rows[-1])
    found = T.search(index, queries, 100)
    assert max(map(len, rows)) < 50
    got = {(r.query, r.item) for r in collect(found)}
    assert got == {(1, i) for i in range(60) if i != 3 and not 30 <= i < 40} | {(2, i) for i in (7, 5, *range(50, 60))}


def test_ranges_hold_few_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "RANGE_WORDS", 200)
    docs = corpus(random.Random(9), 150)
    index = T.build_index(spark.createDataFrame(docs, "id long, body string"), str(tmp_path), "id", F.col("body"), False, 1 << 16, 5)
    words = sum(len(T.analysed(t, False)) for _, t in docs)
    assert index.ranges().count() >= words / 200
    queries = spark.createDataFrame([(1, '"quick brown" OR slee* NOT dog')], "query long, expression string")
    want = slow(docs, '"quick brown" OR slee* NOT dog', 20, False)
    assert [r.item for r in T.search(index, queries, 20).orderBy("rank").collect()] == [i for i, _ in want]


def test_equal_rounded_scores_are_in_order_of_item(spark, tmp_path):
    docs = [(1, "fox " + "a " * 1_000_000), (2, "fox " + "a " * 999_999)]
    index = T.build_index(spark.createDataFrame(docs, "id long, body string"), str(tmp_path), "id", F.col("body"), False)
    queries = spark.createDataFrame([(1, "fox")], "query long, expression string")
    ranked = lambda digits: [r.item for r in T.search(index, queries, 2, digits).orderBy("rank").collect()]
    assert (ranked(6), ranked(9)) == ([1, 2], [2, 1])


def test_index_of_nothing(spark, tmp_path):
    index = T.build_index(spark.createDataFrame([(1, None), (None, "x")], "id long, body string"), str(tmp_path), "id", F.col("body"))
    queries = spark.createDataFrame([(1, "x")], "query long, expression string")
    assert T.search(index, queries, 3).collect() == []


@pytest.mark.parametrize(
    "word, want",
    [line.split(":") for line in "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat sized:size hopping:hop falling:fall failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit operator:oper feudalism:feudal decisiveness:decis triplicate:triplic formative:form electrical:electr goodness:good revival:reviv allowance:allow adjustable:adjust replacement:replac adoption:adopt communism:commun effective:effect probate:probat rate:rate controll:control roll:roll by:by über:über".split()],
)
def test_stems(word, want):
    assert stem(word) == want
