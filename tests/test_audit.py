"""Merged audits against one pass, schedules against longest paths, exact p against fractions."""

import random
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from lexmill.operators import audit as A
from lexmill.operators import metrics as M
from lexmill.operators import scheduling as C


def test_merged_increments_equal_one_pass_within_the_error(spark):
    rng = random.Random(1)
    rows = [(i, i % 700, rng.choice([None, "", " \n", "Short.", "It says section 3 and rule 4 apply", "word " * rng.randrange(1, 900) + "end."]), rng.choice([None, "u"])) for i in range(6000)]
    chunks = spark.createDataFrame(rows, "id long, doc long, body string, uri string")
    missing = {"document_uri": F.col("uri")}
    parts = A.increments(chunks, F.col("id") % 7, "id", "doc", "body", missing)
    assert parts.count() == 7
    merged = A.report(A.merged(parts)).first()
    whole = A.report(A.increments(chunks, F.lit(0), "id", "doc", "body", missing)).first()
    exact = [c for c in merged.asDict() if "_p" not in c and not c.startswith("different_")]
    assert [merged[c] for c in exact] == [whole[c] for c in exact]
    texts = [t or "" for _, _, t, _ in rows]
    assert merged.total_chunks == 6000 and merged.empty_chunks == sum(not t.strip() for t in texts)
    assert merged.missing_document_uri == sum(u is None for *_, u in rows)
    assert merged.multi_provision_chunks == sum("rule 4" in t for t in texts)
    assert merged.incomplete_sentence_chunks == 0 or merged.incomplete_sentence_chunks < 6000
    lengths = sorted(map(len, texts))
    for q in (50, 90, 99):
        low, high = (sum(x < merged[f"char_p{q}"] for x in lengths) / 6000, sum(x <= merged[f"char_p{q}"] for x in lengths) / 6000)
        assert low - A.RANK_ERROR <= q / 100 <= high + A.RANK_ERROR
    assert merged.different_ids == pytest.approx(6000, rel=A.COUNT_ERROR)
    assert merged.different_documents == pytest.approx(700, rel=A.COUNT_ERROR)


def test_exemplars_are_the_first_of_each_metric(spark):
    chunks = spark.createDataFrame([(i, "x" if i % 2 else None) for i in range(40)], "id long, body string")
    found = A.exemplars(chunks, "id", "body", {}, 3).collect()
    assert sorted((r.metric, r.rank, r.chunk_id) for r in found if r.metric == "empty_chunks") == [("empty_chunks", 1, 0), ("empty_chunks", 2, 2), ("empty_chunks", 3, 4)]


def test_exact_binomial_equals_fractions(spark):
    rng = random.Random(5)
    rows = [(0, 0), (0, 1), (1, 0), (5, 5), (0, 1000), (500, 500), (480, 520)] + [(rng.randrange(500), rng.randrange(500)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = [r.p for r in df.select(M.exact_binomial(F.col("a"), F.col("b")).alias("p")).collect()]
    want = [float(min(Fraction(1), 2 * Fraction(sum(comb(a + b, i) for i in range(min(a, b) + 1)), 2 ** (a + b)))) for a, b in rows]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_schedules_equal_longest_paths(spark):
    rng = random.Random(9)
    tasks, edges = [], []
    for plan in range(25):
        n = rng.randrange(1, 9)
        tasks += [(plan, f"t{i}", rng.randrange(5)) for i in range(n)]
        edges += [(plan, f"t{i}", f"t{j}") for i in range(n) for j in range(i) if rng.random() < 0.35]
    tasks += [(99, "a", 1), (99, "b", 1), (99, "c", 2), (99, "d", 3)]
    edges += [(99, "a", "b"), (99, "b", "a"), (99, "c", "a")]
    rows = {(r.plan, r.task): r for r in C.scheduled(spark.createDataFrame(tasks, "plan long, task string, cost int"), spark.createDataFrame(edges, "plan long, task string, need string")).collect()}
    assert len(rows) == len(tasks)
    cost = {(p, t): c for p, t, c in tasks}
    for plan in range(25):
        own = sorted(t for p, t in cost if p == plan)
        end, wave = {}, {}
        for t in own:
            needs = [j for p, i, j in edges if p == plan and i == t]
            wave[t] = max((wave[j] + 1 for j in needs), default=0)
            end[t] = max((end[j] for j in needs), default=0) + cost[plan, t]
        latest = {}
        for t in reversed(own):
            latest[t] = min((latest[i] - cost[plan, i] for p, i, j in edges if p == plan and j == t), default=max(end.values()))
        for t in own:
            r = rows[plan, t]
            assert (r.wave, r.start, r.end, r.slack, r.critical) == (wave[t], end[t] - cost[plan, t], end[t], latest[t] - end[t], latest[t] == end[t])
    assert [rows[99, t].wave for t in "abcd"] == [None, None, None, 0]


def test_rules_make_tasks_and_edges(spark):
    rules = spark.createDataFrame([("q", "a", 1, []), ("q", "b", 2, ["a", "b", "gone"])], "kind string, task string, cost int, needs array<string>")
    tasks, edges = C.planned(spark.createDataFrame([(1, "q"), (2, "other")], "plan long, kind string"), rules)
    assert sorted(map(tuple, tasks.collect())) == [(1, "a", 1), (1, "b", 2)]
    assert list(map(tuple, edges.collect())) == [(1, "b", "a")]


def test_plans_are_moved_once(spark):
    tasks = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (None, "a", 1), (2, None, 1)], "plan long, task string, cost int")
    found = C.scheduled(tasks, spark.createDataFrame([(1, "b", "a"), (1, "b", "a")], "plan long, task string, need string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "a", 2, 0, 0, 2, 0, True), (1, "b", 3, 1, 2, 5, 0, True), (2, None, 1, *[None] * 5), (None, "a", 1, *[None] * 5)], key=repr)
