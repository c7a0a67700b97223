"""Greedy selections against a plain greedy choice over whole pools."""

import random

import pytest

from lexmill.operators import retrieval as R


def pools(seed):
    rng = random.Random(seed)
    rows = []
    for q in range(8):
        for i in rng.sample(range(500), rng.choice([1, 3, 20, 60])):
            rows.append((q, i, round(rng.choice([rng.random(), 0.5, 3 * rng.random()]), 3), rng.randrange(4), rng.sample("abcdefgh", rng.randrange(1, 6)), rng.choice(["1", "1.2", "1.2.3", "2", "2.1", "3"])))
    return rows


def greedy(rows, k, value):
    """k times the best by value(row, chosen); ties go to the greater score, then the smaller item."""
    left, chosen = sorted(rows, key=lambda r: (-r[2], r[1])), []
    while left and len(chosen) < k:
        best = max(range(len(left)), key=lambda n: (value(left[n], chosen), -n))
        chosen.append(left.pop(best))
    return [r[1] for r in chosen]


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def mmr_value(r, chosen):
    return 0.7 * r[2] - (1 - 0.7) * max((jaccard(r[4], c[4]) for c in chosen), default=0.0)


def family_value(r, chosen):
    kin = lambda a, b: a != b and (a.startswith(b) or b.startswith(a))
    return r[2] + 0.2 * any(kin(r[5], c[5]) for c in chosen)


def evidence(rows, most, least):
    left = sorted(rows, key=lambda r: (-r[2], r[1]))
    chosen = [left.pop(0)]
    while left and len(chosen) < most:
        held = {t for c in chosen for t in c[4]}
        new = lambda r: len(set(r[4]) - held) / len(set(r[4]))  # noqa: B023, E731
        best = max(range(len(left)), key=lambda n: (0.6 * left[n][2] + 0.02 * left[n][3] + 0.2 * new(left[n]) - 0.3 * (1 - new(left[n])), -n))  # noqa: B023
        row = left.pop(best)
        if 1 - new(row) <= 0.9 or len(chosen) < least:
            chosen.append(row)
    return [r[1] for r in chosen]


@pytest.mark.parametrize("seed", [1, 2])
def test_selections_equal_plain_greedy(spark, seed):
    rows = pools(seed)
    pool = spark.createDataFrame(rows, "query long, item long, score double, type_rank int, tokens array<string>, section string")
    own = {q: [r for r in rows if r[0] == q] for q in range(8)}
    ranked = lambda df: {q: [r.item for r in sorted((x for x in df if x.query == q), key=lambda x: x.rank)] for q in own}
    assert ranked(R.mmr(pool, 5).collect()) == {q: greedy(x, 5, mmr_value) for q, x in own.items()}
    assert ranked(R.with_family(pool, 5).collect()) == {q: greedy(x, 5, family_value) for q, x in own.items()}
    assert ranked(R.evidence_set(pool, 6, 3).collect()) == {q: evidence(x, 6, 3) for q, x in own.items()}


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sparse_vectors_move_texts_once(spark):
    from lexmill.plans import registry

    assert _shuffles(registry.QUERIES["sparse_vectors"](spark, "/root/testdata/sf0.001")) == 1


def test_bm25_moves_items_once(spark):
    """Beside the items, only term counts and each task's best of a query are moved."""
    from lexmill.operators import retrieval as R

    tokens = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, [])], "item long, t array<string>")
    queries = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "query long, term string")
    found = R.bm25(tokens, queries, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(term" in line and "item" in line]
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(query" in line and "item" in line.split("]")[0].split("ENSURE")[0]]
    assert sorted((r.query, r.item, r.rank) for r in found.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
