"""Provisions against all chains tried one by one, and spans against the joined text."""

import random
from itertools import combinations

from lexmill.operators import provisions as P

KINDS = "document long, chunk_id string, chunk_index int, text string, last_section int"


def heaviest(candidates):
    best = 0.0
    for size in range(len(candidates) + 1):
        for chosen in combinations(candidates, size):
            numbers = [P._numbers(n) for n, _ in chosen]
            if all(a < b for a, b in zip(numbers, numbers[1:], strict=False)):
                best = max(best, round(sum(w for _, w in chosen), 6))
    return best


def test_chain_equals_all_chains():
    rng = random.Random(7)
    for _ in range(300):
        candidates = [(rng.choice([str(rng.randrange(1, 9)), f"{rng.randrange(1, 4)}.{rng.randrange(1, 4)}"]), round(rng.uniform(-0.5, 2), 3)) for _ in range(rng.randrange(10))]
        chain = P.heaviest_chain(candidates)
        numbers = [P._numbers(candidates[k][0]) for k in chain]
        assert chain == sorted(chain)
        assert all(a < b for a, b in zip(numbers, numbers[1:], strict=False))
        assert round(sum(candidates[k][1] for k in chain), 6) == heaviest(candidates)


TEXTS = [
    "Preamble of 1999. The act.\n1. Short title.— This Act may be called so. See Section 31 of another.",
    "It shall extend\n2. Definitions.— In this Act food means and includes water,\n",
    "provided that nothing here applies. 1945. Old year\n3. Powers of officer.— The officer may after notice seize it.\n12",
    None,
    "as Section 2 says\n5. Penalty.— Whoever sells shall be punished with fine.",
]


def test_isolation_keeps_chunk_ids_and_texts(spark):
    rows = [(1, f"c{i}", i, t, 10) for i, t in enumerate(TEXTS)] + [(2, "x", 0, "no provisions at all", None), (3, "y", 0, None, 5)]
    random.Random(1).shuffle(rows)
    found = sorted(P.isolated(spark.createDataFrame(rows, KINDS)).collect(), key=lambda r: r.start)
    joined = "\n".join(t or "" for t in TEXTS)
    assert [(r.document, r.number) for r in found] == [(1, "1"), (1, "2"), (1, "3"), (1, "5")]
    assert [r.end for r in found] == [r.start for r in found[1:]] + [len(joined)]
    for r in found:
        assert r.text == joined[r.start : r.end].strip() or r.text.split() == joined[r.start : r.end].split()
    assert [r.chunk_ids for r in found] == [["c0", "c1"], ["c1", "c2"], ["c2", "c3", "c4"], ["c4"]]
    assert [r.modality for r in found] == ["obligation", "exemption", "power", "penalty"]
    assert [r.is_proviso for r in found] == [False, True, False, False]
    assert all(r.confidence >= P.LEAST_PROBABILITY for r in found)


def test_numbers_out_of_the_act_and_years_are_no_boundaries():
    assert [n for _, n, _, w in P.boundaries("40. Forty.— x\n2006. Year.— y\n7\n9. Nine.— z", 10) if w > 0] == ["9"]
    assert [n for _, n, _, w in P.boundaries("40. Forty.— x", None) if w > 0] == ["40"]
    assert P.boundaries("", 3) == []


def test_no_rows(spark):
    assert P.isolated(spark.createDataFrame([], KINDS)).collect() == []
