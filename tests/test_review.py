"""Contradictions, robust levels and fields of several sources: odd rows."""

from lexmill.operators import review as R


def test_contradictions(spark):
    rows = [(1, 0, "s", "fine of Rs. 100"), (1, 1, "s", "a fine of INR 200 or 5%"), (1, 2, "s", "Rs. 100 again, 5%"), (1, 3, "t", "Rs. 300"), (1, 4, None, "Rs. 900"), (1, 5, "s", None), (2, 0, "s", "no person shall sell"), (2, 1, "s", "it may be sold"), (2, 2, "s", "sale is prohibited"), (2, 3, "s", "allowed for Rs. 5")]
    found = {(r.query, r.a, r.b): (r.kind, list(r["values"])) for r in R.contradictions(spark.createDataFrame(rows, "query long, item int, section string, text string")).collect()}
    assert found == {(1, 0, 1): ("numeric", ["5", "INR200", "Rs.100"]), (2, 0, 1): ("prohibition", []), (2, 0, 3): ("prohibition", []), (2, 2, 3): ("prohibition", [])}


def test_robust_choice_abstains_and_prefers_the_lower_level(spark):
    levels = R.robust_levels(spark.createDataFrame([(0, "a", 0, 1.0), (0, "b", 1, 1.0), (1, "a", 0, 3.0), (1, "b", 1, 1.0)], "level int, answer string, place int, value double"), spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 0.0)], "level int, reversibility double, information double"), 1.0, 1.0)
    got = {r.case: (r.level, r.answer, r.margin) for r in R.chosen_levels(spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 9)], "case int, floor int"), levels).collect()}
    assert got == {1: (0, "a", 0.0), 2: (1, "b", None), 3: (None, None, None), 4: (None, None, None)}


def test_fields_and_corrections(spark):
    rows = [(1, "x", "old", "ocr", 1), (1, "x", None, "manual", 2), (1, "x", "lab", "lab", 1), (1, "y", "same", "ocr", 1), (1, "y", "same", "lab", 1), (2, "x", "b", "who", 3), (2, "x", "a", "who", 3)]
    out = {(r.document, r.field): (r.value, r.source, r.conflict) for r in R.authoritative(spark.createDataFrame(rows, "document int, field string, value string, source string, at int"), {"manual": 3, "lab": 2, "ocr": 1}).collect()}
    assert out == {(1, "x"): ("lab", "lab", True), (1, "y"): ("same", "lab", False), (2, "x"): ("b", "who", False)}
    state = lambda *r: spark.createDataFrame(list(r), "document int, field string, value string")
    assert sorted(map(tuple, R.corrections(state((1, "x", "a"), (1, "y", "b"), (1, "z", None)), state((1, "x", "c"), (1, "y", "b"), (1, "z", None), (1, "w", "n"))).collect())) == [(1, "w", None, "n"), (1, "x", "a", "c")]


def test_reviews_of_nothing(spark):
    (row,) = R.answer_reviews(spark.createDataFrame([(1, None, None)], "query int, answer string, expected string")).collect()
    assert (row.missing_forms, row.extra_forms, row.missing_steps, row.recommendations) == ([], [], [], [])
