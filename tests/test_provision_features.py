"""Metadata of provisions and the re-ranking, on stated chunks."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import provision_features as P

V = P.Vocabulary(("cumin", "ginger", "masala", "milk", "mixed masala", "ice cream"), ("cocktail", "paste"), ("black",), ("pan", "garam"), ("whole", "powder"))


@pytest.mark.parametrize(
    "text, want",
    [
        ("2.9.8: Cumin (Zeera) whole means the fruit", "cumin"), ("2.3.22 Ginger Cocktail: 1. x", "ginger cocktail"), ("2.11.5 Pan Masala means", "pan masala"), ("Cumin Black (Kalonji)", "cumin black"),
        ("the ice cream shall", "ice cream"), ("nothing here", None), (None, None), ("x" * 200 + " cumin", None),
    ],
)
def test_commodities_of_headings(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(P.commodity(F.col("t"), V)).first()[0] == want


def test_agreement_and_mentions(spark):
    pairs = [("mixed masala", "masala", True), ("pan masala", "masala", False), ("cumin", "cumin black", False), ("ginger", "ginger cocktail", False), ("masala", "masala milk", False), ("cumin", "cumin", True), ("cumin", "salt", False)]
    got = spark.createDataFrame(pairs, "a string, b string, w boolean").select(P.agrees(F.col("a"), F.col("b"), V).alias("x"), "w").collect()
    assert all(r.x == r.w for r in got)
    texts = [("Cumin (Safed Zeera) whole means", "cumin", True), ("cumin powder shall", "cumin", True), ("2.3.22 Ginger Cocktail:", "ginger", False), ("Cumin Black", "cumin", False), ("masala milk", "masala", False), ("Pan Masala 8000 ppm", "masala", False), ("of cumin.", "cumin", True), ("cumins", "cumin", False), ("a.b", "a.b", True), (None, "cumin", False)]
    got = spark.createDataFrame(texts, "t string, e string, w boolean").select("t", P.mentions(F.col("t"), F.col("e"), V).alias("x"), "w").collect()
    assert [(r.t, r.x) for r in got] == [(r.t, r.w) for r in got]


CHUNKS = "query int, item int, score double, ce double, text string, title string, clause string, section string, position int, parent_in_context boolean, entity string, intent string, wanted string, parameters array<string>"
ROWS = [
    (0, 0.9, "2.9.8: Cumin (Zeera) 1. Cumin whole means the dried fruit", "Food rules", "2.9.8", None, 0),
    (1, 0.5, "(i) Moisture not more than 10.0 percent by weight", "Food rules", "2.9.8", None, 1),
    (2, 0.95, "2.3.22: Ginger Cocktail shall conform to the standards", "Food rules", "2.3.22", None, 0),
    (3, 0.2, "Whoever sells is liable to a fine", "Act", None, "51", None),
    (4, 0.1, None, None, None, None, None),
]


def pool(spark, intent, wanted, entity="cumin", parameters=("moisture",)):
    rows = [(1, i, s, None, t, n, c, x, p, i == 1, entity, intent, wanted, list(parameters)) for i, s, t, n, c, x, p in ROWS]
    return P.provision_metadata(spark.createDataFrame(rows, CHUNKS), V)


def test_metadata(spark):
    got = {r.item: r for r in pool(spark, "food_standard", "standard").collect()}
    assert [(got[i].commodity, got[i].document_role, got[i].provision_type, got[i].section_key, got[i].table) for i in range(5)] == [
        ("cumin", "definition", "definition", "2.9.8", "unknown"), ("unknown", "standard", "food_standard", "2.9.8", "requirements table (1 rows)"), ("ginger cocktail", "standard", "food_standard", "2.3.22", "unknown"),
        ("unknown", "penalty", "penalty", "51", "unknown"), ("unknown", "general", "general", "unknown", "unknown"),
    ]


def test_features_and_order(spark):
    rows = {r.item: r for r in P.legal_features(pool(spark, "food_standard", "standard"), V).collect()}
    assert [rows[i].f_entity for i in range(5)] == [1.0, 0.9, 0.0, 0.0, 0.0]
    assert [rows[i].f_intent for i in range(5)] == [0.0, 1.0, 1.0, 0.3, 0.3]
    assert [rows[i].f_prov for i in range(5)] == [0.4, 1.0, 1.0, 0.1, 0.5]
    assert [rows[i].f_legal for i in range(5)] == [0.6, 0.6, 0.6, 0.6, 0.0]
    assert [rows[i].f_param for i in range(5)] == [0.0, 1.0, 0.0, 0.0, 0.0]
    assert rows[1].f_parent == 1.0 and rows[2].f_lex == 0.0 and rows[1].f_lex == pytest.approx(1 / 3)
    ranked = P.legal_rerank(pool(spark, "food_standard", "standard"), V, 5).orderBy("rank").collect()
    assert ranked[0].item == 1
    assert all(r.score <= P.FOREIGN_CAP for r in ranked if r.item in (2, 3, 4))
    defined = P.legal_rerank(pool(spark, "definition", "definition"), V, 5).orderBy("rank").collect()
    assert defined[0].item == 0
    free = P.legal_rerank(pool(spark, "penalty", "penalty", entity=None, parameters=()), V, 2).orderBy("rank").collect()
    assert len(free) == 2 and {r.item for r in free} & {3}
