"""Contradictions in conversations, robust levels for orders, fields of several sources, reviews of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import provision_features as V
from lexmill.operators import review as R
from lexmill.plans._registering import register

_SAID = "text || CASE (conv_id + turn) % 5 WHEN 0 THEN ' A fine of Rs. ' || (100 * (turn % 3 + 1)) || ' is due.' WHEN 1 THEN ' This shall not be sold.' WHEN 2 THEN ' It may be sold.' WHEN 3 THEN ' Up to ' || (turn % 4) || '% of Rs. 200 is due.' ELSE '' END"


@register("evidence_conflicts", rf"""WITH p AS (SELECT conv_id, turn, turn % 2 AS section, {_SAID} AS t FROM conversations WHERE text IS NOT NULL),
v AS (SELECT *, list_distinct(list_transform(regexp_extract_all(t, '(?i)\b(Rs\.|₹|INR)\s*([\d,]+(\.\d+)?)', 0), lambda m: regexp_replace(m, '\s', '', 'g')) || regexp_extract_all(t, '\b(\d+(\.\d+)?)\s*%', 1)) AS v,
regexp_matches(t, '(?i)\b(no person shall|shall not\s+(\w+\s+){{0,3}}?(be\s+)?(added|sold|used|manufactured|imported)|prohibited)\b') AS no, regexp_matches(t, '(?i)\b(may\s+(be\s+)?(added|sold|used|manufactured|imported|permitted)|shall be permitted|is permitted|are permitted|allowed)\b') AS yes FROM p),
m AS (SELECT a.conv_id AS query, a.section, a.turn AS a, b.turn AS b, len(a.v) > 0 AND len(b.v) > 0 AND len(list_intersect(a.v, b.v)) = 0 AS numeric, a.no AND b.yes AS barred, list_sort(list_distinct(a.v || b.v))[1:4] AS v FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.section = b.section AND a.turn < b.turn)
SELECT query, section, a, b, CASE WHEN numeric THEN 'numeric' ELSE 'prohibition' END AS kind, CASE WHEN numeric THEN array_to_string(v, ' ') ELSE '' END AS values FROM m WHERE numeric OR barred""", "conversations")
def evidence_conflicts(conv: DataFrame) -> DataFrame:
    """Turns of a conversation as its pool, odd and even ones as sections, with stated amounts, bans and permissions behind their texts."""
    pool = conv.where("text IS NOT NULL").select(F.col("conv_id").alias("query"), F.col("turn").alias("item"), (F.col("turn") % 2).alias("section"), F.expr(_SAID).alias("text"))
    return R.contradictions(pool).withColumn("values", F.array_join("values", " "))


_PAYOFFS = ((0, "comply", 0, 1.0), (0, "ignore", 1, -2.0), (0, "appeal", 2, 0.0), (1, "comply", 0, 2.0), (1, "ignore", 1, -0.5), (1, "appeal", 2, -0.5), (2, "comply", 0, 1.5), (2, "ignore", 1, 1.0), (2, "appeal", 2, -1.0), (3, "comply", 0, 0.5), (3, "ignore", 1, 0.5), (3, "appeal", 2, 0.25))
_PROFILES = ((0, 1.0, 0.3), (1, 0.9, 0.6), (2, 0.5, 0.5), (3, 0.1, 0.2))
_FLOOR = "CASE WHEN l_returnflag <> 'A' THEN l_linenumber % 4 END"


@register("robust_choice", f"""WITH p AS (SELECT * FROM (VALUES {', '.join(map(str, _PAYOFFS))}) v(level, answer, place, value)), f AS (SELECT * FROM (VALUES {', '.join(map(str, _PROFILES))}) v(level, reversibility, information)),
w AS (SELECT level, arg_min(answer, (value, place)) AS answer, min(value)::DOUBLE AS maximin FROM p GROUP BY 1), l AS (SELECT level, answer, maximin, round(maximin + 0.5 * round(reversibility * information - 1.5 * (1 - reversibility), 6), 6)::DOUBLE AS robust FROM w JOIN f USING (level)),
c AS (SELECT l_orderkey * 10 + l_linenumber AS "case", {_FLOOR} AS floor FROM lineitem),
m AS (SELECT "case", level, answer, maximin, robust, row_number() OVER (PARTITION BY "case" ORDER BY robust DESC NULLS LAST, level) AS r FROM c LEFT JOIN l ON floor <= level)
SELECT "case", max(level) FILTER (r = 1) AS level, max(answer) FILTER (r = 1) AS answer, max(maximin) FILTER (r = 1) AS maximin, max(robust) FILTER (r = 1) AS robust, round(max(robust) FILTER (r = 1) - max(robust) FILTER (r = 2), 3) AS margin FROM m GROUP BY 1""", "lineitem")
def robust_choice(lineitem: DataFrame) -> DataFrame:
    """Each line is a case whose number gives the floor; those of one flag have no anchor and abstain."""
    spark = lineitem.sparkSession
    levels = R.robust_levels(spark.createDataFrame(list(_PAYOFFS), "level int, answer string, place int, value double"), spark.createDataFrame(list(_PROFILES), "level int, reversibility double, information double"), 1.5, 0.5)
    cases = lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case"), F.expr(_FLOOR).cast("int").alias("floor"))
    return R.chosen_levels(cases, levels)


@register("authoritative_fields", """WITH f AS (SELECT o_orderkey AS document, 'status' AS field, o_orderstatus AS value, 'ocr' AS source, 1 AS stamp FROM orders UNION ALL SELECT o_orderkey, 'status', CASE WHEN o_orderkey % 3 = 0 THEN 'X' WHEN o_orderkey % 3 = 1 THEN o_orderstatus END, 'manual', 2 FROM orders
UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, 'lab', 1 FROM orders UNION ALL SELECT o_orderkey, 'priority', '1-URGENT', 'guess', 5 FROM orders WHERE o_orderkey % 2 = 0)
SELECT document, field, arg_max(value, (CASE source WHEN 'manual' THEN 3 WHEN 'lab' THEN 2 WHEN 'ocr' THEN 1 ELSE -1 END, stamp, value, source)) AS value, arg_max(source, (CASE source WHEN 'manual' THEN 3 WHEN 'lab' THEN 2 WHEN 'ocr' THEN 1 ELSE -1 END, stamp, value, source)) AS source,
count(DISTINCT source) AS sources, count(DISTINCT source) > 1 AND count(DISTINCT value) > 1 AS conflict FROM f WHERE value IS NOT NULL GROUP BY 1, 2""", "orders")
def authoritative_fields(orders: DataFrame) -> DataFrame:
    row = lambda df, field, value, source, at: df.select(F.col("o_orderkey").alias("document"), F.lit(field).alias("field"), value.alias("value"), F.lit(source).alias("source"), F.lit(at).alias("at"))
    manual = F.when(F.col("o_orderkey") % 3 == 0, "X").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus"))
    parts = [row(orders, "status", F.col("o_orderstatus"), "ocr", 1), row(orders, "status", manual, "manual", 2), row(orders, "priority", F.col("o_orderpriority"), "lab", 1), row(orders.where("o_orderkey % 2 = 0"), "priority", F.lit("1-URGENT"), "guess", 5)]
    fields = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return R.authoritative(fields, {"manual": 3, "lab": 2, "ocr": 1})


_ANSWER = "coalesce(text, '') || ' Use Form ' || (turn % 3) || 'A and Form B' || (conv_id % 2) || '. Pay the fee.'"
_EXPECTED = "'1. Pay the fee' || chr(10) || '2) ' || coalesce(substr(text, 1, 20), 'nothing') || chr(10) || '3. Wait for ' || turn || ' days. Form 1A, Form B1'"


@register("answer_reviews", rf"""WITH a AS (SELECT conv_id * 1000 + turn AS query, {_ANSWER} AS answer, {_EXPECTED} AS expected FROM conversations),
f AS (SELECT query, answer, list_sort(list_distinct(regexp_extract_all(expected, '\bForm\s+([A-Z]{{1,3}}-?\d*|\d+[A-Z]?)\b', 1))) AS e, list_sort(list_distinct(regexp_extract_all(answer, '\bForm\s+([A-Z]{{1,3}}-?\d*|\d+[A-Z]?)\b', 1))) AS g, list_transform(regexp_extract_all(expected, '(?m)^\s*\d+[.)]\s*(.+)$', 1), lambda s: lower(trim(s))) AS s FROM a),
d AS (SELECT query, list_filter(e, lambda x: NOT list_contains(g, x)) AS m, list_filter(g, lambda x: NOT list_contains(e, x)) AS x, list_filter(s, lambda y: NOT contains(lower(answer), y)) AS s FROM f)
SELECT query, array_to_string(m, ',') AS missing_forms, array_to_string(x, ',') AS extra_forms, len(s)::INTEGER AS missing_steps, array_to_string(list_filter([CASE WHEN len(m) > 0 THEN 'critical:form_retrieval' END, CASE WHEN len(x) > 0 THEN 'critical:hallucination' END, CASE WHEN len(s) > 0 THEN 'moderate:step_coverage' END], lambda z: z IS NOT NULL), ',') AS recommendations FROM d""", "conversations")
def answer_reviews(conv: DataFrame) -> DataFrame:
    """Each turn with stated forms behind it as an answer, against stated steps, one of which is what the turn begins with."""
    answers = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), F.expr(_ANSWER).alias("answer"), F.expr(_EXPECTED).alias("expected"))
    found = R.answer_reviews(answers)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("query", joined("missing_forms"), joined("extra_forms"), F.size("missing_steps").alias("missing_steps"), joined("recommendations"))


_WORDS = V.Vocabulary(("cumin", "ginger", "masala", "milk", "mixed masala", "ice cream"), ("cocktail", "paste"), ("black", "white"), ("pan", "garam"), ("whole", "powder", "ground"))
_KINDS = ("2.9.8: Cumin (Zeera) 1. Cumin whole means the dried fruit. ", "(i) Moisture not more than 10.0 percent by weight. ", "2.3.22: Ginger Cocktail shall conform to the standards. ", "Whoever sells is liable to a fine. ", "")


def provision_pool(conv: DataFrame) -> DataFrame:
    """Turns as a conversation's pool, each with a stated provision before its text; the question turns on the conversation's number."""
    kind = F.col("turn") % 5
    opening = F.get(F.array(*map(F.lit, _KINDS)), kind.cast("int"))
    intents = F.array(*map(F.lit, ("food_standard", "definition", "penalty", "parameter_specific_standard")))
    intent = F.get(intents, (F.col("conv_id") % 4).cast("int"))
    return conv.select(
        F.col("conv_id").alias("query"), F.col("turn").alias("item"), (F.length("text") % 97 / 97.0).alias("score"), F.lit(None).cast("double").alias("ce"), F.concat(opening, F.coalesce("text", F.lit(""))).alias("text"), F.lit("Food rules").alias("title"),
        F.when(kind < 2, "2.9.8").when(kind == 2, "2.3.22").alias("clause"), F.when(kind == 3, "51").alias("section"), F.when(kind < 3, kind % 2).cast("int").alias("position"), (kind == 1).alias("parent_in_context"),
        F.when(F.col("conv_id") % 3 < 2, "cumin").alias("entity"), intent.alias("intent"), F.when(intent == "penalty", "penalty").when(intent == "definition", "definition").otherwise("standard").alias("wanted"), F.array(F.lit("moisture")).alias("parameters"),
    )


@register("provision_fields", None, "conversations")
def provision_fields(conv: DataFrame) -> DataFrame:
    return V.provision_metadata(provision_pool(conv), _WORDS).select("query", "item", "commodity", "document_role", "provision_type", "section_key", "table", "has_measurement", "row_count")


@register("legal_reranked", None, "conversations")
def legal_reranked(conv: DataFrame) -> DataFrame:
    """The best three turns by all legal features; tests/test_provision_features.py has the rules."""
    return V.legal_rerank(V.provision_metadata(provision_pool(conv), _WORDS), _WORDS, 3)
