"""Full-text search over documents: an index is written, and expressions made of benchmark passages are searched in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import fulltext as T
from lexmill.operators import iterative as I
from lexmill.operators import retrieval as R
from lexmill.plans._registering import register
from lexmill.plans.retrieval_queries import query_terms
from lexmill.sources.lookup import build_lookup
from lexmill.sources.shared import saved, shared_folder

_WORDS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"


def expressions(benchmark: DataFrame) -> DataFrame:
    """Of words 1 to 6 of each passage: both of the first two, or the phrase of the next two with what the fifth begins with and without the sixth."""
    w = F.filter(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    made = F.concat(F.get(w, 0), F.lit(" "), F.get(w, 1), F.lit(' OR "'), F.get(w, 2), F.lit(" "), F.get(w, 3), F.lit('" '), F.substring(F.get(w, 4), 1, 3), F.lit("* NOT "), F.get(w, 5))
    return benchmark.where(F.size(w) >= 6).select(F.col("item_id").alias("query"), made.alias("expression"))


def indexed(docs: DataFrame, stemmed: bool) -> T.TextIndex:
    return T.build_index(docs, f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}", "doc_id", F.col("text"), stemmed, range_items=1 << 12, classes=16)


FTS_SQL = f"""WITH d AS (SELECT doc_id AS item, {_WORDS.format("coalesce(text, '')")} AS t FROM documents),
st AS (SELECT count(*) AS total, avg(len(t)) AS mean FROM d WHERE len(t) > 0),
b AS (SELECT item_id AS query, {_WORDS.format('text')} AS w FROM benchmark),
q AS (SELECT query, w[1] AS a, w[2] AS b, w[3] AS c, w[4] AS d, substr(w[5], 1, 3) AS p, w[6] AS x FROM b WHERE len(w) >= 6),
o AS (SELECT item, len, term, i FROM (SELECT item, len(t) AS len, unnest(t) AS term, unnest(range(len(t))) AS i FROM d)),
v AS (SELECT DISTINCT term FROM o),
w AS (SELECT DISTINCT query, unnest([a, b, c, d, x]) AS term FROM q UNION SELECT query, term FROM q JOIN v ON starts_with(term, p)),
k AS (SELECT term, item, len, count(*) AS tf, list(i) AS places FROM o WHERE term IN (SELECT term FROM w) GROUP BY 1, 2, 3),
f AS (SELECT term, ln(1 + (total - n + 0.5) / (n + 0.5)) AS idf FROM (SELECT term, count(*) AS n FROM k GROUP BY 1), st),
s AS (SELECT k.term, item, len, places, idf, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS s FROM k JOIN f USING (term), st),
u AS (SELECT query, item, 'a' AS part, s FROM q JOIN s ON term = a UNION ALL SELECT query, item, 'b', s FROM q JOIN s ON term = b AND b <> a
  UNION ALL SELECT query, item, 'p', sum(s) FROM q JOIN s ON starts_with(term, p) GROUP BY 1, 2
  UNION ALL SELECT query, item, 'x', 0 FROM q JOIN s ON term = x
  UNION ALL SELECT query, item, 'c', idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) FROM (SELECT query, y.item, y.len, len(list_filter(y.places, lambda i: list_contains(z.places, i + 1))) AS tf, y.idf + z.idf AS idf FROM q JOIN s y ON y.term = c JOIN s z ON z.term = d AND z.item = y.item), st WHERE tf > 0),
h AS (SELECT query, item, list(part) AS parts, sum(s) AS score FROM u GROUP BY 1, 2),
m AS (SELECT query, item, round(score, 6) AS score FROM h JOIN q USING (query) WHERE list_contains(parts, 'a') AND (a = b OR list_contains(parts, 'b')) OR list_contains(parts, 'c') AND list_contains(parts, 'p') AND NOT list_contains(parts, 'x'))
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS rank, score FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 10"""


@register("fts_search", FTS_SQL, "documents", "benchmark")
def fts_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return T.search(indexed(docs, False), expressions(benchmark), 10, digits=6)


@register("fts_stemmed", None, "documents", "benchmark")
def fts_stemmed(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same expressions over stems; stemming has no SQL, tests hold it against a slow search."""
    return T.search(indexed(docs, True), expressions(benchmark), 10)


@register("iterative_retrieval", None, "documents", "benchmark")
def iterative_retrieval(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each passage needs evidence in three languages, its own first; a language that is missing is asked for by its most common content word."""
    tokens = R.tokenised(docs, "doc_id", F.col("text"))
    langs = docs.select(F.col("doc_id").alias("item"), F.col("lang").alias("kind")).where("kind IS NOT NULL")
    common = tokens.join(langs, "item").select("kind", F.explode(F.array_distinct("t")).alias("term")).groupBy("kind", "term").agg(F.count("*").alias("n"))
    gap_terms = saved(common.groupBy("kind").agg(F.min_by("term", F.struct(-F.col("n"), "term")).alias("term")))
    terms = query_terms(benchmark).distinct()
    kinds = F.posexplode(F.array(*map(F.lit, ("en", "fr", "de")))).alias("priority", "kind")
    evidence, report = I.iterate(terms, benchmark.select(F.col("item_id").alias("query"), kinds), gap_terms, lambda asked: R.bm25(tokens, asked, 20).join(langs, "item").select("query", "item", "kind", "score"), 3, 0.9, 20, 5)
    return evidence.join(report, "query").select("query", "item", "kind", F.round("score", 6).alias("score"), "place", "rounds", F.round("coverage", 6).alias("coverage"), F.array_join("gaps", ",").alias("gaps"))


@register("payload_lookup", """WITH a AS (SELECT c_custkey AS k, 'customer' AS collection, 0 AS position, c_name AS name FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT s_suppkey, 'supplier', 1, s_name FROM supplier UNION ALL SELECT p_partkey, 'part', 2, p_name FROM part),
w AS (SELECT DISTINCT o_custkey AS k FROM orders UNION SELECT 1000000000)
SELECT k::VARCHAR AS id, arg_max(collection, position) AS collection, arg_max(name, position) AS name FROM a JOIN w USING (k) GROUP BY 1""", "customer", "supplier", "part", "orders")
def payload_lookup(customer: DataFrame, supplier: DataFrame, part: DataFrame, orders: DataFrame) -> DataFrame:
    """Payloads of the customers of all orders, from the last of three collections that has their number."""
    of = lambda df, key, name: df.select(F.col(key).alias("key"), F.col(name).alias("name"))
    collections = {"customer": of(customer.where("c_custkey % 3 > 0"), "c_custkey", "c_name"), "supplier": of(supplier, "s_suppkey", "s_name"), "part": of(part, "p_partkey", "p_name")}
    lookup = build_lookup(collections, f"{shared_folder(orders.sparkSession)}/{uuid.uuid4().hex}", "key")
    wanted = orders.select(F.col("o_custkey").alias("id")).union(orders.sparkSession.createDataFrame([(10**9,)], "id long"))
    return lookup.payloads(wanted).select("id", "collection", F.get_json_object("payload", "$.name").alias("name"))
