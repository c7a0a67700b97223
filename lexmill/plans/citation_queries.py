"""Citations by class, statutes, amendment notices, list numbers, typed cells and context precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import extract as X
from lexmill.functions import lexical as L
from lexmill.functions import text as T
from lexmill.operators import filters as P
from lexmill.plans._registering import register
from lexmill.plans.retrieval_queries import _tokens

#: Documents hold no citations, so each text is read with some of its own behind it.
CITING = "coalesce(text, '') || ' See (' || (2000 + doc_id % 20) || ' SC ' || doc_id || '/7), (High Court ' || doc_id || '/2011), Section ' || (1 + doc_id % 90) || '(2), clause 4, 0' || (1 + doc_id % 9) || '/03/2012 to 01/04/2013, 5 March 2014; A ' || doc_id || '/2019.'"


def _in_duckdb(form: str | None) -> str:
    return "trim(m, '()')" if form is None else f"trim(regexp_replace(m, '(?i)^{{p}}$', '{form.replace('$', chr(92))}'))"


def _citation_sql() -> str:
    parts = []
    for kind, confidence, pattern, form in X.CITATIONS:
        p = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{kind}' AS kind, {confidence}::DOUBLE AS confidence, m AS source, {_in_duckdb(form).replace('{p}', p)} AS normalized FROM (SELECT doc_id, unnest(regexp_extract_all(t, '(?i){p}', 0)) AS m FROM d)")
    return f"WITH d AS (SELECT doc_id, {CITING} AS t FROM documents) " + " UNION ALL ".join(parts)


@register("citation_classes", _citation_sql(), "documents")
def citation_classes(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", X.citations_by_class(F.expr(CITING)).alias("c"))
    return found.select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.*")


@register("statute_citations", r"SELECT doc_id, 'statutory' AS kind, 0.8::DOUBLE AS confidence, 'Food Safety and ' || upper(lang[1]) || substr(lang, 2) || ' Act' AS source FROM documents WHERE regexp_matches(lang, '^[a-z]{2,}$')", "documents")
def statute_citations(docs: DataFrame) -> DataFrame:
    """Statutes that a whole text and a stated sentence behind it name: one after the document's language, once though named twice; a bare "the Act" is none."""
    name = F.concat(F.lit(" Food Safety and "), F.initcap("lang"), F.lit(" Act"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" under"), name, F.lit("; of the Act. and"), name, F.lit(", not"), F.lower(name))
    return docs.where("lang RLIKE '^[a-z]{2,}$'").select("doc_id", F.explode(X.statutes_cited(text)).alias("c")).select("doc_id", "c.*")


@register("amendment_prose", """SELECT doc_id, regexp_matches(t, '(?i)(for the words|shall be substituted|the following section shall be substituted|and after the words|in the marginal heading)') AS amends
FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' In section 63, For the Words "x"' WHEN 1 THEN ' the words shall stand' WHEN 2 THEN ' it SHALL BE SUBSTITUTED' ELSE '' END AS t FROM documents)""", "documents")
def amendment_prose(docs: DataFrame) -> DataFrame:
    r = F.col("doc_id") % 4
    tail = F.when(r == 0, ' In section 63, For the Words "x"').when(r == 1, " the words shall stand").when(r == 2, " it SHALL BE SUBSTITUTED").otherwise("")
    return docs.select("doc_id", X.is_amendment_prose(F.concat(F.coalesce("text", F.lit("")), tail)).alias("amends"))


@register("renumbered_lists", """SELECT page_id, md5(html || '<ol class="justify"><li>a<li>b</ol><ol><li>c</ol><ol class="justify" start="3"><li>d</ol><ol class="justify" start=''7''></ol>') AS hash FROM pages""", "pages")
def renumbered_lists(pages: DataFrame) -> DataFrame:
    """Every page, its own lists included, with four behind: two that count, one of another class, an empty one."""
    lists = """<ol class="justify"><li>a<li>b</ol><ol><li>c</ol><ol class="justify" start="9"><li>d</ol><ol class="justify" start='7'></ol>"""
    out = X.renumbered_lists(F.concat("html", F.lit(lists)))
    return pages.select("page_id", F.md5(out).alias("hash"))


@register("tagged_json_cells", """SELECT o_orderkey, '{"__type__":"datetime","value":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"}' AS at, '{"__type__":"date","value":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' AS day,
'{"__type__":"decimal","value":"' || (o_totalprice::DECIMAL(14, 2))::VARCHAR || '"}' AS price, '{"__type__":"bytes","value":"' || base64(o_orderpriority::BLOB) || '"}' AS raw, '"' || o_orderstatus || '"' AS plain FROM orders""", "orders")
def tagged_json_cells(orders: DataFrame) -> DataFrame:
    day, at = F.to_date("o_orderdate"), F.col("o_orderdate")
    return orders.select("o_orderkey", T.tagged_json(at, "timestamp").alias("at"), T.tagged_json(day, "date").alias("day"), T.tagged_json(F.col("o_totalprice").cast("decimal(14,2)"), "decimal").alias("price"), T.tagged_json(F.col("o_orderpriority").cast("binary"), "binary").alias("raw"), T.tagged_json(F.col("o_orderstatus")).alias("plain"))


@register("located_rows", "SELECT c_custkey, c_acctbal / 100 AS lat, nullif(c_nationkey, 3)::DOUBLE AS lng FROM customer WHERE c_acctbal >= 0 AND c_nationkey <> 3", "customer")
def located_rows(customer: DataFrame) -> DataFrame:
    rows = customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100).alias("lat"), F.nullif("c_nationkey", F.lit(3)).cast("double").alias("lng"))
    return P.located(rows, "lat", "lng")


@register("half_covering_turns", f"""WITH q AS (SELECT conv_id, turn, {_tokens('text')} AS x, lower(text) AS low FROM conversations), a AS (SELECT * FROM q WHERE turn = 0)
SELECT conv_id, count(*) AS total, count(*) FILTER (hit) AS relevant, round(count(*) FILTER (hit) / count(*), 6) AS precision FROM
(SELECT q.conv_id, len(a.x) > 0 AND len(list_filter(a.x, lambda t: contains(q.low, t))) >= 0.5 * len(a.x) AS hit FROM q JOIN a ON q.conv_id = a.conv_id WHERE q.turn > 0) GROUP BY 1""", "conversations")
def half_covering_turns(conv: DataFrame) -> DataFrame:
    """Share of a conversation's later turns that hold half of the content tokens of its first."""
    first = conv.where("turn = 0").select("conv_id", L.content_tokens(F.col("text")).alias("needles"))
    hit = conv.where("turn > 0").join(first, "conv_id").select("conv_id", (L.token_coverage(F.col("needles"), F.col("text")) >= 0.5).alias("hit"))
    n, relevant = F.count("*"), F.count_if("hit")
    return hit.groupBy("conv_id").agg(n.alias("total"), relevant.alias("relevant"), F.round(relevant / n, 6).alias("precision"))
