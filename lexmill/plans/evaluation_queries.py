"""Ingestion in batches, and the evaluation of what was retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import lexical as L
from lexmill.operators import audit as A
from lexmill.operators import ingest as I
from lexmill.operators import scheduling as C
from lexmill.plans._registering import register
from lexmill.plans.retrieval_queries import _tokens
from lexmill.sources.shared import saved

_CLEAN = "trim(regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g'))"


def _ingest_sql(name: str, where: str, before: str | None) -> str:
    docs_before = f" AND md5(clean) NOT IN (SELECT doc_hash FROM {before})" if before else ""
    chunks_before = f" WHERE chunk_hash NOT IN (SELECT chunk_hash FROM {before})" if before else ""
    return f"""{name}_d AS (SELECT doc_id AS document, clean, md5(clean) AS doc_hash FROM (SELECT doc_id, {_CLEAN} AS clean FROM documents {where}) WHERE clean <> ''{docs_before} QUALIFY row_number() OVER (PARTITION BY md5(clean) ORDER BY doc_id) = 1),
{name}_c AS (SELECT document, doc_hash, place::INTEGER AS place, chunk, md5(chunk) AS chunk_hash FROM (SELECT *, substr(clean, place * {I.CHUNK_CHARS} + 1, {I.CHUNK_CHARS}) AS chunk FROM (SELECT *, unnest(range((length(clean) - 1) // {I.CHUNK_CHARS} + 1)) AS place FROM {name}_d)) WHERE length(chunk) >= {I.LEAST_CHARS} AND regexp_matches(chunk, '[A-Za-z]')),
{name} AS (SELECT document, doc_hash, place, chunk_hash, length(chunk)::INTEGER AS n_chars FROM {name}_c{chunks_before} QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY document, place) = 1)"""


@register("ingested_documents", f"WITH {_ingest_sql('r', '', None)} SELECT * FROM r", "documents")
def ingested_documents(docs: DataFrame) -> DataFrame:
    return I.ingest(docs, "doc_id", "text").drop("chunk")


@register("ingested_later", f"WITH {_ingest_sql('a', 'WHERE doc_id % 3 < 2', None)}, {_ingest_sql('b', '', 'a')} SELECT * FROM b", "documents")
def ingested_later(docs: DataFrame) -> DataFrame:
    """A run over everything after a run over two thirds: only what is new."""
    before = saved(I.ingest(docs.where("doc_id % 3 < 2"), "doc_id", "text").drop("chunk"))
    return I.ingest(docs, "doc_id", "text", before).drop("chunk")


_ASKED = f"""t AS (SELECT conv_id, turn, role, length(text) AS n_chars, {_tokens('text')} AS t FROM conversations),
asked AS (SELECT t.*, q FROM t JOIN (SELECT conv_id, arg_min(t, turn) AS q, min(turn) AS f FROM t GROUP BY 1) USING (conv_id) WHERE turn > f)"""
_COVER = "CASE WHEN len(list_distinct(q)) > 0 THEN len(list_intersect(list_distinct(q), t)) / len(list_distinct(q)) ELSE 0.0 END"


@register("token_coverage", f"WITH {_ASKED} SELECT conv_id, turn, round({_COVER}, 9) AS coverage FROM asked", "conversations")
def token_coverage(turns: DataFrame) -> DataFrame:
    return I.asked(turns).select("conv_id", "turn", F.round(I.distinct_coverage(F.col("q"), F.col("t")), 9).alias("coverage"))


@register("context_precision", f"WITH {_ASKED} SELECT conv_id, count(*) AS turns, count(*) FILTER ({_COVER} >= 0.1) AS covering, round(avg(({_COVER} >= 0.1)::INT), 9) AS precision FROM asked GROUP BY 1", "conversations")
def context_precision(turns: DataFrame) -> DataFrame:
    """Share of turns that cover so much of the first; a tenth here, as invented prose repeats few words."""
    covers = I.distinct_coverage(F.col("q"), F.col("t")) >= 0.1
    return I.asked(turns).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(covers).alias("covering"), F.round(F.avg(covers.cast("int")), 9).alias("precision"))


_FEATURES = f"round(0.6 * ({_COVER}) + 0.3 / turn + 0.1 * least(n_chars, 500) / 500, 9)"


@register("feature_rerank", f"WITH {_ASKED} SELECT conv_id, turn, {_FEATURES} AS score, row_number() OVER (PARTITION BY conv_id ORDER BY {_FEATURES} DESC, turn)::INTEGER AS rank FROM asked WHERE turn > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY {_FEATURES} DESC, turn) <= 3", "conversations")
def feature_rerank(turns: DataFrame) -> DataFrame:
    """Weighted features of each turn: coverage of the question, earliness, length. The best three stay."""
    score = F.round(0.6 * I.distinct_coverage(F.col("q"), F.col("t")) + 0.3 / F.col("turn") + 0.1 * F.least(F.col("n_chars"), F.lit(500)) / 500, 9)
    scored = I.asked(turns).where("turn > 0").select("conv_id", "turn", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn"))).where("rank <= 3")


@register("coverage_order", f"WITH {_ASKED} SELECT conv_id, list(turn ORDER BY round(({_COVER}) / turn, 9) DESC, turn) AS turns FROM asked WHERE turn > 0 GROUP BY 1", "conversations")
def coverage_order(turns: DataFrame) -> DataFrame:
    """Turns of each conversation by coverage times relevance, their earliness."""
    priority = F.round(I.distinct_coverage(F.col("q"), F.col("t")) / F.col("turn"), 9)
    listed = I.asked(turns).where("turn > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-priority).alias("p"), "turn"))).alias("l"))
    return listed.select("conv_id", F.transform("l", lambda x: x["turn"]).alias("turns"))


@register("retrieval_verdict", f"""WITH {_ASKED} SELECT conv_id, concat_ws(',', CASE WHEN max({_COVER}) = 0 THEN 'nothing_covered' END, CASE WHEN max(n_chars) < 200 THEN 'too_short' END, CASE WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'no_answer' END) AS failures,
max({_COVER}) > 0 AND max(n_chars) >= 200 AND count(*) FILTER (role = 'assistant') > 0 AS answerable FROM asked GROUP BY 1""", "conversations")
def retrieval_verdict(turns: DataFrame) -> DataFrame:
    """Failure codes of each conversation, and whether it has none."""
    flags = I.asked(turns).groupBy("conv_id").agg((F.max(I.distinct_coverage(F.col("q"), F.col("t"))) == 0).alias("nothing_covered"), (F.max("n_chars") < 200).alias("too_short"), (F.count_if(F.col("role") == "assistant") == 0).alias("no_answer"))
    codes = F.concat_ws(",", *[F.when(F.col(c), c) for c in ("nothing_covered", "too_short", "no_answer")])
    return flags.select("conv_id", codes.alias("failures"), (codes == "").alias("answerable"))


@register("fallback_queries", f"""WITH b AS (SELECT item_id, list_distinct({_tokens('text')}) AS d, {_tokens('text')} AS t FROM benchmark)
SELECT item_id, unnest(['head', 'tail', 'rare']) AS kind, unnest([array_to_string(t[1:5], ' '), array_to_string(t[greatest(1, len(t) - 4):], ' '), (SELECT x FROM (SELECT unnest(d) AS x) ORDER BY length(x) DESC, x LIMIT 1)]) AS query FROM b WHERE len(t) > 0""", "benchmark")
def fallback_queries(benchmark: DataFrame) -> DataFrame:
    """Three queries to fall back on: the first five tokens, the last five, and the longest one; all there are of shorter items."""
    tokens = benchmark.select("item_id", L.content_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    longest = F.array_min(F.transform("t", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"]
    parts = {"head": F.array_join(F.slice("t", 1, 5), " "), "tail": F.array_join(F.slice("t", F.greatest(F.lit(1), F.size("t") - 4), F.lit(5)), " "), "rare": longest}
    return tokens.select("item_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("query")) for k, q in parts.items()])))


@register("retrieval_cache_keys", "SELECT item_id, md5(concat_ws('|', lower(trim(text)), '10', 'lang=' || CASE item_id % 2 WHEN 0 THEN 'en' ELSE 'de' END || '&source=s' || item_id % 3)) AS key FROM benchmark", "benchmark")
def retrieval_cache_keys(benchmark: DataFrame) -> DataFrame:
    filters = F.create_map(F.lit("source"), F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string")), F.lit("lang"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("de"))
    return benchmark.select("item_id", I.cache_key(F.lower(F.trim("text")), F.lit(10), filters=filters).alias("key"))


@register("tagged_cells", """SELECT o_orderkey, '{"type":"datetime","value":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '"}' AS ordered, '{"type":"Decimal","value":"' || o_totalprice::DECIMAL(18, 2) || '"}' AS price, '{"type":"bytes","value":"' || hex(encode(o_orderpriority)) || '"}' AS priority FROM orders""", "orders")
def tagged_cells(orders: DataFrame) -> DataFrame:
    cells = {"ordered": ("datetime", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), "price": ("Decimal", F.col("o_totalprice").cast("decimal(18,2)")), "priority": ("bytes", F.hex(F.col("o_orderpriority")))}
    return orders.select("o_orderkey", *[I.tagged(kind, value).alias(name) for name, (kind, value) in cells.items()])


@register("both_labels_known", "SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL", "documents", "labels")
def both_labels_known(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of which both coordinates are known; an inner join, as rows without a partner have neither."""
    known = labels.where("quality IS NOT NULL AND toxic IS NOT NULL")
    return docs.select("doc_id", "source").join(known, "doc_id").select("doc_id", "source", "quality", "toxic")


@register("restrained_level", """WITH b AS (SELECT l_orderkey, max((l_quantity, l_tax)) FILTER (l_returnflag = 'R') AS best FROM lineitem GROUP BY 1)
SELECT l_orderkey, any_value(best[2]) AS floor, min(l_tax) FILTER (l_tax >= best[2]) AS level FROM lineitem JOIN b USING (l_orderkey) GROUP BY 1""", "lineitem")
def restrained_level(lineitem: DataFrame) -> DataFrame:
    return I.restrained_level(lineitem, "l_orderkey", "l_tax", F.col("l_returnflag") == "R", F.col("l_quantity"))


#: (kind, task, cost, needs) of the questions of each priority.
PLAN_RULES = (
    ("1-URGENT", "understand", 1, []), ("1-URGENT", "retrieve", 3, ["understand"]), ("1-URGENT", "answer", 2, ["retrieve"]), ("1-URGENT", "cite", 1, ["answer"]),
    ("2-HIGH", "understand", 1, []), ("2-HIGH", "retrieve", 3, ["understand"]), ("2-HIGH", "expand", 2, ["understand"]), ("2-HIGH", "rank", 1, ["retrieve", "expand"]),
    ("2-HIGH", "answer", 2, ["rank"]), ("2-HIGH", "check", 4, ["retrieve"]), ("2-HIGH", "finish", 1, ["answer", "check"]),
    ("3-MEDIUM", "retrieve", 2, []), ("3-MEDIUM", "answer", 1, ["retrieve", "translate"]),
    ("4-NOT SPECIFIED", "understand", 1, []), ("4-NOT SPECIFIED", "retrieve", 5, ["understand"]), ("4-NOT SPECIFIED", "expand", 2, ["understand"]), ("4-NOT SPECIFIED", "rank", 2, ["expand"]), ("4-NOT SPECIFIED", "finish", 1, ["retrieve", "rank"]),
    ("5-LOW", "answer", 1, []),
)
_RULES = ", ".join(f"('{k}', '{t}', {c}, {needs!r})" if needs else f"('{k}', '{t}', {c}, []::VARCHAR[])" for k, t, c, needs in PLAN_RULES)


@register("plan_schedule", f"""WITH RECURSIVE r AS (SELECT * FROM (VALUES {_RULES}) v(kind, task, cost, needs)),
t AS (SELECT o_orderkey AS plan, task, (cost + CASE WHEN task = 'retrieve' THEN o_orderkey % 4 ELSE 0 END)::INTEGER AS cost, needs FROM orders JOIN r ON kind = o_orderpriority),
e AS (SELECT a.plan, a.task, a.need FROM (SELECT plan, task, unnest(needs) AS need FROM t) a JOIN t b ON b.plan = a.plan AND b.task = a.need),
f(plan, task, wave, fin) AS (SELECT plan, task, 0, cost FROM t WHERE (plan, task) NOT IN (SELECT (plan, task) FROM e) UNION SELECT e.plan, e.task, wave + 1, fin + t.cost FROM f JOIN e ON e.plan = f.plan AND e.need = f.task JOIN t ON t.plan = e.plan AND t.task = e.task),
b(plan, task, rest) AS (SELECT plan, task, 0 FROM t UNION SELECT e.plan, e.need, rest + t.cost FROM b JOIN e ON e.plan = b.plan AND e.task = b.task JOIN t ON t.plan = b.plan AND t.task = b.task),
g AS (SELECT plan, task, max(wave) AS wave, max(fin) AS fin FROM f GROUP BY 1, 2), l AS (SELECT plan, task, max(rest) AS rest FROM b GROUP BY 1, 2), w AS (SELECT plan, max(fin) AS whole FROM g GROUP BY 1)
SELECT plan, task, cost, wave, (fin - cost)::BIGINT AS start, fin::BIGINT AS end, (whole - rest - fin)::BIGINT AS slack, whole = rest + fin AS critical FROM t JOIN g USING (plan, task) JOIN l USING (plan, task) JOIN w USING (plan)""", "orders")
def plan_schedule(orders: DataFrame) -> DataFrame:
    """Each order is a question whose priority says which tasks it takes; retrieving takes longer for some."""
    rules = orders.sparkSession.createDataFrame(list(PLAN_RULES), "kind string, task string, cost int, needs array<string>")
    tasks, edges = C.planned(orders.select(F.col("o_orderkey").alias("plan"), F.col("o_orderpriority").alias("kind")), rules)
    cost = F.col("cost") + F.when(F.col("task") == "retrieve", F.col("plan") % 4).otherwise(0)
    return C.scheduled(tasks.withColumn("cost", cost.cast("int")), edges)


@register("audit_increments", f"""WITH c AS (SELECT *, coalesce(text, '') AS t FROM documents)
SELECT count(*) AS total_chunks, count(*) FILTER (NOT regexp_matches(t, '\\S')) AS empty_chunks, count(*) FILTER (regexp_matches(t, '\\S') AND length(t) < {A.SHORT}) AS unusually_short_chunks, count(*) FILTER (length(t) > {A.LONG}) AS unusually_long_chunks,
count(*) FILTER (lang IS NULL) AS missing_language, min(length(t))::BIGINT AS least_chars, max(length(t))::BIGINT AS most_chars, round(sum(length(t))::DOUBLE / count(*), 1) AS mean_chars, true AS ranks_within, true AS counts_within FROM c""", "documents")
def audit_increments(docs: DataFrame) -> DataFrame:
    """Four increments are audited by themselves and merged; estimates are held against the whole table, within their stated errors."""
    rows = saved(A.increments(docs, F.pmod(F.xxhash64("doc_id"), F.lit(4)), "doc_id", "source", "text", {"language": F.col("lang")}))
    found = saved(A.report(A.merged(rows)))
    chars = F.length(F.coalesce("text", F.lit("")))
    share = lambda q: F.abs(F.count_if(chars <= F.col(f"char_p{q}")) / F.count("*") - q / 100) <= A.RANK_ERROR + 1 / F.count("*")
    # One row, joined to every document for its ranks.
    near = docs.join(F.broadcast(found.select("char_p50", "char_p90", "different_ids", "different_documents"))).groupBy("char_p50", "char_p90", "different_ids", "different_documents").agg(
        (share(50) & share(90)).alias("ranks_within"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("source").alias("sources"),
    )
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= A.COUNT_ERROR * F.col(b) + 1
    checked = near.select("ranks_within", (close("different_ids", "ids") & close("different_documents", "sources")).alias("counts_within"))
    kept = ["total_chunks", "empty_chunks", "unusually_short_chunks", "unusually_long_chunks", "missing_language", "least_chars", "most_chars", "mean_chars"]
    return found.select(*kept).join(F.broadcast(checked))


@register("audit_exemplars", f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT 'unusually_long_chunks' AS metric, doc_id AS chunk_id, substr(t, 1, 140) AS snippet FROM c WHERE length(t) > {A.LONG}
UNION ALL SELECT 'unusually_short_chunks', doc_id, substr(t, 1, 140) FROM c WHERE regexp_matches(t, '\\S') AND length(t) < {A.SHORT} UNION ALL SELECT 'empty_chunks', doc_id, t FROM c WHERE NOT regexp_matches(t, '\\S'))
SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY chunk_id, snippet)::INTEGER AS rank, chunk_id, snippet FROM m QUALIFY row_number() OVER (PARTITION BY metric ORDER BY chunk_id, snippet) <= {A.EXEMPLARS}""", "documents")
def audit_exemplars(docs: DataFrame) -> DataFrame:
    return A.exemplars(docs, "doc_id", "text", {}).where("metric IN ('unusually_long_chunks', 'unusually_short_chunks', 'empty_chunks')")
