"""Grounding, claims, provisions, amendments, evidence and decision tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import lexical as L
from lexmill.functions import linediff as D
from lexmill.functions import text as T
from lexmill.operators import evidence as E
from lexmill.operators import metrics as M
from lexmill.operators import retrieval as R
from lexmill.plans._registering import register
from lexmill.plans.text_queries import PRESERVED_SQL


@register("concept_grounding", """SELECT doc_id, concept, synonym, strpos(lower(text), synonym)::INTEGER - 1 AS start, md5(substr(text, greatest(1, strpos(lower(text), synonym) - 60), least(strpos(lower(text), synonym) - 1, 60) + length(synonym) + 80)) AS evidence, CASE WHEN pos = 0 THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence
FROM documents JOIN (VALUES ('a', 0, 'tion'), ('a', 1, 'ing'), ('b', 0, 'ung'), ('b', 1, 'keit')) s(concept, pos, synonym) ON contains(lower(text), synonym) QUALIFY row_number() OVER (PARTITION BY doc_id, concept ORDER BY pos) <= 1""", "documents")
def concept_grounding(docs: DataFrame) -> DataFrame:
    synonyms = docs.sparkSession.createDataFrame([("a", 0, "tion"), ("a", 1, "ing"), ("b", 0, "ung"), ("b", 1, "keit")], "concept string, pos int, synonym string")
    return E.grounding(docs, "doc_id", "text", synonyms, 1).withColumn("evidence", F.md5("evidence"))


@register("linked_references", """WITH t AS (SELECT o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders), r AS (SELECT c_custkey AS case_id, unnest(['A', 'b', '2', '99']) AS ref FROM customer)
SELECT r.case_id, ref, CASE WHEN pos <= 26 THEN chr((64 + pos)::INTEGER) END AS letter, CASE WHEN pos <= 26 THEN true ELSE false END AS resolved FROM r LEFT JOIN t ON r.case_id = t.case_id AND pos <= 26 AND CASE ref WHEN 'A' THEN pos = 1 WHEN 'b' THEN pos = 2 WHEN '2' THEN pos = 2 ELSE pos = 99 END""", "orders", "customer")
def linked_references(orders: DataFrame, customer: DataFrame) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    targets = orders.select(F.col("o_custkey").alias("case_id"), pos.alias("pos")).where("pos <= 26").withColumn("letter", F.char(64 + F.col("pos")))
    refs = customer.select(F.col("c_custkey").alias("case_id"), F.explode(F.array(*map(F.lit, ("A", "b", "2", "99")))).alias("ref"))
    return E.linked_references(refs, targets)


def amended(part: DataFrame) -> DataFrame:
    words = F.when(F.col("p_size") % 3 == 0, " and was omitted in 2015.").when(F.col("p_size") % 3 == 1, " and repealed by the Act of 2020.").otherwise(".")
    return part.select("p_partkey", F.concat(F.lit("It was inserted in 2001"), words).alias("t"))


@register("amendment_chain", "SELECT p_partkey, 0 AS pos, 'inserted' AS action, 2001 AS year FROM part UNION ALL SELECT p_partkey, 1, CASE p_size % 3 WHEN 0 THEN 'omitted' ELSE 'repealed' END, CASE p_size % 3 WHEN 0 THEN 2015 ELSE 2020 END FROM part WHERE p_size % 3 < 2", "part")
def amendment_chain(part: DataFrame) -> DataFrame:
    return E.amendment_events(amended(part), "p_partkey", F.col("t"))


@register("temporal_state", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'omitted' ELSE 'current' END AS state FROM part", "part")
def temporal_state(part: DataFrame) -> DataFrame:
    return E.state_after(amendment_chain(part), "p_partkey", 2016)


@register("provision_bodies", "SELECT l_partkey % 20 AS document, l_suppkey % 7 AS section, min(l_orderkey) AS first, count(*) AS chunks, sum(length(l_returnflag || l_linestatus))::BIGINT AS body FROM lineitem GROUP BY 1, 2", "lineitem")
def provision_bodies(lineitem: DataFrame) -> DataFrame:
    chunks = lineitem.select((F.col("l_partkey") % 20).alias("document"), (F.col("l_suppkey") % 7).alias("section"), F.col("l_orderkey").alias("idx"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return E.provisions(chunks)


@register("payload_quality", "SELECT count(*) FILTER (body >= 40) AS injectable, count(*) FILTER (body < 40) AS stubs, round(count(*) FILTER (body < 40) / count(*), 4) AS stub_rate, quantile_disc(body, 0.5) AS median_body FROM (SELECT sum(length(l_returnflag || l_linestatus))::BIGINT AS body FROM lineitem GROUP BY l_partkey % 20, l_suppkey % 7)", "lineitem")
def payload_quality(lineitem: DataFrame) -> DataFrame:
    return E.payload_quality(provision_bodies(lineitem), 40)


@register("expanded_evidence", """WITH s AS (SELECT o_custkey AS query, min(o_orderkey) AS item FROM orders GROUP BY 1), p AS (SELECT o_custkey AS query, o_orderkey AS item FROM orders),
x AS (SELECT DISTINCT s.query, s.item + k AS item FROM s, unnest([1, 2, 3]) t(k) WHERE EXISTS (SELECT 1 FROM p WHERE p.query = s.query AND p.item = s.item + k)), u AS (SELECT query, item, 0 AS tier FROM s UNION ALL SELECT query, item, 1 FROM x)
SELECT query, item, tier, row_number() OVER (PARTITION BY query ORDER BY tier, item)::INTEGER AS rank FROM u QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, item) <= 3""", "orders")
def expanded_evidence(orders: DataFrame) -> DataFrame:
    pool = orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"))
    chosen = pool.groupBy("query").agg(F.min("item").alias("item"))
    links = pool.select(F.col("item").alias("src"), F.explode(F.array(*[F.col("item") + k for k in (1, 2, 3)])).alias("dst"))
    return E.expanded(chosen, pool, links, 3)


@register("claim_verdicts", None, "conversations")
def claim_verdicts(conv: DataFrame) -> DataFrame:
    claims = conv.where("role <> 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.col("conv_id").alias("query"), F.col("text").alias("claim"))
    chunks = conv.where("role = 'user'").select(F.col("conv_id").alias("query"), F.col("turn").alias("item"), "text")
    return E.verified(claims, chunks)


@register("faithfulness", None, "conversations")
def faithful(conv: DataFrame) -> DataFrame:
    return E.faithfulness(claim_verdicts(conv))


@register("sparse_vectors", None, "documents")
def sparse_vectors(docs: DataFrame) -> DataFrame:
    # Dealt out by document, texts are moved once; terms are counted, hashed and gathered where they lie.
    return E.sparse_vectors(R.postings(docs.select("doc_id", "text").repartition("doc_id"), "doc_id", F.col("text")))


_LISTED = "'4. a' || chr(10) || 'x' || chr(10) || '  7. b ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || '9. c' || chr(10) || '3.'"


@register("renumbered_paragraphs", rf"""WITH l AS (SELECT doc_id, i, l[i] AS x, regexp_matches(l[i], '^\s*\d+\.\s') AS m FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split({_LISTED}, chr(10)) AS l FROM documents))),
n AS (SELECT *, sum(m::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l)
SELECT doc_id, md5(string_agg(CASE WHEN m THEN regexp_extract(x, '^\s*') || k::INT || regexp_replace(x, '^\s*\d+', '') ELSE x END, chr(10) ORDER BY i)) AS hash FROM n GROUP BY 1""", "documents")
def renumbered(docs: DataFrame) -> DataFrame:
    """Whole texts between stated items of a list."""
    return docs.select("doc_id", F.md5(E.renumbered_lines(F.expr(_LISTED.replace("chr(10)", "char(10)")))).alias("hash"))


_WANTED = "'1. Apply' || chr(10) || '2. ' || coalesce(substr(text, 30, 12), 'none') || chr(10) || '3) File form ' || doc_id % 3"
_DONE = "coalesce(text, '') || CASE doc_id % 2 WHEN 0 THEN ' First APPLY, then file form 1.' ELSE ' File form 2.' END"


@register("missing_steps", rf"""WITH d AS (SELECT doc_id, lower({_DONE}) AS said, list_transform(regexp_extract_all({_WANTED}, '(?m)^\s*\d+[.)]\s*(.+)$', 1), lambda x: lower(trim(x))) AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(w, lambda x: NOT contains(said, x)), '|') AS missing FROM d""", "documents")
def missing_steps(docs: DataFrame) -> DataFrame:
    """Three steps, the second taken from the text itself, against the whole text."""
    wanted = F.expr(_WANTED.replace("chr(10)", "char(10)"))
    return docs.select("doc_id", F.array_join(E.steps_missing(F.expr(_DONE), wanted), "|").alias("missing"))


_LINES = f"""SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents"""
_KEPT = f"""SELECT doc_id, len(l) AS n, count(*) FILTER (i = 1 OR s = '' OR s <> b OR {PRESERVED_SQL}) AS kept FROM (
  SELECT doc_id, l, i, l[i] AS x, trim(l[i]) AS s, trim(l[i - 1]) AS b FROM ({_LINES}), unnest(range(1, len(l) + 1)) r(i)) GROUP BY ALL"""


@register("cleaning_diff", f"SELECT doc_id, (n - kept)::INTEGER AS changes FROM ({_KEPT})", "documents")
def cleaning_diff(docs: DataFrame) -> DataFrame:
    """Lines that are gone and lines that are new."""
    both = docs.select("doc_id", F.col("text").alias("before"), T.drop_repeated_lines(F.col("text")).alias("after"))
    gone = ("delete", "insert", "replace")
    return D.with_edits(both, "before", "after", "s").select("doc_id", (D.edited_lines(F.col("s"), gone) + D.edited_lines(F.col("s"), gone, "after")).alias("changes"))


@register("document_diff", f"SELECT doc_id, n::INTEGER AS original_lines, kept::INTEGER AS cleaned_lines, (n - kept)::INTEGER AS lines_removed, 0 AS lines_changed, kept::INTEGER AS lines_unchanged, true AS restored FROM ({_KEPT})", "documents")
def document_diff(docs: DataFrame) -> DataFrame:
    """The report of a text and what is left of it without repeated lines, and whether the edits restore that."""
    text = F.coalesce("text", F.lit(""))
    both = docs.select("doc_id", text.alias("before"), T.drop_repeated_lines(text).alias("after"))
    s = F.col("s")
    return D.with_edits(both, "before", "after", "s").select(
        "doc_id", (D.edited_lines(s, ("equal", "delete", "replace"))).alias("original_lines"), D.edited_lines(s, ("equal", "insert", "replace"), "after").alias("cleaned_lines"),
        D.edited_lines(s, ("delete",)).alias("lines_removed"), D.changed_lines(s).alias("lines_changed"), D.edited_lines(s, ("equal",)).alias("lines_unchanged"),
        (D.applied(F.col("before"), s) == F.col("after")).alias("restored"),
    )


@register("cleaned_documents", None, "documents")
def cleaned_documents(docs: DataFrame) -> DataFrame:
    """All removers in their order, then the normalisers, with a report."""
    steps = [T.drop_blank_lines, T.drop_running_titles, T.drop_page_numbers, T.drop_watermarks, T.drop_repeated_lines, T.strip_ocr_noise, T.normalized]
    clean = reduce(lambda c, step: step(c), steps, F.col("text"))
    rows = docs.select("doc_id", F.length("text").alias("before"), T.trimmed(clean).alias("clean"))
    return rows.select("doc_id", "before", F.length("clean").alias("after"), T.content_hash(F.col("clean")).alias("hash"))


@register("authority_match", "SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'building') THEN 'building' WHEN contains(lower(c_mktsegment), 'auto') OR levenshtein('auto', left(lower(c_mktsegment), 4)) <= 1 THEN 'auto' END AS authority FROM customer", "customer")
def authority_match(customer: DataFrame) -> DataFrame:
    """The first listed name that the text contains, else for short names the first within an edit."""
    text = F.lower("c_mktsegment")
    exact = [F.when(text.contains(a), F.lit(a)) for a in ("building", "auto")]
    close = F.when(F.levenshtein(F.lit("auto"), F.substring(text, 1, 4)) <= 1, "auto")
    return customer.select("c_custkey", F.coalesce(*exact, close).alias("authority"))


@register("score_buckets", "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'hard' WHEN o_totalprice >= 150000 THEN 'medium' ELSE 'easy' END AS tier FROM orders", "orders")
def tiers(orders: DataFrame) -> DataFrame:
    p = F.col("o_totalprice")
    return orders.select("o_orderkey", F.when(p >= 300000, "hard").when(p >= 150000, "medium").otherwise("easy").alias("tier"))


@register("overlap_coefficient", "SELECT l_orderkey, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) AS overlap FROM (SELECT l_orderkey, list(DISTINCT l_partkey % 5) AS a, list(DISTINCT l_suppkey % 5) AS b FROM lineitem GROUP BY 1)", "lineitem")
def overlap_coefficient(lineitem: DataFrame) -> DataFrame:
    g = lineitem.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 5).alias("a"), F.collect_set(F.col("l_suppkey") % 5).alias("b"))
    return g.select("l_orderkey", F.round(F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b")), 6).alias("overlap"))


@register("minimax_response", "SELECT s_nationkey, arg_min(action, (worst, action)) AS action FROM (SELECT s_nationkey, action, max(cost) AS worst FROM (SELECT s_nationkey, s_suppkey % 3 AS action, abs(s_acctbal) AS cost FROM supplier) GROUP BY 1, 2) GROUP BY 1", "supplier")
def minimax(supplier: DataFrame) -> DataFrame:
    """The action whose worst outcome is best, over a payoff table."""
    worst = supplier.groupBy("s_nationkey", (F.col("s_suppkey") % 3).alias("action")).agg(F.max(F.abs("s_acctbal")).alias("worst"))
    return worst.groupBy("s_nationkey").agg(F.min_by("action", F.struct("worst", "action")).alias("action"))


@register("greedy_policy", "SELECT context, arg_max(action, (mean, -action)) AS action FROM (SELECT event_type AS context, user_id % 4 AS action, avg(value) AS mean FROM events GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1", "events")
def greedy_policy(events: DataFrame) -> DataFrame:
    """The action of the best mean reward among those tried often enough."""
    means = events.groupBy(F.col("event_type").alias("context"), (F.col("user_id") % 4).alias("action")).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).where("n >= 5")
    return means.groupBy("context").agg(F.max_by("action", F.struct("mean", -F.col("action"))).alias("action"))


@register("stage_values", "SELECT o_custkey, round(list_reduce(list_prepend(0.0::DOUBLE, list(o_totalprice ORDER BY o_orderkey DESC)), lambda v, x: x / 1000 + 0.9::DOUBLE * v), 4) AS value FROM orders GROUP BY 1", "orders")
def stage_values(orders: DataFrame) -> DataFrame:
    """Backward induction along each ladder: a stage is worth its own and the discounted next."""
    ladder = orders.groupBy("o_custkey").agg(F.reverse(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice")))).alias("l"))
    return ladder.select("o_custkey", F.round(F.aggregate("l", F.lit(0.0), lambda v, x: x["o_totalprice"] / 1000 + 0.9 * v), 4).alias("value"))


@register("evidence_strength", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'NONE' WHEN count(*) FILTER (event_type = 'purchase') < 3 THEN 'WEAK' WHEN count(*) FILTER (event_type = 'purchase') < 10 THEN 'MODERATE' ELSE 'STRONG' END AS strength FROM events GROUP BY 1", "events")
def evidence_strength(events: DataFrame) -> DataFrame:
    n = F.count_if(F.col("event_type") == "purchase")
    return events.groupBy("user_id").agg(F.when(n == 0, "NONE").when(n < 3, "WEAK").when(n < 10, "MODERATE").otherwise("STRONG").alias("strength"))


@register("mean_set_scores", "SELECT round(avg(len(list_intersect(c, g)) / len(g)), 6) AS recall, round(avg(len(list_intersect(c, g)) / len(c)), 6) AS precision FROM (SELECT l_orderkey, list(DISTINCT l_partkey % 9) AS c, list(DISTINCT l_suppkey % 9) AS g FROM lineitem GROUP BY 1)", "lineitem")
def mean_set_scores(lineitem: DataFrame) -> DataFrame:
    g = lineitem.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 9).alias("c"), F.collect_set(F.col("l_suppkey") % 9).alias("g"))
    recall, precision, _ = M.set_scores(F.col("c"), F.col("g"))
    return g.agg(F.round(F.avg(recall), 6).alias("recall"), F.round(F.avg(precision), 6).alias("precision"))


@register("reference_relevance", f"""SELECT conv_id, round(avg(CASE WHEN n = 0 THEN 0 ELSE c / n END), 6) AS relevance FROM (SELECT a.conv_id, len(list_distinct(y)) AS n, len(list_intersect(x, y)) AS c FROM (SELECT a.conv_id, list_filter(regexp_extract_all(lower(a.text), '[a-z0-9_]+', 0), lambda t: length(t) > 3) AS x, list_filter(regexp_extract_all(lower(b.text), '[a-z0-9_]+', 0), lambda t: length(t) > 3) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn) a) GROUP BY 1""", "conversations")
def reference_relevance(conv: DataFrame) -> DataFrame:
    long_words = lambda c: F.filter(L.words(F.col(c)), lambda t: F.length(t) > 3)
    a = conv.select("conv_id", "turn", F.col("text").alias("ta"))
    pairs = a.join(conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tb")), ["conv_id", "turn"])
    return pairs.groupBy("conv_id").agg(F.round(F.avg(L.overlap_share(long_words("ta"), long_words("tb"))), 6).alias("relevance"))


@register("strategy_by_type", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ['graph', 'dense'] WHEN '2-HIGH' THEN ['structure', 'bm25'] ELSE ['dense', 'bm25'] END AS tools FROM orders", "orders")
def strategy(orders: DataFrame) -> DataFrame:
    p = F.col("o_orderpriority")
    tools = lambda *names: F.array(*map(F.lit, names))
    return orders.select("o_orderkey", F.when(p == "1-URGENT", tools("graph", "dense")).when(p == "2-HIGH", tools("structure", "bm25")).otherwise(tools("dense", "bm25")).alias("tools"))


@register("backfill_join", "SELECT l_orderkey, l_linenumber, coalesce(a.p_name, b.p_name) AS body FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey AND l_returnflag = 'N' LEFT JOIN part b ON b.p_partkey = l_suppkey", "lineitem", "part")
def backfill(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Bodies by the first of two key variants that finds any; the variants are one lookup each."""
    own = lineitem.withColumn("k", F.when(F.col("l_returnflag") == "N", F.col("l_partkey")))
    a, b = (part.select(F.col("p_partkey").alias(k), F.col("p_name").alias(n)) for k, n in (("k", "one"), ("l_suppkey", "two")))
    return own.join(a, "k", "left").join(b, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("one", "two").alias("body"))


@register("json_edges", "SELECT DISTINCT user_id AS src, json_extract_string(props, '$.k')::BIGINT AS dst, 'cites' AS type FROM events WHERE json_extract_string(props, '$.k')::BIGINT IN (SELECT n_nationkey FROM nation)", "events", "nation")
def json_edges(events: DataFrame, nation: DataFrame) -> DataFrame:
    """References kept as JSON become typed edges to known nodes."""
    k = F.from_json("props", "k long")["k"]
    edges = events.select(F.col("user_id").alias("src"), k.alias("dst")).distinct().withColumn("type", F.lit("cites"))
    return edges.join(nation.select(F.col("n_nationkey").cast("long").alias("dst")), "dst", "left_semi").select("src", "dst", "type")
