"""Lexical, dense and fused retrieval over documents with benchmark passages as queries, and its quality."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import lexical as L
from lexmill.functions.dates import latency_factor
from lexmill.operators import fuzzy as Z
from lexmill.operators import metrics as M
from lexmill.operators import retrieval as R
from lexmill.plans._registering import register
from lexmill.sources.shared import shared_folder

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in L.STOPWORDS) + ")"
_tokens = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]+', 0), lambda t: t NOT IN {STOP_SQL} AND (length(t) >= 3 OR regexp_matches(t, '[0-9]')))"

INDEX_SQL = f"""tok AS (SELECT doc_id AS item, {_tokens('text')} AS t FROM documents),
idx AS (SELECT term, item, count(*) AS tf, any_value(len) AS len FROM (SELECT item, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id AS query, unnest({_tokens('text')}) AS term FROM benchmark),
st AS (SELECT count(*) AS total, avg(len) AS mean FROM (SELECT DISTINCT item, len FROM idx))"""
BM25_SQL = """df AS (SELECT term, count(*) AS df FROM idx WHERE term IN (SELECT term FROM q) GROUP BY 1),
sc AS (SELECT query, item, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM q JOIN idx USING (term) JOIN df USING (term), st GROUP BY 1, 2),
lex AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= {k})"""


def query_terms(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("query"), F.explode(L.content_tokens(F.col("text"))).alias("term"))


@register("bm25_topk", f"WITH {INDEX_SQL}, {BM25_SQL.format(k=10)} SELECT query, item, rank, round(score, 6) AS score FROM lex", "documents", "benchmark")
def bm25_topk(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return R.bm25(R.tokenised(docs, "doc_id", F.col("text")), query_terms(benchmark), 10).withColumn("score", F.round("score", 6))


JACCARD_SQL = """jd AS (SELECT item, count(*) AS n FROM idx GROUP BY 1), jq AS (SELECT query, count(*) AS m FROM q GROUP BY 1),
js AS (SELECT query, item, round(count(*) / (any_value(n) + any_value(m) - count(*)), 9) AS score FROM q JOIN idx USING (term) JOIN jd USING (item) JOIN jq USING (query) GROUP BY 1, 2),
jac AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS rank FROM js QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= {k})"""


def jaccard_arm(tokens: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Token-set Jaccard: common terms are counted by query terms' postings, set sizes are joined."""
    terms = terms.distinct()
    n, m = tokens.select("item", F.size(F.array_distinct("t")).alias("n")), terms.groupBy("query").agg(F.count("*").alias("m"))
    held = tokens.select("item", F.explode(F.array_distinct("t")).alias("term"))
    both = terms.join(held, "term").groupBy("query", "item").agg(F.count("*").alias("c"))
    scored = both.join(n, "item").join(m, "query").select("query", "item", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 9).alias("score"))
    return R.top_per(scored, ["query"], [F.desc("score"), F.asc("item")], k)


HYBRID_SQL = f"""WITH {INDEX_SQL}, {BM25_SQL.format(k=50)}, {JACCARD_SQL.format(k=50)},
f AS (SELECT query, item, round(sum(1 / (rank + 60)), 12) AS score FROM (SELECT query, item, rank FROM lex UNION ALL SELECT query, item, rank FROM jac) GROUP BY 1, 2)
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS rank, round(score, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 10"""


@register("hybrid_retrieval", HYBRID_SQL, "documents", "benchmark")
def hybrid(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Both arms over one tokenising pass, fused by reciprocal rank."""
    index = R.tokenised(docs, "doc_id", F.col("text"))
    terms = query_terms(benchmark).distinct()
    arms = [R.bm25(index, terms, 50).withColumn("arm", F.lit("bm25")), jaccard_arm(index, terms, 50).withColumn("arm", F.lit("jaccard"))]
    fused = R.rrf(arms[0].unionByName(arms[1]))
    return R.top_per(fused, ["query"], [F.desc("score"), F.asc("item")], 10).select("query", "item", "rank", F.round("score", 9).alias("score"))


_COS = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9)"


def dense_arm(emb: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
    queries = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return R.cosine_topk(emb.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), queries, k, threshold)


@register("cosine_topk", f"""SELECT a.vec_id AS query, b.vec_id AS item, round({_COS}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 5""", "embeddings")
def cosine_top(emb: DataFrame) -> DataFrame:
    return dense_arm(emb, 5).select("query", "item", F.round("score", 5).alias("score"))


@register("dense_threshold", f"""SELECT a.vec_id AS query, b.vec_id AS item FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.label = 1 AND {_COS} >= 0.3""", "embeddings")
def dense_threshold(emb: DataFrame) -> DataFrame:
    queries = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return R.cosine_topk(emb.where("label = 1").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), queries, None, 0.3).select("query", "item")


_ARMS = """arms AS (SELECT o_custkey AS query, 'a' AS arm, o_orderkey % 50 AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders UNION ALL
SELECT o_custkey, 'b', o_orderkey % 50, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER FROM orders WHERE o_orderstatus <> 'P')"""


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))


def arms(orders: DataFrame) -> DataFrame:
    rows = orders.select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 50).alias("item"), "o_totalprice", "o_orderdate", "o_orderkey", "o_orderstatus")
    a = ranked(rows, F.desc("o_totalprice"), F.asc("o_orderkey")).withColumn("arm", F.lit("a"))
    b = ranked(rows.where("o_orderstatus <> 'P'"), F.asc("o_orderdate"), F.asc("o_orderkey")).withColumn("arm", F.lit("b"))
    return a.unionByName(b).select("query", "arm", "item", "rank")


@register("rrf_two_arms", f"WITH {_ARMS} SELECT query, item, round(sum(1 / (rank + 60)), 9) AS score FROM arms GROUP BY 1, 2", "orders")
def rrf_two(orders: DataFrame) -> DataFrame:
    return R.rrf(arms(orders)).withColumn("score", F.round("score", 9))


@register("priority_rrf", f"""WITH {_ARMS}, s AS (SELECT query, arm, item, round((CASE arm WHEN 'a' THEN 1.0 ELSE 0.8 END) / (rank + 60), 12) AS score FROM arms),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, item ORDER BY score DESC, arm) = 1)
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 8""", "orders")
def priority(orders: DataFrame) -> DataFrame:
    return R.priority_fusion(arms(orders), F.when(F.col("arm") == "a", 1.0).otherwise(0.8), 8).select("query", "item", "rank")


@register("protected_fusion", f"""WITH {_ARMS}, u AS (SELECT query, item, CASE WHEN arm = 'b' THEN 1 WHEN rank <= 3 THEN 0 ELSE 2 END AS tier, rank AS was FROM arms),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, item ORDER BY tier, was) = 1)
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY tier, was, item)::INTEGER AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, was, item) <= 6""", "orders")
def protected(orders: DataFrame) -> DataFrame:
    both = arms(orders)
    return R.protected_fusion(both.where("arm = 'a'"), both.where("arm = 'b'"), 3, 6).select("query", "item", "rank")


@register("primary_dominance", f"""WITH {_ARMS}, m AS (SELECT *, min(CASE WHEN item % 5 = 0 THEN rank END) OVER (PARTITION BY query) AS best FROM arms WHERE arm = 'a')
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN rank = best THEN 0 ELSE rank END)::INTEGER AS rank FROM m""", "orders")
def dominance(orders: DataFrame) -> DataFrame:
    return R.promote_primary(arms(orders).where("arm = 'a'"), F.col("item") % 5 == 0).select("query", "item", "rank")


@register("keep_best_per_item", "SELECT o_custkey AS query, o_orderkey % 20 AS item, max(o_totalprice) AS score FROM orders GROUP BY 1, 2", "orders")
def keep_best(orders: DataFrame) -> DataFrame:
    return R.keep_best(orders.select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 20).alias("item"), F.col("o_totalprice").alias("score")), ["query", "item"])


@register("quota_merge", """WITH g AS (SELECT o_orderpriority AS "group", o_orderkey AS item, max(o_totalprice) AS score FROM orders GROUP BY 1, 2), n AS (SELECT greatest(1, 40 // count(DISTINCT "group")) AS quota FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, item) > quota AS late FROM g, n), d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY item ORDER BY late, score DESC, "group") = 1)
SELECT "group", item, score FROM d ORDER BY late, score DESC, item LIMIT 40""", "orders")
def quota(orders: DataFrame) -> DataFrame:
    g = orders.groupBy(F.col("o_orderpriority").alias("group"), F.col("o_orderkey").alias("item")).agg(F.max("o_totalprice").alias("score"))
    return R.quota_merge(g, 40)


@register("diverse_sections", """WITH p AS (SELECT o_custkey AS query, o_orderkey AS item, o_orderpriority AS section, o_totalprice AS score FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY query, section ORDER BY score DESC, item) > 1 AS late FROM p)
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY late, score DESC, item)::INTEGER AS rank FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY late, score DESC, item) <= 5""", "orders")
def diverse(orders: DataFrame) -> DataFrame:
    pool = orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("section"), F.col("o_totalprice").alias("score"))
    return R.diverse_first(pool, "section", 5).select("query", "item", "rank")


@register("minmax_rerank", """SELECT o_custkey AS query, o_orderkey AS item, round(CASE WHEN max(o_totalprice) OVER w = min(o_totalprice) OVER w THEN 0.0 ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END + 2.0 * (o_orderpriority = '1-URGENT')::INT + 0.2 * (o_orderstatus = 'O')::INT, 6) AS score FROM orders WINDOW w AS (PARTITION BY o_custkey)""", "orders")
def minmax_rerank(orders: DataFrame) -> DataFrame:
    base = R.minmax_by(orders, ["o_custkey"], "o_totalprice", 0.0)
    bonus = 2.0 * (F.col("o_orderpriority") == "1-URGENT").cast("int") + 0.2 * (F.col("o_orderstatus") == "O").cast("int")
    return orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"), F.round(base + bonus, 6).alias("score"))


@register("minmax_half", "SELECT p_brand, p_partkey, round(CASE WHEN max(p_size) OVER w = min(p_size) OVER w THEN 0.5 ELSE (p_size - min(p_size) OVER w)::DOUBLE / (max(p_size) OVER w - min(p_size) OVER w) END, 6) AS score FROM part WINDOW w AS (PARTITION BY p_brand)", "part")
def minmax_half(part: DataFrame) -> DataFrame:
    return part.select("p_brand", "p_partkey", F.round(R.minmax_by(part, ["p_brand"], "p_size", 0.5), 6).alias("score"))


@register("term_hits_search", """SELECT item, hits FROM (SELECT doc_id AS item, contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'xyz')::INT AS hits FROM documents) WHERE hits >= 2 ORDER BY hits DESC, item LIMIT 25""", "documents")
def term_hits(docs: DataFrame) -> DataFrame:
    return R.term_hits(docs, "doc_id", F.col("text"), ["the", "tion", "xyz"], 25)


@register("open_targets", "SELECT l_orderkey, n, first FROM (SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ORDER BY n DESC, first, l_orderkey LIMIT 20", "lineitem")
def open_targets(lineitem: DataFrame) -> DataFrame:
    g = lineitem.where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"))
    return g.orderBy(F.desc("n"), "first", "l_orderkey").limit(20)


@register("score_threshold_units", "SELECT o_custkey AS query, o_orderpriority AS unit, max(o_totalprice) AS score FROM orders WHERE o_totalprice >= 100000 GROUP BY 1, 2", "orders")
def threshold_units(orders: DataFrame) -> DataFrame:
    return orders.where("o_totalprice >= 100000").groupBy(F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("unit")).agg(F.max("o_totalprice").alias("score"))


@register("pool_tf_idf_rerank", f"""WITH {INDEX_SQL}, {BM25_SQL.format(k=20)}, p AS (SELECT query, item, score FROM lex), n AS (SELECT query, count(DISTINCT item) AS n FROM p GROUP BY 1),
h AS (SELECT query, item, term, tf FROM p JOIN idx USING (item) JOIN q USING (query, term)), d AS (SELECT query, term, count(*) AS df FROM h GROUP BY 1, 2),
r AS (SELECT query, item, sum(tf * ln((n + 1) / df)) AS raw FROM h JOIN d USING (query, term) JOIN n USING (query) GROUP BY 1, 2)
SELECT query, item, round(0.5 * score + 0.5 * least(coalesce(raw, 0) / 10, 1.0), 6) AS score FROM p LEFT JOIN r USING (query, item)""", "documents", "benchmark")
def pool_rerank(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    terms = query_terms(benchmark).distinct()
    found = R.bm25(R.tokenised(docs, "doc_id", F.col("text")), terms, 20).drop("rank")
    pool = found.join(docs.select(F.col("doc_id").alias("item"), "text"), "item").select("query", "item", "score", "text")
    return R.pool_tf_idf(pool, terms).select("query", "item", F.round("score", 6).alias("score"))


@register("phrase_idf_score", """WITH p AS (SELECT DISTINCT p_partkey AS item, unnest([p_brand, split_part(p_type, ' ', 1)]) AS phrase FROM part), n AS (SELECT count(DISTINCT item) AS n FROM p), d AS (SELECT phrase, ln((any_value(n) + 1) / (count(DISTINCT item) + 1)) + 1 AS idf FROM p, n GROUP BY 1)
SELECT item, round(sum(idf), 6) AS score FROM p JOIN d USING (phrase) WHERE contains('want economy brand#12 or brand#31 promo', lower(phrase)) GROUP BY 1""", "part")
def phrase_idf(part: DataFrame) -> DataFrame:
    """Phrases of items with idf ln((n + 1) / (df + 1)) + 1, summed over those that the query contains."""
    p = part.select(F.col("p_partkey").alias("item"), F.explode(F.array("p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("phrase")).distinct()
    n = p.agg(F.count_distinct("item").alias("n"))
    idf = p.groupBy("phrase").agg(F.count_distinct("item").alias("df")).join(F.broadcast(n)).select("phrase", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    said = F.lit("want economy brand#12 or brand#31 promo").contains(F.lower("phrase"))
    return p.where(said).join(idf, "phrase").groupBy("item").agg(F.round(F.sum("idf"), 6).alias("score"))


@register("levenshtein_match", "SELECT p_partkey, levenshtein(lower(p_name), 'part#000000123') AS d FROM part WHERE levenshtein(lower(p_name), 'part#000000123') <= 4", "part")
def lev_match(part: DataFrame) -> DataFrame:
    d = F.levenshtein(F.lower("p_name"), F.lit("part#000000123"))
    return part.select("p_partkey", d.cast("long").alias("d")).where("d <= 4")


_SIGNIFICANT = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+', 0), lambda t: length(t) >= 3 AND t NOT IN {STOP_SQL})"


@register("token_sets", f"SELECT doc_id, len({_tokens('text')})::BIGINT AS n, len(list_distinct({_tokens('text')}))::BIGINT AS m, list_filter(s, lambda x, i: list_position(s, x) = i)[1:12] AS terms FROM (SELECT *, {_SIGNIFICANT} AS s FROM documents)", "documents")
def token_sets(docs: DataFrame) -> DataFrame:
    t = L.content_tokens(F.col("text"))
    return docs.select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("m"), L.search_terms(F.col("text")).alias("terms"))


_NEXT = "JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn"


def turns(conv: DataFrame) -> DataFrame:
    a = conv.select("conv_id", "turn", F.col("text").alias("ta"))
    return a.join(conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tb")), ["conv_id", "turn"])


@register("jaccard_pairs", f"""SELECT a.conv_id, a.turn, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(x || y)), 0), 0), 6) AS jaccard, round(CASE WHEN len(list_distinct(y)) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(y)) END, 6) AS coverage
FROM (SELECT a.conv_id, a.turn, {_tokens('a.text')} AS x, {_tokens('b.text')} AS y FROM conversations a {_NEXT}) a""", "conversations")
def jaccard_pairs(conv: DataFrame) -> DataFrame:
    x, y = L.content_tokens(F.col("ta")), L.content_tokens(F.col("tb"))
    return turns(conv).select("conv_id", "turn", F.round(L.jaccard(x, y), 6).alias("jaccard"), F.round(L.overlap_share(x, y), 6).alias("coverage"))


@register("soft_answer_score", f"""SELECT conv_id, turn, round((j + c) / 2, 4) AS soft, (j + c) / 2 > 0.1 AS binary FROM (SELECT a.conv_id, a.turn, coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(x || y)), 0), 0) AS j, CASE WHEN len(list_distinct(y)) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(y)) END AS c
FROM (SELECT a.conv_id, a.turn, {_tokens('a.text')} AS x, {_tokens('b.text')} AS y FROM conversations a {_NEXT}) a)""", "conversations")
def soft_answer(conv: DataFrame) -> DataFrame:
    x, y = L.content_tokens(F.col("ta")), L.content_tokens(F.col("tb"))
    soft = (L.jaccard(x, y) + L.overlap_share(x, y)) / 2
    return turns(conv).select("conv_id", "turn", F.round(soft, 4).alias("soft"), (soft > 0.1).alias("binary"))


@register("title_containment", "SELECT doc_id, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+', 0), ' ') || ' ', ' of the ') AS found FROM documents", "documents")
def title_containment(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", L.holds_phrase(F.col("text"), F.lit("Of the")).alias("found"))


@register("hash_vectors", "SELECT p_partkey, round(list_sum(list_transform(range(0, 32), lambda i: ((strpos('0123456789abcdef', h[2 * i + 1]) - 1) * 16 + strpos('0123456789abcdef', h[2 * i + 2]) - 1) / 255.0 * 2 - 1)), 6) AS total FROM (SELECT p_partkey, sha256(p_name) AS h FROM part)", "part")
def hash_vectors(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.round(F.aggregate(L.hash_vector(F.col("p_name")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("token_estimates", r"SELECT doc_id, floor(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) * 1.3)::INTEGER AS n FROM documents", "documents")
def token_estimates(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", L.token_estimate(F.col("text")).alias("n"))


@register("highlight_exact", "SELECT page_id, regexp_replace(url, '(?i)example', '<mark>\\0</mark>', 'g') AS marked FROM pages", "pages")
def highlight_exact(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", L.highlight_exact(F.col("url"), "example").alias("marked"))


@register("fuzzy_scores", None, "conversations")
def fuzzy_scores(conv: DataFrame) -> DataFrame:
    # A pair costs milliseconds and a row little to move: all cores get their share, however few bytes the join left.
    rows = turns(conv).repartition(max(64, 4 * conv.sparkSession.sparkContext.defaultParallelism))
    return rows.select("conv_id", "turn", L.all_scores("ta", "tb").alias("s")).select("conv_id", "turn", "s.*")


def part_index(part: DataFrame) -> Z.PairIndex:
    """Names of full weight, types of 0.7."""
    field = lambda name, column, weight: part.select(F.col("p_partkey").alias("item"), F.lit(name).alias("field"), F.lit(weight).alias("weight"), F.col(column).alias("text"))
    return Z.build_index(field("name", "p_name", 1.0).union(field("type", "p_type", 0.7)), f"{shared_folder(part.sparkSession)}/{uuid.uuid4().hex}")


@register("fuzzy_search", None, "part")
def fuzzy_search(part: DataFrame) -> DataFrame:
    """The best name or 0.7 of the type, over a threshold of 65."""
    asked = part.sparkSession.createDataFrame([(0, "economy brass 12")], "query int, text string")
    return Z.search(part_index(part), asked, 20).select(F.col("item").alias("p_partkey"), "score")


@register("fuzzy_names", None, "part")
def fuzzy_names(part: DataFrame) -> DataFrame:
    """Every name whose number is divisible by 50, its second letter missing, against all names and types."""
    name = F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)"))
    return Z.search(part_index(part), part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), name.alias("text")), 5)


@register("fuzzy_coverage", None, "conversations")
def fuzzy_coverage(conv: DataFrame) -> DataFrame:
    """Share of the first turn's content tokens that each later turn holds, letter for letter or nearly."""
    first = conv.groupBy("conv_id").agg(F.min_by("text", "turn").alias("asked"), F.min("turn").alias("first"))
    later = conv.join(first, "conv_id").where(F.col("turn") > F.col("first"))
    return later.select("conv_id", "turn", L.fuzzy_coverage(F.array_distinct(L.content_tokens(F.col("asked"))), F.col("text")).alias("coverage"))


@register("highlighting", None, "conversations")
def highlighting(conv: DataFrame) -> DataFrame:
    q = F.lit("the thon")
    return conv.select("conv_id", "turn", L.spans(q, "text").alias("spans"), L.highlighted(q, "text").alias("marked"), L.snippet(q, "text").alias("snippet"))


def ranked_pool(docs: DataFrame, benchmark: DataFrame, k: int) -> DataFrame:
    index = R.tokenised(docs, "doc_id", F.col("text"))
    found = R.bm25(index, query_terms(benchmark).distinct(), k)
    return found.join(docs.select(F.col("doc_id").alias("item"), "text", "lang"), "item").select("query", "item", "score", L.content_tokens(F.col("text")).alias("tokens"), F.length("lang").alias("type_rank"), F.col("lang").alias("section"))


@register("mmr_selection", None, "documents", "benchmark")
def mmr_selection(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return R.mmr(ranked_pool(docs, benchmark, 30), 8)


@register("evidence_selection", None, "documents", "benchmark")
def evidence_selection(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return R.evidence_set(ranked_pool(docs, benchmark, 30), 8, 3)


@register("family_selection", None, "documents", "benchmark")
def family_selection(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return R.with_family(ranked_pool(docs, benchmark, 30), 8)


# --- quality ---

_GOLD = "gold AS (SELECT DISTINCT o_custkey AS query, o_orderkey % 50 AS item FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"


def gold(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 50).alias("item")).distinct()


@register("ranking_metrics", f"""WITH {_ARMS}, {_GOLD}, r AS (SELECT query, item, min(rank) AS rank FROM arms WHERE arm = 'a' GROUP BY 1, 2), m AS (SELECT r.*, g.item IS NOT NULL AS hit FROM r LEFT JOIN gold g ON r.query = g.query AND r.item = g.item),
p AS (SELECT query, count(*) FILTER (hit AND rank <= 5) AS found, count(*) FILTER (rank <= 5) AS seen, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 5), 0) AS dcg FROM m GROUP BY 1), w AS (SELECT query, count(*) AS wanted FROM gold GROUP BY 1)
SELECT coalesce(p.query, w.query) AS query, round(CASE WHEN coalesce(wanted, 0) = 0 THEN 1.0 ELSE coalesce(found, 0) / wanted END, 6) AS recall, round(CASE WHEN coalesce(seen, 0) = 0 THEN 0.0 ELSE found / seen END, 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr,
round(CASE WHEN coalesce(wanted, 0) = 0 THEN 0.0 ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, least(5, wanted) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg FROM p FULL JOIN w ON p.query = w.query""", "orders")
def ranking(orders: DataFrame) -> DataFrame:
    return M.ranking_metrics(arms(orders).where("arm = 'a'").select("query", "rank", "item"), gold(orders), 5)


@register("graded_ndcg", """WITH r AS (SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, (l_quantity::INT % 4) AS gain FROM lineitem),
i AS (SELECT query, rank, gain, row_number() OVER (PARTITION BY query ORDER BY gain DESC) AS best FROM r)
SELECT query, round(coalesce(sum((2 ** gain - 1) / log2(rank + 1)) FILTER (rank <= 5) / nullif(sum((2 ** gain - 1) / log2(best + 1)) FILTER (best <= 5), 0), 0), 6) AS ndcg FROM i GROUP BY 1""", "lineitem")
def graded(lineitem: DataFrame) -> DataFrame:
    rows = ranked(lineitem.select(F.col("l_orderkey").alias("query"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("int") % 4).alias("gain")), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    return M.graded_ndcg(rows.select("query", "rank", "gain"), 5)


@register("set_metrics", """SELECT l_orderkey, round(CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(c, g)) / len(g) END, 6) AS recall, round(CASE WHEN len(c) = 0 THEN 0.0 ELSE len(list_intersect(c, g)) / len(c) END, 6) AS precision,
round(CASE WHEN len(list_intersect(c, g)) = 0 THEN 0.0 ELSE 2 * len(list_intersect(c, g)) / (len(c) + len(g)) END, 6) AS f1 FROM (SELECT l_orderkey, coalesce(list(DISTINCT l_partkey % 9) FILTER (l_returnflag <> 'R'), []) AS c, coalesce(list(DISTINCT l_suppkey % 9) FILTER (l_returnflag <> 'A'), []) AS g FROM lineitem GROUP BY 1) WHERE len(g) > 0 OR len(c) > 0""", "lineitem")
def set_metrics(lineitem: DataFrame) -> DataFrame:
    g = lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey") % 9)).alias("c"), F.collect_set(F.when(F.col("l_returnflag") != "A", F.col("l_suppkey") % 9)).alias("g"))
    recall, precision, f1 = M.set_scores(F.col("c"), F.col("g"))
    return g.where((F.size("c") > 0) | (F.size("g") > 0)).select("l_orderkey", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"))


@register("mcnemar_counts", """SELECT only_a, only_b, CASE WHEN only_a + only_b > 0 THEN round(greatest(0, abs(only_a - only_b) - 1) * greatest(0, abs(only_a - only_b) - 1) / (only_a + only_b), 6) END AS statistic FROM (SELECT count(*) FILTER (quality = 1 AND toxic <> 1) AS only_a, count(*) FILTER (quality <> 1 AND toxic = 1) AS only_b FROM labels)""", "labels")
def mcnemar(labels: DataFrame) -> DataFrame:
    return M.mcnemar_counts(labels, F.col("quality") == 1, F.col("toxic") == 1)


@register("mcnemar_exact", """WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic <> 1) AS a, count(*) FILTER (quality <> 1 AND toxic = 1) AS b FROM labels JOIN documents USING (doc_id) GROUP BY 1),
t AS (SELECT *, unnest(range(0, least(a, b) + 1)) AS i FROM c)
SELECT lang, a AS only_a, b AS only_b, round(least(1.0, 2 * sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2)))), 9) AS p FROM t GROUP BY ALL""", "labels", "documents")
def mcnemar_exact(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Of each language the discordant labels and the exact p."""
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    counts = labels.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    return counts.withColumn("p", F.round(M.exact_binomial(F.col("only_a"), F.col("only_b")), 9))


@register("bootstrap_interval", None, "events")
def bootstrap(events: DataFrame) -> DataFrame:
    return M.paired_bootstrap(events.select(F.col("event_type").alias("group"), F.col("value").alias("a"), F.lit(0.5).alias("b")), 200)


@register("isotonic_calibration", None, "documents", "labels")
def isotonic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.join(labels, "doc_id").select(F.col("lang").alias("group"), F.floor(F.log2(F.col("n_chars") + 1.0)).cast("double").alias("score"), F.col("quality").alias("label"))
    return M.isotonic(rows)


@register("answer_reward", """SELECT event_id, round(least(1.0, greatest(0.0, 0.35::DOUBLE * least(value / 100, 1) + 0.35::DOUBLE * (event_type = 'purchase')::INT + 0.2::DOUBLE * (user_id % 2) + 0.1::DOUBLE * greatest(0, 1 - value / 200))), 6) AS reward FROM events""", "events")
def reward(events: DataFrame) -> DataFrame:
    v = F.col("value")
    raw = 0.35 * F.least(v / 100, F.lit(1.0)) + 0.35 * (F.col("event_type") == "purchase").cast("int") + 0.2 * (F.col("user_id") % 2) + 0.1 * latency_factor(v, 200.0)
    return events.select("event_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 6).alias("reward"))
