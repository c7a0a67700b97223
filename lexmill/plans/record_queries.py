"""Dashboards, filters, joins, versions and audit trails over the operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import dates as D
from lexmill.operators import aggregates as A
from lexmill.operators import filters as P
from lexmill.operators import joins as J
from lexmill.operators import windows as W
from lexmill.plans._registering import register

# --- aggregates ---


@register("month_trend_full_outer", """SELECT coalesce(a.month, b.month) AS month, coalesce(orders, 0) AS orders, coalesce(events, 0) AS events FROM
(SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1) a FULL JOIN (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS events FROM events GROUP BY 1) b ON a.month = b.month""", "orders", "events")
def month_trend(orders: DataFrame, events: DataFrame) -> DataFrame:
    a = orders.groupBy(A.month(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("orders"))
    b = events.groupBy(A.month(F.col("ts")).alias("month")).agg(F.count("*").alias("events"))
    return J.merged_series(a, b, "month", ["orders", "events"])


@register("flag_compliance", "SELECT count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_returnflag IS NULL OR l_returnflag <> 'R') AS active, count(*) AS total FROM lineitem", "lineitem")
def flag_compliance(lineitem: DataFrame) -> DataFrame:
    bad = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
    return lineitem.agg(F.count_if(bad).alias("returned"), F.count_if(~bad).alias("active"), F.count("*").alias("total"))


@register("status_pivot_by_month", """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderstatus = 'F') AS billed, count(*) FILTER (o_orderstatus <> 'F') AS unbilled FROM orders GROUP BY 1""", "orders")
def status_pivot(orders: DataFrame) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "billed").otherwise("unbilled")
    return orders.withColumn("state", state).groupBy(A.month(F.col("o_orderdate")).alias("month")).pivot("state", ["billed", "unbilled"]).agg(F.count("state")).na.fill(0)


@register("flag_counts_unpivot", """SELECT unnest(['returned', 'open', 'discounted', 'taxed', 'large']) AS flag, unnest([count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_linestatus = 'O'), count(*) FILTER (l_discount > 0), count(*) FILTER (l_tax > 0), count(*) FILTER (l_quantity > 40)]) AS n FROM lineitem""", "lineitem")
def flag_counts(lineitem: DataFrame) -> DataFrame:
    c = F.col
    return A.flag_counts(lineitem, {"returned": c("l_returnflag") == "R", "open": c("l_linestatus") == "O", "discounted": c("l_discount") > 0, "taxed": c("l_tax") > 0, "large": c("l_quantity") > 40})


@register("top15_groups", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 15", "customer")
def top15(customer: DataFrame) -> DataFrame:
    return A.top_groups(customer, "c_nationkey", 15)


@register("type_counts_with_total", "SELECT CASE WHEN grouping(event_type) = 1 THEN 'TOTAL' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)", "events")
def type_counts(events: DataFrame) -> DataFrame:
    return A.counts_with_total(events, "event_type")


@register("state_counts_with_total", "SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'TOTAL' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)", "orders")
def state_counts(orders: DataFrame) -> DataFrame:
    return A.counts_with_total(orders, "o_orderstatus")


@register("summary_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "part", "supplier", "events")), "customer", "orders", "lineitem", "part", "supplier", "events")
def summary_counts(*tables: DataFrame) -> DataFrame:
    return A.table_counts(dict(zip(("customer", "orders", "lineitem", "part", "supplier", "events"), tables, strict=True)))


@register("billing_summary", """SELECT CASE WHEN grouping(k) = 1 THEN 'TOTAL' ELSE k END AS kind, count(*) AS n, sum(v)::DECIMAL(38, 2) AS amount FROM
(SELECT coalesce(nullif(l_returnflag, ''), 'Other') AS k, l_extendedprice::DECIMAL(12, 2) AS v FROM lineitem) GROUP BY ROLLUP (k)""", "lineitem")
def billing_summary(lineitem: DataFrame) -> DataFrame:
    return A.sums_with_total(lineitem, F.col("l_returnflag"), F.col("l_extendedprice").cast("decimal(12,2)")).withColumn("amount", F.col("amount").cast("decimal(38,2)"))


@register("billing_by_two_types", """SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_n,
coalesce(sum(l_extendedprice::DECIMAL(12,2)) FILTER (l_returnflag = 'A'), 0)::DECIMAL(38,2) AS sum_a, coalesce(sum(l_extendedprice::DECIMAL(12,2)) FILTER (l_returnflag = 'N'), 0)::DECIMAL(38,2) AS sum_n FROM lineitem GROUP BY 1""", "lineitem")
def billing_two(lineitem: DataFrame) -> DataFrame:
    price, kind = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_returnflag")
    part = lambda k: F.coalesce(F.sum(F.when(kind == k, price)), F.lit(0)).cast("decimal(38,2)")
    return lineitem.groupBy(A.month(F.col("l_shipdate")).alias("month")).agg(F.count_if(kind == "A").alias("n_a"), F.count_if(kind == "N").alias("n_n"), part("A").alias("sum_a"), part("N").alias("sum_n"))


@register("field_accuracy", """WITH t AS (SELECT count(*) AS total FROM orders) SELECT o_orderpriority AS field, count(*) AS corrections, count(DISTINCT o_custkey) AS documents, round(greatest(0, 1 - count(*) / any_value(total)), 4) AS accuracy
FROM orders, t WHERE o_orderstatus = 'F' GROUP BY 1""", "orders")
def field_accuracy(orders: DataFrame) -> DataFrame:
    """Corrections and corrected documents per field; the total is one row, so it joins without a shuffle."""
    total = orders.agg(F.count("*").alias("total"))
    own = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("field")).agg(F.count("*").alias("corrections"), F.count_distinct("o_custkey").alias("documents"))
    return own.join(F.broadcast(total)).select("field", "corrections", "documents", F.round(F.greatest(F.lit(0.0), 1 - F.col("corrections") / F.col("total")), 4).alias("accuracy"))


@register("progress_summary", "SELECT count(*) FILTER (o_orderstatus IN ('F', 'O')) AS enriched, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'X') AS failed, count(*) AS total FROM orders", "orders")
def progress(orders: DataFrame) -> DataFrame:
    s = F.col("o_orderstatus")
    return orders.agg(F.count_if(s.isin("F", "O")).alias("enriched"), F.count_if(s == "P").alias("pending"), F.count_if(s == "X").alias("failed"), F.count("*").alias("total"))


@register("resource_usage", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1", "events")
def resource_usage(events: DataFrame) -> DataFrame:
    v = "value"
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"), F.round(F.avg(v), 6).alias("mean"))


@register("metrics_by_group", "SELECT coalesce(c_mktsegment, 'other') AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS c_acctbal FROM customer GROUP BY 1", "customer")
def metrics_by_group(customer: DataFrame) -> DataFrame:
    return A.means_by(customer, F.coalesce("c_mktsegment", F.lit("other")).alias("segment"), ["c_acctbal"])


@register("duplicate_titles", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1", "part")
def duplicate_titles(part: DataFrame) -> DataFrame:
    return part.groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")


@register("cross_domain_keys", "SELECT s_nationkey, list_sort(list(DISTINCT p_brand)) AS brands FROM (SELECT DISTINCT s_nationkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey) GROUP BY 1 HAVING count(DISTINCT p_brand) > 1", "lineitem", "supplier", "part")
def cross_domain(lineitem: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    pairs = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select("s_nationkey", "p_brand").distinct()
    return pairs.groupBy("s_nationkey").agg(F.array_sort(F.collect_set("p_brand")).alias("brands")).where(F.size("brands") > 1)


@register("check_summary", """SELECT 'no_orphan_orders' AS name, count(*) = 0 AS passed, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'no_negative_quantity', count(*) = 0, count(*) FROM lineitem WHERE l_quantity < 0 UNION ALL SELECT 'unique_parts', count(*) = 0, count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)""", "orders", "customer", "lineitem", "part")
def check_summary(orders: DataFrame, customer: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    checks = {
        "no_orphan_orders": orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "no_negative_quantity": lineitem.where("l_quantity < 0"),
        "unique_parts": part.groupBy("p_partkey").agg(F.count("*").alias("n")).where("n > 1"),
    }
    return J.union_all([df.agg(F.lit(name).alias("name"), (F.count("*") == 0).alias("passed"), F.count("*").alias("n")) for name, df in checks.items()])


@register("findings_grade", """SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 60 THEN 'B' ELSE 'C' END AS grade FROM (
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS errors, count(*) FILTER (l_returnflag = 'A') AS warnings, count(*) AS findings, greatest(0.0, least(100.0, 100 - 20.0 * count(*) FILTER (l_returnflag = 'R') - 5.0 * count(*) FILTER (l_returnflag = 'A')))::DOUBLE AS score FROM lineitem GROUP BY 1)""", "lineitem")
def findings_grade(lineitem: DataFrame) -> DataFrame:
    severity = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("info")
    return A.severity_score(lineitem, "l_orderkey", severity, 20.0, 5.0, [(90, "A"), (60, "B"), (0, "C")])


@register("same_content_groups", "SELECT doc_id, hash, n, first FROM (SELECT doc_id, md5(text) AS hash, count(*) OVER w AS n, min(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY text)) WHERE n > 1", "documents")
def same_content(docs: DataFrame) -> DataFrame:
    """Members of groups of equal texts, each with the group's size and first member."""
    hashed = docs.select("doc_id", F.md5("text").alias("hash"))
    groups = hashed.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    return hashed.join(groups, "hash").select("doc_id", "hash", "n", "first")


@register("tag_cloud", "SELECT trim(t) AS tag, count(*) AS n FROM (SELECT unnest(string_split(replace(p_type, ' ', ', '), ',')) AS t FROM part) WHERE trim(t) <> '' GROUP BY 1", "part")
def tag_cloud(part: DataFrame) -> DataFrame:
    return A.tag_cloud(part, F.replace("p_type", F.lit(" "), F.lit(", ")))


@register("group_by_best_score", """SELECT c_nationkey, c_custkey, c_acctbal, best, dense_rank() OVER (ORDER BY best DESC, c_nationkey)::INTEGER AS group_rank FROM (SELECT *, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS best FROM customer)""", "customer")
def group_by_best(customer: DataFrame) -> DataFrame:
    """Members beside their group's best; groups are ranked over one row per group."""
    best = customer.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"))
    ranked = best.withColumn("group_rank", F.dense_rank().over(Window.orderBy(F.desc("best"), "c_nationkey")))
    return customer.join(ranked, "c_nationkey").select("c_nationkey", "c_custkey", "c_acctbal", "best", "group_rank")


@register("group_by_clause", """SELECT coalesce(k, doc_id::VARCHAR) AS clause, min(doc_id) AS anchor, arg_min(source, doc_id) AS commodity, count(*) AS n FROM (SELECT *, nullif(regexp_extract(text, '([A-Z][a-z]+ion)', 1), '') AS k FROM documents) GROUP BY 1""", "documents")
def group_by_clause(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.nullif(F.regexp_extract("text", "([A-Z][a-z]+ion)", 1), F.lit("")), F.col("doc_id").cast("string"))
    return docs.groupBy(key.alias("clause")).agg(F.min("doc_id").alias("anchor"), F.min_by("source", "doc_id").alias("commodity"), F.count("*").alias("n"))


@register("traceability", """SELECT user_id, [0.0, 0.3, 0.6, 0.9][1 + least(3, count(DISTINCT event_type) - 1)]::DOUBLE AS traceability FROM events GROUP BY 1""", "events")
def traceability(events: DataFrame) -> DataFrame:
    kinds = F.count_distinct("event_type")
    return events.groupBy("user_id").agg(F.when(kinds <= 1, 0.0).when(kinds == 2, 0.3).when(kinds == 3, 0.6).otherwise(0.9).alias("traceability"))


@register("readiness_score", """SELECT *, CASE WHEN score >= 80 THEN 'ready' WHEN score >= 50 THEN 'partial' ELSE 'blocked' END AS class FROM (SELECT o_custkey, greatest(0, 100 - 15 * count(*) FILTER (o_orderstatus = 'O') - 5 * count(*) FILTER (o_orderstatus = 'P'))::BIGINT AS score FROM orders GROUP BY 1)""", "orders")
def readiness(orders: DataFrame) -> DataFrame:
    s = F.col("o_orderstatus")
    scored = orders.groupBy("o_custkey").agg(F.greatest(F.lit(0), 100 - 15 * F.count_if(s == "O") - 5 * F.count_if(s == "P")).cast("long").alias("score"))
    return scored.withColumn("class", F.when(F.col("score") >= 80, "ready").when(F.col("score") >= 50, "partial").otherwise("blocked"))


@register("policy_means", "SELECT event_type AS context, user_id % 5 AS action, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2", "events")
def policy_means(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("context"), (F.col("user_id") % 5).alias("action")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register("concentration_index", "SELECT round(sum(n * n) / (sum(n) * sum(n)), 6) AS hhi FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)", "lineitem")
def concentration(lineitem: DataFrame) -> DataFrame:
    return A.concentration(lineitem, "l_suppkey")


@register("coverage_by_bucket", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars >= 500) AS long_docs, round(100.0 * count(*) FILTER (n_chars >= 500) / count(*), 2) AS pct FROM documents GROUP BY 1", "documents")
def coverage(docs: DataFrame) -> DataFrame:
    long_docs = F.count_if(F.col("n_chars") >= 500)
    return docs.groupBy("lang").agg(F.count("*").alias("n"), long_docs.alias("long_docs"), F.round(100.0 * long_docs / F.count("*"), 2).alias("pct"))


@register("gap_buckets", "SELECT source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'identified' ELSE 'unidentified' END AS bucket, count(*) AS n FROM documents GROUP BY 1, 2", "documents", "labels")
def gap_buckets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    marked = docs.join(labels.select("doc_id").distinct().withColumn("has", F.lit(True)), "doc_id", "left")
    return marked.groupBy("source", F.when(F.col("has"), "identified").otherwise("unidentified").alias("bucket")).agg(F.count("*").alias("n"))


@register("confusion_at_threshold", "SELECT count(*) FILTER (toxic = 1 AND quality <= 0) AS tp, count(*) FILTER (toxic <> 1 AND quality <= 0) AS fp, count(*) FILTER (toxic = 1 AND quality > 0) AS fn, count(*) FILTER (toxic <> 1 AND quality > 0) AS tn FROM labels", "labels")
def confusion(labels: DataFrame) -> DataFrame:
    return A.confusion(labels, F.col("toxic") == 1, 1 - F.col("quality"), 1)


@register("f_beta_score", """SELECT round(CASE WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) END, 6) AS f FROM (SELECT count(*) FILTER (toxic = 1 AND quality <= 0) AS tp, count(*) FILTER (toxic <> 1 AND quality <= 0) AS fp, count(*) FILTER (toxic = 1 AND quality > 0) AS fn FROM labels)""", "labels")
def f_beta(labels: DataFrame) -> DataFrame:
    return confusion(labels).select(F.round(A.f_beta(F.col("tp"), F.col("fp"), F.col("fn"), 0.5), 6).alias("f"))


@register("pairwise_accuracy", """SELECT round(avg((p.value > n.value)::INT), 6) AS accuracy, round(avg(p.value - n.value), 6) AS margin, count(*) AS pairs FROM events p JOIN events n ON p.user_id = n.user_id WHERE p.event_type = 'purchase' AND n.event_type = 'view'""", "events")
def pairwise(events: DataFrame) -> DataFrame:
    """By ranks: a purchase wins over the user's views of less value, counted by running sums, without making the pairs."""
    rows = events.where("event_type IN ('purchase', 'view') AND value IS NOT NULL").select("user_id", "value", (F.col("event_type") == "purchase").cast("long").alias("pos"), (F.col("event_type") == "view").cast("long").alias("neg"))
    values = rows.groupBy("user_id", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = F.sum("neg").over(Window.partitionBy("user_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    wins = values.withColumn("below", F.coalesce(below, F.lit(0)))
    users = wins.groupBy("user_id").agg(F.sum(F.col("pos") * F.col("below")).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * F.col("value")).alias("sp"), F.sum(F.col("neg") * F.col("value")).alias("sn"))
    pairs = F.sum(F.col("p") * F.col("n"))
    return users.agg(F.round(F.sum("wins") / pairs, 6).alias("accuracy"), F.round(F.sum(F.col("sp") * F.col("n") - F.col("sn") * F.col("p")) / pairs, 6).alias("margin"), pairs.alias("pairs"))


@register("points_per_document", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1", "lineitem")
def points_per_document(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("gaps_by_document", "SELECT source, count(*) FILTER (quality IS NULL) AS gaps, count(*) AS n, round(count(*) FILTER (quality IS NULL) / count(*), 4) AS ratio, list_sort(list(DISTINCT lang)) AS langs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1", "documents", "labels")
def gaps_by_document(docs: DataFrame, labels: DataFrame) -> DataFrame:
    gap = F.count_if(F.col("quality").isNull())
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(gap.alias("gaps"), F.count("*").alias("n"), F.round(gap / F.count("*"), 4).alias("ratio"), F.array_sort(F.collect_set("lang")).alias("langs"))


# --- filters ---


@register("payload_filter_algebra", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND (p_size = 10 OR p_size = 20 OR p_size = 1) AND NOT p_type = 'ECONOMY'", "part")
def payload_algebra(part: DataFrame) -> DataFrame:
    spec = {"must": [{"p_brand": "Brand#11"}], "should": [{"p_size": 10}, {"p_size": 20}, {"p_size": 1}], "must_not": [{"p_type": "ECONOMY"}]}
    return part.where(P.payload_filter(spec)).select("p_partkey")


@register("payload_filter_list", "SELECT p_partkey FROM part WHERE p_size = 1 AND p_size = 2", "part")
def payload_list(part: DataFrame) -> DataFrame:
    return part.where(P.payload_filter({"p_size": [1, 2]})).select("p_partkey")


@register("payload_filter_any", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 2)", "part")
def payload_any(part: DataFrame) -> DataFrame:
    return part.where(P.member_filter({"p_size": [1, 2]})).select("p_partkey", "p_size")


@register("scope_filter", "SELECT p_partkey FROM part WHERE p_size::VARCHAR = '7' AND (p_brand = 'Brand#12' OR p_type = 'Brand#12')", "part")
def scope_filter(part: DataFrame) -> DataFrame:
    return part.where(P.section_scope(F.col("p_size").cast("string"), F.col("p_brand"), F.col("p_type"), "7", "Brand#12")).select("p_partkey")


@register("caller_pin_filter", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND p_size = 9", "part")
def caller_pin(part: DataFrame) -> DataFrame:
    return part.where(P.merged_filter({"p_brand": "Brand#12", "p_size": 7}, {"p_size": 9}, pin="p_size")).select("p_partkey")


@register("ilike_multi_column", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(source), 'tion')", "documents")
def ilike(docs: DataFrame) -> DataFrame:
    return docs.where(P.contains_any(["text", "source"], "tion")).select("doc_id")


@register("search_entities", """SELECT * FROM (SELECT 'part' AS kind, p_partkey::VARCHAR AS key FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_type), '1') ORDER BY p_partkey LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'customer', c_custkey::VARCHAR FROM customer WHERE contains(lower(c_name), '1') ORDER BY c_custkey LIMIT 20)""", "part", "customer")
def search_entities(part: DataFrame, customer: DataFrame) -> DataFrame:
    return P.matching_entities([("part", part, "p_partkey", ["p_name", "p_type"]), ("customer", customer, "c_custkey", ["c_name"])], "1", 20)


@register("resolve_registry", """SELECT DISTINCT name, nation, CASE WHEN name LIKE '%1' THEN 0 ELSE 1 END AS name_rank FROM (SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier)
WHERE contains(lower(name), '00') AND contains(lower(name), '1') AND (nation = 3 OR nation = 5) ORDER BY name_rank, name, nation LIMIT 25""", "customer", "supplier")
def resolve_registry(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """All name tokens and any of the localities, over two registries, distinct, best names first."""
    both = customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).unionByName(supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    named = P.all_of([P.contains_any(["name"], t) for t in ("00", "1")])
    found = both.where(named & F.col("nation").isin(3, 5)).dropDuplicates(["name", "nation"])
    return found.withColumn("name_rank", F.when(F.col("name").endswith("1"), 0).otherwise(1)).orderBy("name_rank", "name", "nation").limit(25)


@register("classify_road", "SELECT page_id, CASE WHEN contains(url, '/en/') OR contains(url, '/es/') THEN 'main' WHEN contains(url, '/fr/') THEN 'confusable' END AS family FROM pages", "pages")
def classify_road(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", P.first_class(F.col("url"), [("main", ["/en/", "/es/"]), ("confusable", ["/fr/"])]).alias("family"))


@register("optional_filters_range", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent') AND o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'", "orders")
def optional_range(orders: DataFrame) -> DataFrame:
    return P.optional_filters(orders, {"o_orderstatus": "O", "o_custkey": None}, {"o_orderpriority": "URGENT"}, "1995-01-01", "1997-12-31", "o_orderdate").select("o_orderkey")


@register("diary_entries", """SELECT o_orderdate::DATE AS date, 'order' AS src, o_orderkey AS seq FROM orders WHERE o_orderdate::DATE <= DATE '1995-06-30' AND (o_orderstatus IS NULL OR o_orderstatus <> 'P')
UNION ALL SELECT l_shipdate::DATE, 'ship', l_orderkey FROM lineitem WHERE l_shipdate::DATE <= DATE '1995-06-30'""", "orders", "lineitem")
def diary(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Two sources as one diary; a missing purpose is no reason to leave an entry out."""
    a = orders.where(F.col("o_orderstatus").isNull() | (F.col("o_orderstatus") != "P")).select(F.to_date("o_orderdate").alias("date"), F.lit("order").alias("src"), F.col("o_orderkey").alias("seq"))
    b = lineitem.select(F.to_date("l_shipdate").alias("date"), F.lit("ship").alias("src"), F.col("l_orderkey").alias("seq"))
    return a.unionByName(b).where("date <= DATE '1995-06-30'").orderBy("date", "src", "seq")


@register("entity_in_evidence", "SELECT source, bool_or(contains(lower(text), 'than')) AS found FROM documents GROUP BY 1", "documents")
def entity_in_evidence(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.bool_or(F.lower("text").contains("than")).alias("found"))


@register("injectable_rows", "SELECT doc_id FROM documents WHERE length(text) >= 400", "documents")
def injectable(docs: DataFrame) -> DataFrame:
    return docs.where(F.length("text") >= 400).select("doc_id")


@register("index_like_rows", r"SELECT doc_id, (length(trim(text)) < 40 OR regexp_matches(text, '(?m)^\s*\S+\s*\.{3,}\s*\d+\s*$')) AS is_index, regexp_matches(text, '(?i)\b(shall be (substituted|inserted|omitted)|amendment)\b') AS is_amendment FROM documents", "documents")
def index_like(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select("doc_id", ((F.length(F.trim(t)) < 40) | t.rlike(r"(?m)^\s*\S+\s*\.{3,}\s*\d+\s*$")).alias("is_index"), t.rlike(r"(?i)\b(shall be (substituted|inserted|omitted)|amendment)\b").alias("is_amendment"))


@register("billable_rows", """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber)::INTEGER AS idx FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND l_linestatus <> 'O' AND l_returnflag IN ('A', 'R')""", "lineitem")
def billable(lineitem: DataFrame) -> DataFrame:
    kept = lineitem.where("l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND l_linestatus <> 'O'").where(F.col("l_returnflag").isin("A", "R"))
    return kept.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")).alias("idx"))


# --- joins ---


@register("inner_join_by_name", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", "customer", "nation")
def inner_join(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@register("sync_classify", """SELECT coalesce(a.k, b.k) AS k, a.v AS local, b.v AS remote, CASE WHEN a.v IS NULL THEN 'insert' WHEN b.v IS NULL THEN 'push' WHEN b.v > a.v THEN 'apply' WHEN b.v < a.v THEN 'conflict' ELSE 'same' END AS action
FROM (SELECT o_orderkey AS k, o_custkey % 5 AS v FROM orders WHERE o_orderkey % 4 <> 0) a FULL JOIN (SELECT o_orderkey AS k, o_orderkey % 5 AS v FROM orders WHERE o_orderkey % 3 <> 0) b ON a.k = b.k""", "orders")
def sync_classify(orders: DataFrame) -> DataFrame:
    local = orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("v"))
    remote = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("v"))
    return J.merge_actions(local, remote, "k", "v")


@register("conflict_winner", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_custkey END AS value FROM orders WHERE o_orderstatus = 'P'", "orders")
def conflict_winner(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderstatus = 'P'").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.col("o_custkey").cast("double")).alias("value"))


@register("dirty_rows", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) s ON c_custkey = o_custkey WHERE s.at IS NULL", "customer", "orders")
def dirty(customer: DataFrame, orders: DataFrame) -> DataFrame:
    state = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"))
    return J.dirty_rows(customer, state, "c_custkey", "at").select("c_custkey")


@register("tiered_lookup", """WITH a AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_partkey, min(l_orderkey) AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber, coalesce(a.v, b.v) AS anchor, CASE WHEN a.n > 0 THEN 'own' WHEN b.n > 0 THEN 'act' END AS tier, CASE WHEN coalesce(a.n, b.n) = 1 THEN 0.95 WHEN coalesce(a.n, b.n) > 1 THEN 0.7 END::DOUBLE AS confidence
FROM lineitem l LEFT JOIN a ON l.l_partkey = a.l_partkey AND l.l_suppkey = a.l_suppkey LEFT JOIN b ON l.l_partkey = b.l_partkey WHERE l.l_returnflag <> 'R'""", "lineitem")
def tiered(lineitem: DataFrame) -> DataFrame:
    want = lineitem.where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    found = J.tiered_lookup(want, lineitem.where("l_returnflag = 'R'"), [(["l_partkey", "l_suppkey"], "own"), (["l_partkey"], "act")], "l_orderkey")
    return found.select("l_orderkey", "l_linenumber", "anchor", "tier", "confidence")


@register("numeric_conflicts", """WITH f AS (SELECT source AS k, doc_id, list_distinct(regexp_extract_all(text, '\\d{3,}', 0)) AS v FROM documents)
SELECT a.k, a.doc_id, count(b.doc_id) AS n_conflicts FROM f a LEFT JOIN f b ON a.k = b.k AND len(b.v) > 0 AND len(list_intersect(a.v, b.v)) = 0 WHERE len(a.v) > 0 GROUP BY 1, 2""", "documents")
def numeric_conflicts(docs: DataFrame) -> DataFrame:
    facts = docs.select(F.col("source").alias("k"), "doc_id", F.regexp_extract_all("text", F.lit(r"\d{3,}"), F.lit(0)).alias("v"))
    return J.conflicts(facts, "k", "doc_id", "v")


@register("wildcard_cover", """SELECT l_orderkey, l_linenumber, count(*) AS covered FROM lineitem JOIN (SELECT s_nationkey % 3 AS f, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 7 END AS s FROM supplier) u ON l_partkey % 3 = u.f AND (u.s IS NULL OR l_suppkey % 7 = u.s) GROUP BY 1, 2""", "lineitem", "supplier")
def wildcard_cover(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Equal units are counted first: three families and eight sections, wildcard included, whatever the input."""
    units = supplier.select((F.col("s_nationkey") % 3).alias("f"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 7).alias("s")).groupBy("f", "s").agg(F.count("*").alias("n"))
    return lineitem.join(F.broadcast(units), J.covers(F.col("l_partkey") % 3, F.col("l_suppkey") % 7, F.col("f"), F.col("s"))).groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("covered"))


@register("first_seen_lookup", "SELECT l_partkey, l_suppkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS body FROM lineitem GROUP BY 1, 2", "lineitem")
def first_seen(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("body"), "l_linenumber")
    return J.first_by(rows, ["l_partkey", "l_suppkey"], [F.col("body"), F.col("l_linenumber")]).select("l_partkey", "l_suppkey", "body")


@register("covered_by_corpus", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)", "customer", "orders", "supplier")
def covered_by_corpus(customer: DataFrame, orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """Anti-joins on either of two keys, one after the other."""
    left = customer.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return left.join(supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti").select("c_custkey")


@register("citation_membership", "SELECT l_orderkey, list_sort(list_intersect(c, r)) AS cited, list_sort(list_filter(c, lambda x: NOT list_contains(r, x))) AS phantom FROM (SELECT l_orderkey, list(DISTINCT l_partkey) AS c, list(DISTINCT l_suppkey) AS r FROM lineitem GROUP BY 1)", "lineitem")
def citation_membership(lineitem: DataFrame) -> DataFrame:
    g = lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("c"), F.collect_set("l_suppkey").alias("r"))
    return g.select("l_orderkey", F.array_sort(F.array_intersect("c", "r")).alias("cited"), F.array_sort(F.array_except("c", "r")).alias("phantom"))


# --- ordered ---


@register("forward_fill_section", """SELECT conv_id, turn, own, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS own_filled, own IS NOT NULL AS is_own FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN left(text, 12) END AS own FROM conversations)""", "conversations")
def fill_section(conv: DataFrame) -> DataFrame:
    rows = conv.select("conv_id", "turn", F.when(F.col("role") == "user", F.substring("text", 1, 12)).alias("own"))
    return W.forward_fill(rows, ["conv_id"], ["turn"], ["own"], "is_own")


@register("date_group_flags", "SELECT o_orderkey, row_number() OVER w = 1 AS first_of_group, count(*) OVER (PARTITION BY o_orderdate::DATE) AS group_size FROM orders WINDOW w AS (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey)", "orders")
def date_flags(orders: DataFrame) -> DataFrame:
    return W.group_flags(orders.select("o_orderkey", F.to_date("o_orderdate").alias("d")), ["d"], ["o_orderkey"]).select("o_orderkey", "first_of_group", "group_size")


@register("next_version", "SELECT o_custkey, o_orderstatus, max(o_orderkey % 9) + 1 AS next FROM orders GROUP BY 1, 2", "orders")
def next_version(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey", "o_orderstatus").agg((F.max(F.col("o_orderkey") % 9) + 1).alias("next"))


@register("changed_only_versions", """SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS version FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 OR event_type IS DISTINCT FROM was""", "events")
def changed_only(events: DataFrame) -> DataFrame:
    return W.changes_only(events, ["user_id"], ["ts", "event_id"], F.col("event_type")).select("user_id", "event_id", "event_type", "version")


@register("timeline_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS pos FROM events WHERE ts IS NOT NULL", "events")
def timeline(events: DataFrame) -> DataFrame:
    return events.where("ts IS NOT NULL").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))


@register("sequence_check", """SELECT user_id, min(ts) FILTER (event_type = 'purchase') < min(ts) FILTER (event_type = 'view') AS wrong FROM events GROUP BY 1""", "events")
def sequence_check(events: DataFrame) -> DataFrame:
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    return events.groupBy("user_id").agg((at("purchase") < at("view")).alias("wrong"))


@register("inversion_check", "SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS was FROM lineitem) WHERE l_shipdate < was", "lineitem")
def inversion(lineitem: DataFrame) -> DataFrame:
    return W.inversions(lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_shipdate").select("l_orderkey", "l_linenumber")


@register("current_version", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O') DESC, coalesce(strftime(o_orderdate, '%Y-%m-%d'), '') DESC, o_orderkey) AS r FROM orders) WHERE r = 1", "orders")
def current_version(orders: DataFrame) -> DataFrame:
    eff = F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(""))
    return W.latest(orders, ["o_custkey"], [F.desc(F.col("o_orderstatus") == "O"), eff.desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@register("renumbered_letters", "SELECT o_custkey, o_orderkey, CASE WHEN r <= 26 THEN chr((64 + r)::INTEGER) END AS letter FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)", "orders")
def letters(orders: DataFrame) -> DataFrame:
    return W.letters(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "letter")


@register("sequence_codes", "SELECT o_orderkey, 'INSP-' || year(o_orderdate) || '-' || lpad((row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey))::VARCHAR, 5, '0') AS code FROM orders", "orders")
def codes(orders: DataFrame) -> DataFrame:
    return W.sequence_codes(orders, "INSP", "o_orderdate", ["o_orderkey"]).select("o_orderkey", "code")


@register("char_budget_pack", """SELECT source, doc_id, length(CASE WHEN up > 4000 THEN left(text, (4000 - up + length(text))::BIGINT) ELSE text END)::BIGINT AS n FROM (SELECT *, sum((up > 4000)::INT) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS o FROM (SELECT *, sum(length(text)) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS up FROM documents))
WHERE o = 0 OR (o = 1 AND up > 4000 AND 4000 - up + length(text) > 200)""", "documents")
def budget(docs: DataFrame) -> DataFrame:
    packed = W.pack_budget(docs, ["source"], [F.col("n_chars"), F.col("doc_id")], "text", 4000, 200)
    return packed.select("source", "doc_id", F.length("text").cast("long").alias("n"))


@register("hash_chain_build", """WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, concat_ws('|', event_type, event_id::VARCHAR) AS l FROM events),
c AS (SELECT user_id, event_id, r, sha256(l) AS h FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.event_id, o.r, sha256(c.h || o.l) FROM c JOIN o ON o.user_id = c.user_id AND o.r = c.r + 1)
SELECT user_id, event_id, h AS curr_hash FROM c""", "events")
def chain_build(events: DataFrame) -> DataFrame:
    return W.chained(events, ["user_id"], ["event_id"], ["event_type", "event_id"]).select("user_id", "event_id", "curr_hash")


@register("hash_chain_verify", "SELECT user_id, bool_and(event_id % 97 <> 0) AS intact, count(*) AS n FROM events GROUP BY 1", "events")
def chain_verify(events: DataFrame) -> DataFrame:
    """A chain that was tampered with at every 97th event fails where such an event stands."""
    built = W.chained(events, ["user_id"], ["event_id"], ["event_type", "event_id"]).join(events.select("user_id", "event_id", "event_type"), ["user_id", "event_id"])
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = built.withColumn("prev_hash", F.lag("curr_hash").over(w)).withColumn("event_type", F.when(F.col("event_id") % 97 == 0, "forged").otherwise(F.col("event_type")))
    return W.chain_intact(rows, ["user_id"], ["event_id"], F.concat_ws("|", "event_type", F.col("event_id").cast("string")), "prev_hash", "curr_hash")


# --- dates and amounts ---


@register("multi_format_dates", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders""", "orders")
def multi_format(orders: DataFrame) -> DataFrame:
    """Dates written in several forms, and one that is none."""
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    written = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "dd/MM/yyyy")).when(k == 2, F.date_format(at, "d MMMM yyyy")).otherwise("soon")
    return orders.select("o_orderkey", D.parse_date(written).alias("d"))


@register("deadlines", """SELECT o_orderkey, o_orderdate::DATE + 365 AS petition, o_orderdate::DATE + 30 AS compliance, strftime(o_orderdate, '%d-%m-%Y') AS shown, DATE '1998-01-01' < o_orderdate::DATE + 30 AS blocked FROM orders""", "orders")
def deadlines(orders: DataFrame) -> DataFrame:
    d = F.to_date("o_orderdate")
    return orders.select("o_orderkey", D.petition_deadline(d).alias("petition"), D.compliance_deadline(d).alias("compliance"), D.indian_date(d).alias("shown"), D.generation_blocked(d, F.lit(None).cast("date"), F.lit("1998-01-01").cast("date")).alias("blocked"))


@register("handover_date", "SELECT l_orderkey, greatest(max(l_shipdate) FILTER (l_returnflag = 'A'), max(l_shipdate) FILTER (l_returnflag = 'R'))::DATE AS handover FROM lineitem GROUP BY 1", "lineitem")
def handover(lineitem: DataFrame) -> DataFrame:
    at = lambda k: F.to_date(F.max(F.when(F.col("l_returnflag") == k, F.col("l_shipdate"))))
    return lineitem.groupBy("l_orderkey").agg(D.latest_date(at("A"), at("R")).alias("handover"))


@register("as_of_validity", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'invalid' WHEN o_orderdate::DATE <= DATE '1996-06-01' AND (o_orderdate::DATE + 400) >= DATE '1996-06-01' THEN 'valid' ELSE 'invalid' END AS validity FROM orders""", "orders")
def as_of(orders: DataFrame) -> DataFrame:
    d = F.to_date("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "P", "repealed").otherwise("current")
    return orders.select("o_orderkey", D.valid_on(F.lit("1996-06-01").cast("date"), status, d, F.date_add(d, 400)).alias("validity"))


@register("price_text", "SELECT p_partkey, round(p_retailprice, 2) AS price FROM part", "part")
def price_text(part: DataFrame) -> DataFrame:
    shown = F.concat(F.lit("Rs. "), F.format_number("p_retailprice", 2))
    return part.select("p_partkey", D.price(shown).alias("price"))


@register("amount_words", None, "part")
def amount_words(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", D.rupees_in_words(F.col("p_retailprice").cast("long")).alias("words"))


@register("json_bag_merge", """SELECT user_id, count(*) AS n, min(k) AS first_k, arg_max(k, (ts, event_id)) AS last_k, list_sort(list(DISTINCT k))[1:10] AS ks FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""", "events")
def json_bag(events: DataFrame) -> DataFrame:
    """A bag per key: a counter, the least, the last, and a capped sorted union."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events.select("user_id", "ts", "event_id", k.alias("k"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("k").alias("first_k"), F.max_by("k", F.struct("ts", "event_id")).alias("last_k"), F.slice(F.array_sort(F.collect_set("k")), 1, 10).alias("ks"))


@register("json_payload", "SELECT event_id, sha256('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS fingerprint FROM events", "events")
def json_payload(events: DataFrame) -> DataFrame:
    """The SHA-256 of canonical JSON, keys sorted."""
    return events.select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id")), 256).alias("fingerprint"))


@register("section_list", "SELECT p_partkey, list_transform(regexp_extract_all(p_size || ', ' || (p_size + 1) || ' and ' || (p_size + 3), '\\d+', 0), lambda x: x::INTEGER) AS ids FROM part", "part")
def section_list(part: DataFrame) -> DataFrame:
    raw = F.concat(F.col("p_size"), F.lit(", "), F.col("p_size") + 1, F.lit(" and "), F.col("p_size") + 3)
    return part.select("p_partkey", F.transform(F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")).alias("ids"))
