"""Graph, set and merge queries over the region, nation, customer, orders graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import graph as G
from lexmill.operators import joins as J
from lexmill.plans._registering import register

EDGES_SQL = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'IN' AS type FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'IN' FROM nation UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'BY' FROM orders),
nodes AS (SELECT 'c' || c_custkey AS id, 'customer' AS label FROM customer UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region UNION ALL SELECT 'o' || o_orderkey, 'order' FROM orders)"""
TABLES = ("customer", "nation", "region", "orders")


def tag(letter: str, key: str):
    return F.concat(F.lit(letter), F.col(key))


def edges_of(customer: DataFrame, nation: DataFrame, region: DataFrame, orders: DataFrame) -> DataFrame:
    return J.union_all([
        customer.select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst"), F.lit("IN").alias("type")),
        nation.select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst"), F.lit("IN").alias("type")),
        orders.select(tag("o", "o_orderkey").alias("src"), tag("c", "o_custkey").alias("dst"), F.lit("BY").alias("type")),
    ])


def nodes_of(customer: DataFrame, nation: DataFrame, region: DataFrame, orders: DataFrame) -> DataFrame:
    parts = ((customer, "c", "c_custkey", "customer"), (nation, "n", "n_nationkey", "nation"), (region, "r", "r_regionkey", "region"), (orders, "o", "o_orderkey", "order"))
    return J.union_all([df.select(tag(letter, key).alias("id"), F.lit(label).alias("label")) for df, letter, key, label in parts])


@register("typed_neighbors", f"WITH {EDGES_SQL} SELECT src, dst, label AS dst_label FROM edges JOIN nodes ON dst = id WHERE type = 'BY'", *TABLES)
def typed_neighbors(*t: DataFrame) -> DataFrame:
    return J.typed_neighbours(nodes_of(*t), edges_of(*t), ["BY"]).select("src", "dst", "dst_label")


@register("optional_match_collect", f"WITH {EDGES_SQL} SELECT id, coalesce((SELECT list_sort(list(DISTINCT src)) FROM edges WHERE dst = id AND type = 'BY'), []) AS \"BY\" FROM nodes WHERE label = 'customer'", *TABLES)
def optional_match(*t: DataFrame) -> DataFrame:
    back = edges_of(*t).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return J.with_collected(nodes_of(*t).where("label = 'customer'").select("id"), back, ["BY"])


@register("orphans_anti", f"WITH {EDGES_SQL} SELECT id FROM nodes WHERE label = 'customer' AND id NOT IN (SELECT dst FROM edges WHERE type = 'BY')", *TABLES)
def orphans(*t: DataFrame) -> DataFrame:
    return J.without_edge(nodes_of(*t).where("label = 'customer'"), edges_of(*t), "BY", "dst").select("id")


@register("semi_then_anti", f"WITH {EDGES_SQL} SELECT id FROM nodes WHERE id IN (SELECT src FROM edges WHERE type = 'IN') AND id NOT IN (SELECT src FROM edges WHERE type = 'BY')", *TABLES)
def semi_anti(*t: DataFrame) -> DataFrame:
    return J.with_but_without(nodes_of(*t), edges_of(*t), "IN", "BY").select("id")


@register("bfs_hops", f"""WITH RECURSIVE {EDGES_SQL}, w(id, hops) AS (SELECT 'r1', 0 UNION SELECT src, hops + 1 FROM w JOIN edges ON dst = w.id WHERE hops < 3) SELECT id, min(hops)::INTEGER AS hops FROM w GROUP BY 1""", *TABLES)
def bfs(*t: DataFrame) -> DataFrame:
    back = edges_of(*t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reach(back, t[0].sparkSession.createDataFrame([("r1",)], "id string"), 3)


@register("induced_edges", f"""WITH {EDGES_SQL} SELECT DISTINCT src, dst, type FROM edges WHERE src IN (SELECT 'c' || c_custkey FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey < 5) AND dst IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey < 5)""", *TABLES)
def induced(customer: DataFrame, nation: DataFrame, region: DataFrame, orders: DataFrame) -> DataFrame:
    keep = customer.where("c_nationkey < 5").select(tag("c", "c_custkey").alias("id")).union(nation.where("n_nationkey < 5").select(tag("n", "n_nationkey")))
    return G.induced(edges_of(customer, nation, region, orders), keep)


@register("connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, -l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, component) USING KEY (id) AS (SELECT a, least(a, min(b)) FROM u GROUP BY a UNION (SELECT u.a, min(r.component) FROM r JOIN u ON u.b = r.id JOIN recurring.r AS own ON own.id = u.a WHERE r.component < own.component GROUP BY u.a))
SELECT id, component FROM r""", "lineitem")
def components(lineitem: DataFrame) -> DataFrame:
    """Orders and parts (as negative numbers) that share lines."""
    return G.components(None, lineitem.select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("dst")))


@register("topo_order", """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey // 4 AS dst FROM orders WHERE o_orderkey // 4 < o_custkey), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
w(id, layer) USING KEY (id) AS (SELECT id, 0 FROM n UNION (SELECT e.src, max(w.layer) + 1 FROM w JOIN e ON e.dst = w.id JOIN recurring.w AS own ON own.id = e.src WHERE w.layer + 1 > own.layer GROUP BY e.src)) SELECT id, layer FROM w""", "orders")
def topo(orders: DataFrame) -> DataFrame:
    """Customers need the smaller numbers that a quarter of their order keys name."""
    needed = F.expr("o_orderkey div 4")
    edges = orders.select(F.col("o_custkey").alias("src"), needed.alias("dst")).where("dst < src").distinct()
    return G.layers(edges, edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())


@register("has_cycle", """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 5 AS src, o_orderkey // 5 % 5 AS dst FROM orders WHERE o_orderkey % 5 <> o_orderkey // 5 % 5),
r(k, a, b) AS (SELECT * FROM e UNION SELECT r.k, r.a, e.dst FROM r JOIN e ON e.k = r.k AND e.src = r.b) SELECT k, bool_or(a = b) AS cyclic FROM r GROUP BY 1""", "orders")
def has_cycle(orders: DataFrame) -> DataFrame:
    """Of the small graph of each customer, all at once: whether some node has no layer."""
    node = lambda c: F.concat_ws(":", "o_custkey", c)
    named = orders.select("o_custkey", (F.col("o_orderkey") % 5).cast("string").alias("a"), F.expr("CAST(o_orderkey div 5 % 5 AS STRING)").alias("b"))
    edges = named.where("a <> b").select(node("a").alias("src"), node("b").alias("dst")).distinct()
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return G.layers(edges, nodes).groupBy(F.substring_index("id", ":", 1).cast("long").alias("k")).agg(F.bool_or(F.col("layer").isNull()).alias("cyclic"))


@register("graph_findings", f"""WITH {EDGES_SQL} SELECT * FROM (VALUES ('repeated_ids', (SELECT count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1))), ('unknown_type', 0), ('forbidden_type', (SELECT count(*) FROM edges WHERE type = 'BY')), ('no_source', 0), ('no_target', (SELECT count(*) FROM edges WHERE dst NOT IN (SELECT id FROM nodes))), ('loops', 0)) v("check", n)""", *TABLES)
def graph_findings(*t: DataFrame) -> DataFrame:
    return G.findings(nodes_of(*t), edges_of(*t), ["IN", "BY"], ["BY"])


@register("first_edge_per_key", "SELECT 'c' || o_custkey AS src, o_orderstatus AS dst, o_orderpriority AS type, min(o_orderkey) AS at FROM orders GROUP BY 1, 2, 3", "orders")
def first_edges(orders: DataFrame) -> DataFrame:
    return G.first_edges(orders.select(tag("c", "o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"), F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("at")), "at")


@register("build_case_graph", "SELECT 'root:' || o_orderkey AS src, 'status:' || o_orderstatus AS dst, 'HAS_STATUS' AS type FROM orders UNION ALL SELECT 'root:' || o_orderkey, 'party:' || o_custkey, 'PARTY' FROM orders", "orders")
def case_graph(orders: DataFrame) -> DataFrame:
    return G.build(orders, {"o_orderstatus": ("status", "HAS_STATUS"), "o_custkey": ("party", "PARTY")}, "o_orderkey")[1]


@register("replace_source_rows", "SELECT o_orderkey, o_custkey, 'old' AS state FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, 'old' FROM orders WHERE o_custkey % 3 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "orders")
def replace_source(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_custkey", F.lit("old").alias("state"))
    new = orders.where("o_custkey % 3 = 0 AND o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.lit("new").alias("state"))
    return G.replace_source(rows, "o_custkey", new)


@register("two_path_union", "SELECT DISTINCT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 UNION SELECT DISTINCT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1", "orders", "customer", "nation")
def two_paths(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    own = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    far = own.join(nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.where("c_nationkey = 3").select("o_orderkey").union(far.select("o_orderkey")).distinct()


@register("provenance_chain", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", "orders", "customer", "nation", "region")
def provenance(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    chain = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return chain.select("o_orderkey", "c_name", "n_name", "r_name")


@register("concept_laws", "SELECT r_name, n_name, count(DISTINCT c_mktsegment) AS segments, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE lower(r_name) = 'asia' GROUP BY 1, 2", "region", "nation", "customer")
def concept_laws(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    j = region.where(F.lower("r_name") == "asia").join(nation, F.col("n_regionkey") == F.col("r_regionkey")).join(customer, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("r_name", "n_name").agg(F.count_distinct("c_mktsegment").alias("segments"), F.count("*").alias("customers"))


# --- sets ---


@register("set_differences", """WITH a AS (SELECT DISTINCT o_orderpriority AS k, o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_orderpriority AS k, o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT k, 'missing' AS side, o_custkey FROM a WHERE (k, o_custkey) NOT IN (SELECT k, o_custkey FROM b) UNION ALL SELECT k, 'extra', o_custkey FROM b WHERE (k, o_custkey) NOT IN (SELECT k, o_custkey FROM a)""", "orders")
def set_differences(orders: DataFrame) -> DataFrame:
    """What only one of two sets has, one row a member: one aggregate instead of two sets and two anti-joins."""
    has = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    g = orders.where("o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL").groupBy(F.col("o_orderpriority").alias("k"), "o_custkey").agg(F.coalesce(has("F"), F.lit(False)).alias("a"), F.coalesce(has("O"), F.lit(False)).alias("b"))
    return g.where("a <> b").select("k", F.when(F.col("a"), "missing").otherwise("extra").alias("side"), "o_custkey")


@register("ordered_union", "SELECT o_custkey, list(i ORDER BY seen, o_orderkey) AS items FROM (SELECT o_custkey, o_orderkey % 7 AS i, o_orderdate AS seen, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY o_orderdate, o_orderkey) = 1) GROUP BY 1", "orders")
def ordered_union(orders: DataFrame) -> DataFrame:
    """Expansion targets in order of appearance, each once."""
    first = orders.groupBy("o_custkey", (F.col("o_orderkey") % 7).alias("i")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("at"))
    listed = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("at", "i"))).alias("l"))
    return listed.select("o_custkey", F.transform("l", lambda x: x["i"]).alias("items"))


@register("edges_without_loops", "SELECT DISTINCT l_partkey % 50 AS src, l_suppkey % 50 AS dst FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50", "lineitem")
def without_loops(lineitem: DataFrame) -> DataFrame:
    return lineitem.select((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 50).alias("dst")).where("src <> dst").distinct()


@register("contamination", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'dev' ELSE 'holdout' END AS split FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY 1", "documents", "labels")
def contamination(docs: DataFrame, labels: DataFrame) -> DataFrame:
    bucket = F.col("doc_id") % 10
    split = F.when(bucket < 7, "train").when(bucket < 9, "dev").otherwise("holdout")
    return docs.join(labels.select("doc_id"), "doc_id", "left_semi").groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@register("no_holdout_overlap", "SELECT count(*) = 0 AS clean FROM documents WHERE doc_id % 10 = 9 AND doc_id IN (SELECT item_id FROM benchmark WHERE item_id % 10 <> 9)", "documents", "benchmark")
def no_holdout(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    over = docs.where("doc_id % 10 = 9").join(benchmark.where("item_id % 10 <> 9").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    return over.agg((F.count("*") == 0).alias("clean"))


@register("hash_split", "SELECT doc_id, source, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'dev' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(sha256(source), 1, 8))::BIGINT % 100 AS h FROM documents)", "documents")
def hash_split(docs: DataFrame) -> DataFrame:
    """A leak-free split by a hash of the group key: all rows of a source fall into one part."""
    part = F.conv(F.substring(F.sha2("source", 256), 1, 8), 16, 10).cast("long") % 100
    return docs.select("doc_id", "source", F.when(part < 80, "train").when(part < 90, "dev").otherwise("test").alias("split"))


@register("balanced_sample", """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT lang, greatest(1, floor(ceil((SELECT avg(n) FROM n)) / n))::INTEGER AS times FROM n)
SELECT doc_id, lang, unnest(generate_series(1, times))::INTEGER AS copy FROM documents JOIN t USING (lang)""", "documents")
def balanced(docs: DataFrame) -> DataFrame:
    """Small domains are repeated up to the mean size of all."""
    n = docs.groupBy("lang").agg(F.count("*").alias("n"))
    target = n.agg(F.ceil(F.avg("n")).alias("target"))
    times = n.join(F.broadcast(target)).select("lang", F.greatest(F.lit(1), F.floor(F.col("target") / F.col("n"))).cast("int").alias("times"))
    return docs.join(F.broadcast(times), "lang").select("doc_id", "lang", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))


# --- keyed writes and deletes as pure merges ---


@register("upsert_latest", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1", "orders")
def upsert_latest(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.o_orderkey", "r.o_orderdate")


@register("delete_by_ids", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')", "orders", "lineitem")
def delete_ids(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return orders.join(lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@register("sheet_union", "SELECT p_name AS name, p_size AS size, NULL AS balance FROM part UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier", "part", "supplier")
def sheet_union(part: DataFrame, supplier: DataFrame) -> DataFrame:
    return J.union_all([part.select(F.col("p_name").alias("name"), F.col("p_size").alias("size")), supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@register("text_index", "SELECT 'part' AS kind, p_partkey::VARCHAR AS key, p_name || ' ' || p_type AS body FROM part UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_name || ' ' || c_mktsegment FROM customer UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name FROM supplier UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_name FROM nation", "part", "customer", "supplier", "nation")
def text_index(part: DataFrame, customer: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    rows = ((part, "part", "p_partkey", ["p_name", "p_type"]), (customer, "customer", "c_custkey", ["c_name", "c_mktsegment"]), (supplier, "supplier", "s_suppkey", ["s_name"]), (nation, "nation", "n_nationkey", ["n_name"]))
    return J.union_all([df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.concat_ws(" ", *columns).alias("body")) for df, kind, key, columns in rows])


@register("typed_cells", "SELECT c_custkey, try_cast(replace(c_name, 'Customer#', '') AS BIGINT) AS number, CASE WHEN c_mktsegment = 'BUILDING' THEN true ELSE false END AS flag FROM customer", "customer")
def typed_cells(customer: DataFrame) -> DataFrame:
    """Cells of a CSV by declared type: what does not parse is null, and true is one of a few words."""
    cell = F.replace("c_name", F.lit("Customer#"), F.lit(""))
    said = F.when(F.col("c_mktsegment") == "BUILDING", "Yes").otherwise("no")
    return customer.select("c_custkey", cell.try_cast("bigint").alias("number"), F.lower(said).isin("true", "1", "yes").alias("flag"))


@register("filtered_page", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20", "documents")
def filtered_page(docs: DataFrame) -> DataFrame:
    return docs.where("lang = 'en'").orderBy("doc_id").limit(20).select("doc_id")


@register("scan_filter_documents", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src0'", "documents")
def scan_filter(docs: DataFrame) -> DataFrame:
    return docs.where("lang = 'en' AND source = 'src0'").select("doc_id", "n_chars")
