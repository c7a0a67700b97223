"""Entities, types, metadata, query parts, caches and graph contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import metadata as D
from lexmill.functions import text as T
from lexmill.operators import metrics as M
from lexmill.operators import phrases as P
from lexmill.plans._registering import register


def notice(part: DataFrame) -> DataFrame:
    text = F.concat(F.lit("The Food Safety Act, 2006 notification. Mr. Ravi Nair v. Acme of the Food Safety Authority, batch "), F.col("p_size"), F.lit("."))
    return part.select("p_partkey", "p_size", text.alias("t"))


_NOTICE = "coalesce(text, '') || ' The Food Safety Act, 20' || (10 + doc_id % 80) || ' notification. Mr. Ravi Nair v. Acme of the Food Safety Authority, batch ' || doc_id || '.'"
_ENTITIES = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS type, {confidence}::DOUBLE AS confidence, unnest(list_distinct(regexp_extract_all(t, '{pattern}', 0))) AS value FROM d" for kind, confidence, pattern in D.ENTITIES)


def noticed(docs: DataFrame) -> DataFrame:
    """Whole texts with a stated notice behind them."""
    return docs.select("doc_id", F.expr(_NOTICE).alias("t"))


@register("rule_entities", f"WITH d AS (SELECT doc_id, {_NOTICE} AS t FROM documents) {_ENTITIES}", "documents")
def rule_entities(docs: DataFrame) -> DataFrame:
    return noticed(docs).select("doc_id", F.explode(D.entities(F.col("t"))).alias("e")).select("doc_id", "e.*")


_HEADS = "CASE doc_id % 6 WHEN 0 THEN 'Rules of 1987. ' WHEN 1 THEN 'NOTIFICATION no 5 ' WHEN 2 THEN 'The petitioner says in 2003: ' WHEN 3 THEN 'Regulation 1750 ' ELSE '' END || coalesce(text, '')"


@register("document_types", rf"""WITH d AS (SELECT doc_id, lower(substr({_HEADS}, 1, 500)) AS h FROM documents),
k AS (SELECT doc_id, h, CASE WHEN regexp_matches(h, '\bact\b') THEN 'act' WHEN regexp_matches(h, '\brules\b') THEN 'rules' WHEN regexp_matches(h, '\bregulations?\b') THEN 'regulations' WHEN regexp_matches(h, '\bnotification\b') THEN 'notification' WHEN regexp_matches(h, '\b(judgment|petitioner)\b') THEN 'judgment' ELSE 'other' END AS kind, nullif(regexp_extract(h, '\b((?:18|19|20)\d{{2}})\b', 1), '')::INTEGER AS year FROM d)
SELECT doc_id, kind, year, CASE WHEN kind = 'other' THEN 0.3 WHEN year IS NULL THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM k""", "documents")
def document_types(docs: DataFrame) -> DataFrame:
    """By the opening of each text, two thirds of them behind a stated one."""
    return docs.select("doc_id", D.document_type(F.expr(_HEADS)).alias("d")).select("doc_id", "d.*")


@register("validated_fields", f"""WITH d AS (SELECT doc_id, {_NOTICE} AS t, lang, source FROM documents), f AS (SELECT doc_id, t, unnest(['batch', 'language', 'source']) AS name, unnest([doc_id::VARCHAR, lang, source]) AS value, unnest([0.6, 0.4, 0.95])::DOUBLE AS c FROM d)
SELECT doc_id, name, value, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, c + CASE WHEN contains(t, value) THEN 0.1 ELSE -0.2 END::DOUBLE)), 6) AS confidence FROM f WHERE value IS NOT NULL""", "documents")
def validated_fields(docs: DataFrame) -> DataFrame:
    """Fields of each document's row, held against its whole text."""
    field = lambda n, v, c: F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(c).alias("confidence"))
    fields = F.array(field("batch", F.col("doc_id").cast("string"), 0.6), field("language", F.col("lang"), 0.4), field("source", F.col("source"), 0.95))
    rows = docs.select("doc_id", F.expr(_NOTICE).alias("t"), fields.alias("f"))
    return rows.select("doc_id", F.explode(D.agreeing(F.col("f"), F.col("t"))).alias("f")).select("doc_id", "f.*").where("value IS NOT NULL")


@register("toc_html", None, "pages")
def toc(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", D.toc_html(T.headings(F.col("html"))).alias("toc"))


@register("split_queries", "SELECT c_custkey, lower(c_mktsegment) AS name, 'nation ' || c_nationkey AS place FROM customer", "customer")
def split_queries(customer: DataFrame) -> DataFrame:
    raw = F.concat(F.col("c_mktsegment"), F.lit("  shop near nation "), F.col("c_nationkey"))
    return customer.select("c_custkey", D.split_query(raw).alias("q")).select("c_custkey", "q.*")


@register("primary_types", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'P' WHEN bool_or(o_orderstatus = 'O') THEN 'O' ELSE 'F' END AS kind FROM orders GROUP BY 1", "orders")
def primary_types(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s")).select("o_custkey", D.precedence(F.col("s"), ("P", "O", "F")).alias("kind"))


@register("form_queries", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'form ' || p_size || 'A' END AS q FROM part", "part")
def form_queries(part: DataFrame) -> DataFrame:
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("which Form "), F.col("p_size"), F.lit("a is due"))).otherwise("which paper is due")
    return part.select("p_partkey", D.form_query(raw).alias("q"))


@register("node_texts", "SELECT c_custkey, concat_ws(' ', c_name, c_mktsegment, c_nationkey::VARCHAR) AS t FROM customer", "customer")
def node_texts(customer: DataFrame) -> DataFrame:
    meta = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return customer.select("c_custkey", D.node_text(F.col("c_name"), meta, ("segment", "missing", "nation")).alias("t"))


@register("ttl_cache", """SELECT user_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL '12 hours', false) AS hit FROM events) GROUP BY 1""", "events")
def ttl_cache(events: DataFrame) -> DataFrame:
    """Hits of a keyed cache whose entries live so long after their last use."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    hit = F.coalesce(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 12 HOURS"), F.lit(False))
    return events.withColumn("hit", hit).groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@register("lru_kept", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r <= 2", "events")
def lru_kept(events: DataFrame) -> DataFrame:
    """What a cache of two entries per user holds in the end."""
    used = events.groupBy("user_id", "event_type").agg(F.max("ts").alias("at"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), "event_type"))
    return used.withColumn("r", rank).where("r <= 2").select("user_id", "event_type")


@register("concept_fallback", "SELECT n_nationkey, CASE WHEN c.n > 0 THEN 'concept' WHEN s.n > 0 THEN 'keyword' ELSE 'none' END AS route, coalesce(c.n, s.n, 0) AS found FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey", "nation", "customer", "supplier")
def concept_fallback(nation: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """The traversal's finds, and where it finds none those of the keyword search."""
    c = customer.where("c_mktsegment = 'MACHINERY'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    s = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    route = F.when(F.col("c") > 0, "concept").when(F.col("s") > 0, "keyword").otherwise("none")
    return nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", route.alias("route"), F.coalesce("c", "s", F.lit(0)).cast("long").alias("found"))


@register("known_section_headers", "SELECT p_partkey, list_filter([p_size, p_size + 40, p_size + 1], lambda x: x BETWEEN 1 AND 50)::INTEGER[] AS headers FROM part", "part")
def known_headers(part: DataFrame) -> DataFrame:
    """Numbers that head a line, in order, as far as the act has them."""
    n = F.col("p_size")
    raw = F.concat(n, F.lit(". One\n"), n + 40, F.lit(". Two\nsee 7\n"), n + 1, F.lit(". Three"))
    found = F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(r"(?m)^(\d{1,4})\.\s"), F.lit(1)), lambda x: x.cast("int")))
    return part.select("p_partkey", F.filter(found, lambda x: x.between(1, 50)).alias("headers"))


@register("suggested_sections", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN ['63'] ELSE list_filter(['55', '56'], lambda x: (x = '55' AND o_totalprice > 100000) OR (x = '56' AND o_orderpriority = '1-URGENT')) END AS sections FROM orders", "orders")
def suggested(orders: DataFrame) -> DataFrame:
    """One status decides alone; else every rule of the checklist that holds adds its section."""
    rules = F.array(F.when(F.col("o_totalprice") > 100000, "55"), F.when(F.col("o_orderpriority") == "1-URGENT", "56"))
    return orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.array(F.lit("63"))).otherwise(F.array_compact(rules)).alias("sections"))


@register("requirement_coverage", "SELECT l_orderkey, round(count(DISTINCT CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag END) / 2, 6) AS coverage FROM lineitem GROUP BY 1", "lineitem")
def requirement_coverage(lineitem: DataFrame) -> DataFrame:
    found = F.count_distinct(F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_returnflag")))
    return lineitem.groupBy("l_orderkey").agg(F.round(found / 2, 6).alias("coverage"))


@register("cross_reference_candidates", "SELECT DISTINCT p_partkey, s AS section FROM (SELECT p_partkey, unnest([p_size, p_size + 1, p_size])::VARCHAR AS s FROM part)", "part")
def crossref(part: DataFrame) -> DataFrame:
    """Candidates from citations, from references and from the text, each section once."""
    n = F.col("p_size").cast("string")
    sources = F.flatten(F.array(F.array(n), F.array((F.col("p_size") + 1).cast("string")), F.regexp_extract_all(F.concat(F.lit("section "), n), F.lit(r"section (\d+)"), F.lit(1))))
    return part.select("p_partkey", F.explode(F.array_distinct(sources)).alias("section"))


_LOGITS = "SELECT doc_id, ln(1 + n_chars) * 3 - 15 AS logit, quality AS label FROM documents JOIN labels USING (doc_id)"


@register("temperature_scaled", f"""WITH r AS ({_LOGITS}), g AS (SELECT unnest(range(5, 51)) AS t),
l AS (SELECT t, round(avg(ln(1 + exp(-abs(logit * 10 / t))) + greatest(logit * 10 / t, 0.0) - logit * 10 / t * label), 9) AS loss FROM r, g WHERE logit IS NOT NULL AND label IS NOT NULL GROUP BY t),
b AS (SELECT t / 10 AS temperature, loss FROM l ORDER BY loss, t LIMIT 1) SELECT doc_id, temperature, round(1 / (1 + exp(-logit / temperature)), 6) AS p FROM r, b""", "documents", "labels")
def temperature(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A logit from the length, the temperature that fits it best to the labels, and the probability that results."""
    rows = docs.join(labels, "doc_id").select("doc_id", (F.log(1 + F.col("n_chars")) * 3 - 15).alias("logit"), F.col("quality").alias("label"))
    fitted = rows.join(F.broadcast(M.fit_temperature(rows)))
    return fitted.select("doc_id", "temperature", F.round(1 / (1 + F.exp(-F.col("logit") / F.col("temperature"))), 6).alias("p"))


_FIELDS = {"title": "", "version": "Latest", "date": "", "authority": "", "gazette_number": "", "notification_number": "", "language": "english", "jurisdiction": "India", "state": "", "country": "India", "document_type": "Notification", "amendment_status": "Original", "effective_date": ""}
_STATES = "Andhra Pradesh,Arunachal Pradesh,Assam,Bihar,Chhattisgarh,Goa,Gujarat,Haryana,Himachal Pradesh,Jharkhand,Karnataka,Kerala,Madhya Pradesh,Maharashtra,Manipur,Meghalaya,Mizoram,Nagaland,Odisha,Punjab,Rajasthan,Sikkim,Tamil Nadu,Telangana,Tripura,Uttar Pradesh,Uttarakhand,West Bengal"
#: Rules of this table's own; a domain brings its own table, of any length.
FIELD_RULES = [
    P.Rule("title", "named act", "pattern", r"\b(?!The )((?:[A-Z][a-z]+,? (?:and |of )?)+(?:Act|Rules|Regulations|Order), \d{4})", 0.9),
    P.Rule("title", "capital act", "pattern", r"\b(?:THE )?([A-Z][A-Z &]+ (?:ACT|RULES|REGULATIONS|ORDER)), \d{4}", 0.85),
    P.Rule("version", "edition", "pattern", r"(?i)\b(\d+(?:st|nd|rd|th)) amendment", 0.8, None, "amendment"),
    P.Rule("date", "dated", "pattern", r"(?i)\bdated(?: the)? (\d{1,2}(?:st|nd|rd|th)? [a-z]+,? \d{4})", 0.9, None, "dated"),
    P.Rule("date", "numbers", "pattern", r"\b(\d{4}-\d{2}-\d{2})\b", 0.7),
    *[P.Rule("authority", name, "phrase", name, 0.9, name) for name in ("Food Safety and Standards Authority", "Ministry of Health", "Bureau of Standards", "Ministry of Commerce", "Legislative Department")],
    P.Rule("gazette_number", "gazette", "pattern", r"(?i)\bgazette[^\n]{0,40}?no\.? ?([\w/-]*\d[\w/-]*)", 0.85, None, "gazette"),
    P.Rule("notification_number", "file", "pattern", r"(?i)\bnotification no\.? ?([\w./-]*\d[\w/-]*)", 0.85, None, "notification no"),
    *[P.Rule("language", name, "phrase", word, 0.8, name) for name, word in (("hindi", "rajpatra"), ("french", "journal officiel"), ("german", "bundesgesetzblatt"))],
    *[P.Rule("state", s, "phrase", s, 0.9, s) for s in _STATES.split(",")],
    *[P.Rule("jurisdiction", s, "phrase", f"Government of {s}", 0.9, s) for s in _STATES.split(",")],
    *[P.Rule("document_type", name, "phrase", word, c, name) for name, word, c in (("Act", "act", 0.6), ("Rules", "rules", 0.7), ("Regulation", "regulations", 0.75), ("Judgment", "petitioner", 0.8), ("Circular", "circular", 0.7))],
    *[P.Rule("amendment_status", name, "phrase", word, 0.8, name) for name, word in (("Repealed", "hereby repealed"), ("Amended", "as amended by"), ("Amended", "amendment"))],
    P.Rule("effective_date", "force", "pattern", r"(?i)\bcome[s]? into force on(?: the)? (\d{1,2}(?:st|nd|rd|th)? [a-z]+,? \d{4}|\d{4}-\d{2}-\d{2})", 0.9, None, "into force on"),
]


@register("document_metadata", None, "documents")
def document_metadata(docs: DataFrame) -> DataFrame:
    """Thirteen fields of every document; every third one has a stated notice behind its text."""
    notice = F.concat(F.lit("\nThe Food Safety and Standards Act, 2006. Notification No. F-"), F.col("doc_id"), F.lit(" dated the 5th August, 2020 of the Ministry of Health, Government of Kerala; as amended by the 3rd amendment it shall come into force on 2021-01-01."))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, notice).otherwise(""))
    return P.metadata(docs.select("doc_id", text.alias("text")), "doc_id", "text", FIELD_RULES, _FIELDS)


_PHRASES = "SELECT item_id AS id, array_to_string(regexp_extract_all(lower(text), '[a-z]+')[2:4], ' ') AS phrase FROM benchmark"


@register("phrase_occurrences", f"""SELECT doc_id, id, strpos(lower(text), phrase) - 1 AS first, (length(text) - length(replace(lower(text), phrase, ''))) // length(phrase) AS n FROM documents, ({_PHRASES}) WHERE phrase <> '' AND contains(lower(text), phrase)""", "documents", "benchmark")
def phrase_occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words 2 to 4 of every passage in all texts, by one walk along each."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 2, 3)
    phrases = benchmark.select(F.col("item_id").alias("id"), F.array_join(words, " ").alias("phrase"))
    return P.occurrences(docs, "doc_id", "text", phrases, whole_words=False).drop("around")
