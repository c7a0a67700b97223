"""Extraction, hierarchy, segmentation and query understanding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import extract as X
from lexmill.operators import segment as S
from lexmill.plans._registering import register
from lexmill.sources.tables import spread


def cited(part: DataFrame):
    """Parts as provisions: a section text such as 31(2)(a)."""
    return F.concat(F.col("p_size"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("("), F.col("p_partkey") % 4, F.lit(")"))).otherwise(""), F.when(F.col("p_partkey") % 3 > 1, "(a)").otherwise(""))


CITED = "(p_size || CASE WHEN p_partkey % 3 > 0 THEN '(' || (p_partkey % 4) || ')' ELSE '' END || CASE WHEN p_partkey % 3 > 1 THEN '(a)' ELSE '' END)"
CHAIN = r"list_prepend(regexp_extract(s, '^\s*(\d{1,4})', 1), regexp_extract_all(s, '\(([^()]*)\)', 1))"


@register("section_chain_depth", f"SELECT p_partkey, array_to_string({CHAIN}, '/') AS chain, CASE len({CHAIN}) WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 5 END::INTEGER AS depth FROM (SELECT p_partkey, {CITED} AS s FROM part)", "part")
def chain_depth(part: DataFrame) -> DataFrame:
    chain = X.section_chain(cited(part))
    return part.select("p_partkey", F.array_join(chain, "/").alias("chain"), X.chain_depth(chain).alias("depth"))


@register("section_relations", f"""WITH c AS (SELECT p_partkey, {CHAIN} AS c FROM (SELECT p_partkey, {CITED} AS s FROM part)), p AS (SELECT a.p_partkey AS a, a.c AS x, b.c AS y FROM c a JOIN c b ON b.p_partkey = a.p_partkey + 1),
r AS (SELECT a, CASE WHEN x = y THEN 'exact' WHEN x[1] <> y[1] THEN CASE WHEN abs(x[1]::INT - y[1]::INT) = 1 THEN 'adjacent' ELSE 'none' END
 WHEN len(x) < len(y) AND y[1:len(x)] = x THEN 'parent' WHEN len(x) > len(y) AND x[1:len(y)] = y THEN 'child' WHEN len(x) = len(y) AND x[1:len(x) - 1] = y[1:len(x) - 1] THEN 'sibling' ELSE 'same_family' END AS relation FROM p)
SELECT a, relation, CASE relation WHEN 'exact' THEN 1.0 WHEN 'parent' THEN 0.75 WHEN 'child' THEN 0.75 WHEN 'sibling' THEN 0.5 WHEN 'same_family' THEN 0.5 WHEN 'adjacent' THEN 0.25 ELSE 0.0 END::DOUBLE AS score FROM r""", "part")
def relations(part: DataFrame) -> DataFrame:
    c = part.select("p_partkey", X.section_chain(cited(part)).alias("c"))
    pairs = c.select(F.col("p_partkey").alias("a"), F.col("c").alias("x")).join(c.select((F.col("p_partkey") - 1).alias("a"), F.col("c").alias("y")), "a")
    return pairs.withColumn("relation", X.chain_relation(F.col("x"), F.col("y"))).select("a", "relation", X.relation_score(F.col("relation")).alias("score"))


PROSE = "('Under section ' || p_size || '(1) and Section ' || (p_size + 1) || ' read with rule ' || (p_size % 9) || ' of schedule IV, chapter 2.')"


def prose(part: DataFrame) -> DataFrame:
    """A few megabytes of keys become dear texts, so they are dealt out to all cores."""
    n = F.col("p_size")
    return spread(part.select("p_partkey", "p_size")).select("p_partkey", F.concat(F.lit("Under section "), n, F.lit("(1) and Section "), n + 1, F.lit(" read with rule "), n % 9, F.lit(" of schedule IV, chapter 2.")).alias("t"))


#: Documents name no sections, dates or sources, so each is read with stated ones behind its text.
_NAMED = "coalesce(text, '') || ' Under section ' || (doc_id % 90) || '(1) and Sections ' || (doc_id % 7 + 1) || '(2)(b) as of ' || CASE doc_id % 3 WHEN 0 THEN '2021-03-' || (10 + doc_id % 19) WHEN 1 THEN (1 + doc_id % 28) || '/7/1999' ELSE '3 May 2010 and 3 May 2010' END || ', as [' || (doc_id % 50) || '] and [Source ' || (doc_id % 5) || '] and [' || (doc_id % 50) || '] say.'"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@register("section_refs", rf"WITH d AS (SELECT doc_id, regexp_extract_all({_NAMED}, '(?i)\bsections?\s+(\d{{1,4}}(?:\([0-9a-z]+\))*)', 1) AS s FROM documents) SELECT doc_id, list_sort(list_distinct(s)) AS sections, len(s)::INTEGER AS n FROM d", "documents")
def section_refs(docs: DataFrame) -> DataFrame:
    found = X.sections_in(F.expr(_NAMED))
    return docs.select("doc_id", F.array_sort(F.array_distinct(found)).alias("sections"), F.size(found).alias("n"))


@register("reference_spans", f"""SELECT p_partkey, kind, confidence, raw, strpos(t, raw)::INTEGER - 1 AS start, (strpos(t, raw) - 1 + length(raw))::INTEGER AS "end" FROM (SELECT p_partkey, t, unnest(['section', 'section', 'rule', 'schedule', 'chapter', 'relation']) AS kind, unnest(['HIGH', 'HIGH', 'HIGH', 'MEDIUM', 'MEDIUM', 'LOW']) AS confidence,
unnest(['section ' || p_size || '(1)', 'Section ' || (p_size + 1), 'rule ' || (p_size % 9), 'schedule IV', 'chapter 2', 'read with']) AS raw FROM (SELECT p_partkey, p_size, {PROSE} AS t FROM part))""", "part")
def reference_spans(part: DataFrame) -> DataFrame:
    return prose(part).select("p_partkey", F.explode(X.references_in(F.col("t"))).alias("r")).select("p_partkey", "r.kind", "r.confidence", "r.raw", "r.start", "r.end")


RULES = [("prohibition", r"(?i)\b(shall not|prohibited|worthless)\b"), ("duty", r"(?i)\b(shall|must|andthe)\b"), ("definition", r"(?i)\bmeans\b"), ("list", r"(?m)^\s*[-*\d]")]


@register("first_rule_class", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in RULES) + " ELSE 'general' END AS class FROM documents", "documents")
def first_rule(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.first_rule(F.col("text"), RULES, "general").alias("class"))


LABELS = [("a", ["tion", "ing"]), ("b", ["ment", "que"]), ("c", ["ung", "keit", "lich"])]


@register("most_patterns_class", "SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'ambiguous' WHEN a = greatest(a, b, c) THEN 'a' WHEN b = greatest(a, b, c) THEN 'b' ELSE 'c' END AS class FROM (SELECT doc_id, " + ", ".join(" + ".join(f"regexp_matches(text, '{p}')::INT" for p in ps) + f" AS {n}" for n, ps in LABELS) + " FROM documents)", "documents")
def most_patterns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.most_matches(F.col("text"), LABELS, "ambiguous").alias("class"))


@register("keyword_domain_votes", "SELECT doc_id, CASE WHEN m >= 1 + 0.5 * contains(lower(text), 'the')::INT AND m > 1 + 0.5 * contains(lower(text), 'the')::INT THEN 'other' ELSE 'main' END AS best FROM (SELECT doc_id, text, 0.5 * (contains(lower(text), 'und')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'die')::INT) AS m FROM documents)", "documents")
def domain_votes(docs: DataFrame) -> DataFrame:
    votes = X.keyword_votes(F.col("text"), {"main": ["the"], "other": ["und", "der", "die"]}, "main")
    return docs.select("doc_id", F.get(votes, 0)["name"].alias("best"))


@register("numeric_cores", r"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?', 0), lambda x: regexp_replace(replace(x, ',', ''), '\.0+$', '')))) AS cores, len(list_distinct(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?', 0), lambda x: regexp_replace(replace(x, ',', ''), '\.0+$', ''))))::INTEGER AS n FROM documents", "documents")
def numeric_cores(docs: DataFrame) -> DataFrame:
    v = X.numerics(F.col("text"))
    return docs.select("doc_id", F.array_sort(v).alias("cores"), F.size(v).alias("n"))


@register("claim_counts", None, "conversations")
def claim_counts(conv: DataFrame) -> DataFrame:
    return conv.select("conv_id", "turn", F.size(X.claims(F.col("text"))).alias("n"), X.abstains(F.col("text")).alias("abstains"), X.keywords(F.col("text")).alias("keywords"))


@register("claim_support", None, "conversations")
def claim_support(conv: DataFrame) -> DataFrame:
    claim = conv.select("conv_id", "turn", F.posexplode(X.claims(F.col("text"))).alias("i", "claim"))
    evidence = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    return claim.join(evidence, ["conv_id", "turn"]).select("conv_id", "turn", "i", X.supports(F.col("claim"), F.col("evidence")).alias("supported"))


@register("citation_numbers", rf"WITH d AS (SELECT doc_id, list_transform(regexp_extract_all({_NAMED}, '\[(?:Source )?(\d+)\]', 1), lambda x: x::INTEGER) AS c FROM documents) SELECT doc_id, {_FIRST.format('c')} AS cited FROM d", "documents")
def citation_numbers(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.citations(F.expr(_NAMED)).alias("cited"))


_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}"


@register("date_candidates", f"WITH d AS (SELECT doc_id, regexp_extract_all({_NAMED}, '{_DATE}', 0) AS f FROM documents) SELECT doc_id, {_FIRST.format('f')}[1:10] AS found FROM d", "documents")
def date_candidates(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.date_candidates(F.expr(_NAMED)).alias("found"))


_SCRIPTS = "CASE doc_id % 4 WHEN 0 THEN repeat('खाद्य सुरक्षा ', (length(text) // 8 + 3)::INT) WHEN 1 THEN repeat('খাদ্য ', (length(text) // 5 + 3)::INT) WHEN 2 THEN 'খাদ্য खाद्य ' ELSE '' END || coalesce(text, '')"


@register("script_language", rf"""WITH d AS (SELECT doc_id, {_SCRIPTS} AS t FROM documents), c AS (SELECT doc_id, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(t, '[^\x{{0900}}-\x{{097F}}]', '', 'g')) AS h, length(regexp_replace(t, '[^\x{{0980}}-\x{{09FF}}]', '', 'g')) AS b FROM d)
SELECT doc_id, CASE WHEN l + h + b = 0 OR 2 * l > l + h + b THEN 'English' WHEN h >= b THEN 'Hindi' ELSE 'Bengali' END AS language, CASE WHEN l + h + b = 0 THEN 0.5 ELSE round(least(0.95, greatest(l, h, b) / (l + h + b)), 6) END::DOUBLE AS confidence FROM c""", "documents")
def script_language(docs: DataFrame) -> DataFrame:
    """Half of the texts have as much or more of another script before them."""
    text = F.expr(_SCRIPTS.replace("::INT", "").replace("length(text) // 8 + 3", "int(length(text) div 8 + 3)").replace("length(text) // 5 + 3", "int(length(text) div 5 + 3)"))
    return docs.select("doc_id", X.script_of(text).alias("s")).select("doc_id", "s.language", "s.confidence")


@register("chunk_quality", r"""SELECT doc_id, q, CASE WHEN q >= 0.85 THEN 'A' WHEN q >= 0.7 THEN 'B' WHEN q >= 0.5 THEN 'C' WHEN q >= 0.3 THEN 'D' ELSE 'F' END AS grade FROM (SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE - 0.3::DOUBLE * (length(text) < 50)::INT - 0.1::DOUBLE * (length(text) > 4000)::INT - 0.1::DOUBLE * (NOT regexp_matches(text, '[.!?;:]\s*$'))::INT + 0.2::DOUBLE * regexp_matches(text, '(?i)\bsection\s+\d')::INT)), 6) AS q FROM documents)""", "documents")
def chunk_quality(docs: DataFrame) -> DataFrame:
    q = docs.select("doc_id", X.chunk_quality(F.col("text")).alias("q"))
    return q.withColumn("grade", X.grade(F.col("q")))


@register("method_scores", "SELECT p_partkey, round(least(1.0::DOUBLE, 0.8::DOUBLE + CASE WHEN p_size % 4 >= 3 THEN 0.10 WHEN p_size % 4 = 2 THEN 0.05 ELSE 0.0 END::DOUBLE + CASE WHEN p_retailprice > 1000 THEN 0.02 ELSE 0.0 END::DOUBLE), 6) AS score FROM part", "part")
def method_scores(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", X.method_score(F.lit(0.8), F.col("p_size") % 4, F.col("p_retailprice")).alias("score"))


@register("canonical_types", "SELECT DISTINCT o_orderpriority, CASE lower(trim(split_part(o_orderpriority, '-', 1))) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' END AS kind FROM orders", "orders")
def canonical_types(orders: DataFrame) -> DataFrame:
    kind = X.canonical(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), {"1": "urgent", "2": "high"})
    return orders.select("o_orderpriority", kind.alias("kind")).distinct()


@register("identifier_queries", f"SELECT p_partkey, 'Food Act' AS act, p_size || '(1)' AS section, 'act_section' AS form, 'Food Act section ' || p_size || '(1)' AS query FROM part", "part")
def identifier_queries(part: DataFrame) -> DataFrame:
    found = prose(part).select("p_partkey", X.identifier_query(F.concat(F.col("t"), F.lit(" Under the food act.")), {"Food Act": ["fa 2006"]}).alias("i"))
    return found.select("p_partkey", "i.act", "i.section", "i.form", "i.query")


@register("subqueries", "SELECT p_partkey, ['Section ' || p_size || '(1) provisions', 'Section ' || (p_size + 1) || ' provisions'] AS parts FROM part", "part")
def subqueries(part: DataFrame) -> DataFrame:
    return prose(part).select("p_partkey", X.subqueries(F.col("t")).alias("parts"))


_SIGNS = [r"\band\b", r"\b(compare|versus|difference)\b", r"\b(before|after|since|until)\b", r"\b(except|unless|exempt)", r"\b(not|never|without)\b"]
_ASKED = "coalesce(substr(text, 1, 60), '') || CASE doc_id % 5 WHEN 0 THEN ' Under section 3 AND Section 4 unless it is not so' WHEN 1 THEN ' compare section 9 before' WHEN 2 THEN ' without difference' ELSE '' END"


@register("query_difficulty", rf"WITH d AS (SELECT doc_id, {_ASKED} AS t FROM documents) SELECT doc_id, (len(regexp_split_to_array(t, '\s+')) > 12)::INT + (len(regexp_extract_all(t, '(?i)\bsections?\s+(\d{{1,4}}(?:\([0-9a-z]+\))*)', 1)) > 1)::INT + " + " + ".join(f"regexp_matches(lower(t), '{p}')::INT" for p in _SIGNS) + " AS score FROM d", "documents")
def query_difficulty(docs: DataFrame) -> DataFrame:
    """The opening words of each document as a question, three in five with stated ones behind."""
    return docs.select("doc_id", X.difficulty(F.expr(_ASKED)).alias("score"))


@register("document_chunks", "SELECT doc_id, c::INTEGER AS chunk, (c * 900)::INTEGER AS start, md5(substr(text, c * 900 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(0, floor((length(text) - 101) / 900))::BIGINT + 1)) AS c FROM documents)", "documents")
def document_chunks(docs: DataFrame) -> DataFrame:
    return S.chunks(docs, "doc_id", F.col("text"), 1000, 100).select("doc_id", "chunk", "start", F.md5("text").alias("digest"))


@register("paragraph_parts", None, "documents")
def paragraph_parts(docs: DataFrame) -> DataFrame:
    parts = S.paragraphs(S.numbered_lines(docs, "doc_id", F.col("text")), "doc_id")
    return S.with_parents(parts, "doc_id").withColumn("text", F.md5("text"))


@register("hierarchy_report", None, "documents")
def hierarchy_report(docs: DataFrame) -> DataFrame:
    return S.paragraphs(S.numbered_lines(docs, "doc_id", F.col("text")), "doc_id").groupBy("level", "kind").agg(F.count("*").alias("n"))


@register("role_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey)::INTEGER AS pos FROM orders", "orders")
def role_order(orders: DataFrame) -> DataFrame:
    """Selected first, then by role, then by score."""
    from pyspark.sql import Window

    role = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderstatus") == "F"), role, F.desc("o_totalprice"), "o_orderkey")
    return orders.select("o_orderkey", F.row_number().over(w).alias("pos"))
