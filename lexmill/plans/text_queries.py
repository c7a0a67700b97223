"""Cleaning, normalising and auditing texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.plans._registering import register
from lexmill.sources.shared import saved

WHITE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WHITE_SQL}+', ' ', 'g'))"


def _per_document(name: str, column, sql: str) -> None:
    """A text function over all documents, by length and digest of its result."""

    def build(docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", column(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))

    register(name, f"SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM (SELECT doc_id, {sql} AS t FROM documents)", "documents")(build)


def _line_filter_sql(keep: str) -> str:
    return f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: {keep}), chr(10))"


_quote = lambda s: "'" + s.replace("'", "''") + "'"
_unicode = lambda s: s.replace("\\u", "\\x{").replace("\\xa0", "\\x{a0}")
PRESERVED_SQL = "(" + " OR ".join(f"regexp_matches(trim(x), {_quote(p)})" for p in T.PRESERVE) + ")"

_per_document("norm_whitespace", T.collapse_white, collapse_sql("text"))
_per_document("norm_spaces", T.collapse_spaces, r"regexp_replace(text, '[\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2,}', ' ', 'g')")
_per_document("norm_tabs", T.tabs_to_space, r"regexp_replace(text, '\t+', ' ', 'g')")
_per_document("norm_linebreaks", T.limit_newlines, r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")
_per_document("norm_hyphens", T.join_hyphens, r"regexp_replace(text, '([\p{L}\p{M}\p{Nd}_]{2,})-\s*\n\s*([\p{L}\p{M}\p{Nd}_]{2,})', '\1\2', 'g')")
_per_document("norm_quotes", T.straight_quotes, f"translate(text, {_quote(T.CURLY)}, {_quote(T.STRAIGHT)})")
_per_document("norm_bullets", T.plain_bullets, f"replace(translate(text, {_quote(T.BULLETS)}, {_quote(T.PLAIN_BULLETS)}), '…', '...')")
_per_document("norm_encoding", T.strip_artifacts, r"regexp_replace(replace(text, chr(160), ' '), '[\x{80}-\x{9f}\x{ad}\x{200b}-\x{200f}\x{2028}-\x{202f}\x{2060}-\x{2063}]', '', 'g')")
_per_document("norm_line_ends", T.strip_line_ends, r"regexp_replace(text, '(?m)[ \t]+$', '', 'g')")
_per_document("strip_ocr_noise", T.strip_ocr_noise, r"regexp_replace(text, '[^\x20-\x7e\n\x{2013}\x{2014}\x{0900}-\x{097f}\x{0980}-\x{09ff}\x{0a00}-\x{0a7f}\x{0b00}-\x{0b7f}\x{0b80}-\x{0bff}\x{0c00}-\x{0c7f}\x{0c80}-\x{0cff}\x{0d00}-\x{0d7f}\x{2010}-\x{2030}\x{2032}-\x{2034}\x{a1}-\x{bf}]', '', 'g')")
_per_document("strip_page_numbers", T.drop_page_numbers, _line_filter_sql(f"NOT regexp_matches(x, {_quote(T.PAGE_NUMBER)}) OR {PRESERVED_SQL}"))
_per_document("strip_watermarks", T.drop_watermarks, _line_filter_sql(f"NOT regexp_matches(x, {_quote(T.WATERMARK)}) OR {PRESERVED_SQL}"))
_per_document("strip_blank_lines", T.drop_blank_lines, _line_filter_sql("trim(x) <> ''"))
_per_document("query_form", T.query_form, r"trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}_]+', ' ', 'g'))")
_per_document("address_form", T.address_form, r"trim(regexp_replace(upper(replace(text, 'ß', 'SS')), '[\x00-\x1f\x7f.\s]+', ' ', 'g'))")
_per_document("act_form", T.act_form, r"trim(regexp_replace(regexp_replace(lower(trim(text)), '^the\s+', ''), '[^a-z0-9]+', ' ', 'g'))")
_per_document("escape_formula", T.escape_formula, r"CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END")
_per_document("drop_repeated_lines", T.drop_repeated_lines, f"""(SELECT string_agg(x, chr(10) ORDER BY i) FROM (
  SELECT i, l[i] AS x, trim(l[i]) AS s, trim(l[i - 1]) AS b FROM (SELECT string_split(text, chr(10)) AS l), unnest(range(1, len(string_split(text, chr(10))) + 1)) r(i)) z WHERE i = 1 OR s = '' OR s <> b OR {PRESERVED_SQL})""")
_per_document("drop_running_titles", T.drop_running_titles, f"""(SELECT array_to_string(list_filter(l, lambda x: NOT list_contains(o, trim(x)) OR {PRESERVED_SQL}), chr(10)) FROM (
  SELECT l, list_filter(list_distinct(t), lambda y: len(list_filter(t, lambda z: z = y)) > 1) AS o FROM (
    SELECT l, list_filter(list_transform(l, lambda x: trim(x)), lambda x: regexp_matches(x, {_quote(T.RUNNING_TITLE)})) AS t FROM (SELECT string_split(text, chr(10)) AS l))))""")


@register("clean_report", rf"""SELECT doc_id, length(text)::BIGINT AS before, length(c)::BIGINT AS after, CASE WHEN length(c) = 0 THEN 1.0 ELSE round(length(text) / length(c), 4) END AS ratio
FROM (SELECT doc_id, text, {collapse_sql("text")} AS c FROM documents)""", "documents")
def clean_report(docs: DataFrame) -> DataFrame:
    c = docs.withColumn("c", T.collapse_white(F.col("text")))
    return c.select("doc_id", F.length("text").cast("long").alias("before"), F.length("c").cast("long").alias("after"), T.size_ratio(F.col("text"), F.col("c")).alias("ratio"))


@register("clean_totals", f"""SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, round(avg(length({collapse_sql("text")})), 6) AS mean_after FROM documents GROUP BY source""", "documents")
def clean_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"), F.round(F.avg(F.length(T.collapse_white(F.col("text")))), 6).alias("mean_after"))


@register("content_hashes", f"SELECT doc_id, sha256({collapse_sql('text')}) AS exact, sha256(lower({collapse_sql('text')})) AS folded FROM documents", "documents")
def content_hashes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.content_hash(F.col("text")).alias("exact"), T.folded_hash(F.col("text")).alias("folded"))


@register("exact_dup_groups", f"SELECT sha256({collapse_sql('text')}) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1", "documents")
def exact_dup_groups(docs: DataFrame) -> DataFrame:
    return docs.groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@register("new_vs_seen_hash", f"""WITH h AS (SELECT doc_id, sha256({collapse_sql('text')}) AS hash FROM documents)
SELECT doc_id, hash IN (SELECT hash FROM h WHERE doc_id % 3 = 0) AS seen FROM h WHERE doc_id % 3 <> 0""", "documents")
def new_vs_seen(docs: DataFrame) -> DataFrame:
    """A batch against what earlier batches left; equal rows inside the batch are all new."""
    hashed = docs.select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    store = hashed.where("doc_id % 3 = 0").select("hash").distinct().withColumn("seen", F.lit(True))
    return hashed.where("doc_id % 3 <> 0").join(store, "hash", "left").select("doc_id", F.coalesce("seen", F.lit(False)).alias("seen"))


@register("duplicate_documents", f"""WITH h AS (SELECT doc_id, sha256({collapse_sql('text')}) AS hash FROM documents)
SELECT doc_id FROM h a WHERE EXISTS (SELECT 1 FROM h b WHERE a.hash = b.hash AND b.doc_id < a.doc_id)""", "documents")
def duplicate_documents(docs: DataFrame) -> DataFrame:
    """Texts are read and hashed once; their hashes are kept for both uses."""
    hashed = saved(docs.select("doc_id", T.content_hash(F.col("text")).alias("hash")))
    first = hashed.groupBy("hash").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, "hash").where("doc_id > first_id").select("doc_id")


@register("quality_audit_counts", f"""SELECT count(*) AS total, count(*) FILTER (length(trim(text)) < 50) AS short, count(*) FILTER (regexp_matches(text, '[0-9]')) AS with_digits,
count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7f]')) AS non_ascii, count(DISTINCT sha256({collapse_sql('text')})) AS distinct_texts,
count(*) FILTER (n_chars <> length(text)) AS wrong_length, count(*) FILTER (lang IS NULL) AS no_lang, round(100.0 * count(*) FILTER (length(trim(text)) < 50) / count(*), 2) AS short_pct FROM documents""", "documents")
def quality_audit(docs: DataFrame) -> DataFrame:
    short = F.length(F.trim("text")) < 50
    return docs.agg(
        F.count("*").alias("total"), F.count_if(short).alias("short"), F.count_if(F.col("text").rlike("[0-9]")).alias("with_digits"), F.count_if(F.col("text").rlike(r"[^\x00-\x7f]")).alias("non_ascii"),
        F.count_distinct(T.content_hash(F.col("text"))).alias("distinct_texts"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_length"), F.count_if(F.col("lang").isNull()).alias("no_lang"),
        F.round(100.0 * F.count_if(short) / F.count("*"), 2).alias("short_pct"),
    )


def nearest_rank(rows: DataFrame, value: str, by: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """Lower nearest-rank percentiles, sorted[int((n - 1) * q)], by a window instead of a collected list."""
    w = Window.partitionBy(*by)
    ranked = rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * q), F.col(value))).alias(f"p{int(q * 100)}") for q in quantiles])


@register("length_percentiles", "SELECT lang, list_sort(list(n_chars))[1 + floor((count(*) - 1) * 0.5)::INT] AS p50, list_sort(list(n_chars))[1 + floor((count(*) - 1) * 0.9)::INT] AS p90, list_sort(list(n_chars))[1 + floor((count(*) - 1) * 0.99)::INT] AS p99 FROM documents GROUP BY lang", "documents")
def length_percentiles(docs: DataFrame) -> DataFrame:
    return nearest_rank(docs, "n_chars", ["lang"], (0.5, 0.9, 0.99))


@register("line_frequency", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT trim(line) AS line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""", "documents")
def line_frequency(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    return found.groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("docs > 1")


@register("html_headings", r"""SELECT page_id, i - 1 AS pos, regexp_extract(h, '(?i)^<h([1-6])', 1)::INTEGER AS level, trim(regexp_replace(h, '(?s)<[^>]*>', '', 'g')) AS title
FROM (SELECT page_id, unnest(h) AS h, unnest(range(1, len(h) + 1))::INTEGER AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>', 0) AS h FROM pages))""", "pages")
def html_headings(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(T.headings(F.col("html"))).alias("pos", "h")).select("page_id", "pos", "h.level", "h.title")


@register("html_text", None, "pages")
def html_text(pages: DataFrame) -> DataFrame:
    t = T.html_to_text(F.col("html"))
    return pages.select("page_id", F.length(t).alias("n"), t.alias("text"))


@register("header_footer_lines", """WITH l AS (SELECT doc_id, len(a) AS n, i - 1 AS i, trim(a[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(range(1, len(a) + 1)) r(i)),
b AS (SELECT doc_id, greatest(1, n // 40) AS width, n, i // greatest(1, n // 40) AS bucket, line FROM l WHERE n >= 20 AND length(line) BETWEEN 3 AND 80)
SELECT doc_id, bucket, line, count(*) AS n FROM b GROUP BY doc_id, bucket, line, n, width HAVING count(*) >= greatest(3, b.n // (width * 4))""", "documents")
def header_footer_lines(docs: DataFrame) -> DataFrame:
    """Lines that repeat inside one positional bucket of a document (as the bucket rule is stated, it needs 400 lines)."""
    own = docs.select("doc_id", T.lines(F.col("text")).alias("a")).select("doc_id", F.size("a").alias("n"), F.posexplode("a").alias("i", "line")).withColumn("line", F.trim("line"))
    width = F.greatest(F.lit(1), F.expr("n div 40"))
    b = own.where((F.col("n") >= 20) & F.length("line").between(3, 80)).withColumn("width", width).withColumn("bucket", F.expr("i div greatest(1, n div 40)"))
    return b.groupBy("doc_id", "bucket", "line", F.col("n").alias("lines"), "width").agg(F.count("*").alias("n")).where(F.expr("n >= greatest(3, lines div (width * 4))")).select("doc_id", "bucket", "line", "n")
