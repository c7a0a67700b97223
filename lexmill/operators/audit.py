"""Audit of chunks in increments: counters, and sketches of lengths and of different ids, that add up to those of the whole.

An increment's row holds sums, quantile sketches (KLL) of the lengths and distinct sketches (HyperLogLog) of ids, documents and contents; all come
from one pass. Rows of any number of increments merge into one, so yesterday's chunks are not read again. Ranks of quantiles are within
``RANK_ERROR`` and distinct counts within ``COUNT_ERROR`` (three standard errors) of those of one pass; counters are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORT, LONG = 100, 3000
#: Sketch sizes, and the errors that follow from them.
KLL_K, HLL_K = 200, 12
RANK_ERROR, COUNT_ERROR = 0.0265, 0.05
EXEMPLARS = 5
# How a complete sentence ends, what names a provision.
SENTENCE_END = r"""[.!?)"'»]|[:;]\s*$"""
HEADING_END = r"[—\-–:]\s*$"
NUMBER_END = r"\d(?:%|°|g|kg|ml|l|ppm|ppb)?$|\d{1,3}[,.]\d{1,3}$|\d\s+(?:g|kg|ml|l|ppm|ppb)$"
PROVISION = r"(?i)\b(?:section|sec\.?|regulation|rule|clause|sch(?:edule)?\.?)\s+[A-Z]?\d{1,4}(?:[a-z]|[A-Z])?\b"


def _flags(text: Column, missing: dict[str, Column]) -> dict[str, Column]:
    bare = F.rtrim(F.regexp_replace(text, r"\s+$", ""))
    complete = F.right(bare, F.lit(6)).rlike(SENTENCE_END) | bare.rlike(HEADING_END) | bare.rlike(NUMBER_END)
    blank = ~text.rlike(r"\S")
    return {
        "empty_chunks": blank, "unusually_short_chunks": ~blank & (F.length(text) < SHORT), "unusually_long_chunks": F.length(text) > LONG,
        "incomplete_sentence_chunks": ~blank & ~complete, "multi_provision_chunks": F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(PROVISION), F.lit(0)))) >= 2,
    } | {f"missing_{name}": c.isNull() for name, c in missing.items()}


def increments(chunks: DataFrame, by: Column, chunk_id: str, document_id: str, text: str, missing: dict[str, Column]) -> DataFrame:
    """One row for every increment: exact counters and sketches. Null texts are empty; missing names columns whose nulls are counted."""
    own = F.coalesce(F.col(text), F.lit(""))
    flags = _flags(own, missing)
    rows = chunks.select(
        by.alias("increment"), F.col(chunk_id).cast("string").alias("_id"), F.col(document_id).cast("string").alias("_document"), F.length(own).cast("long").alias("_chars"),
        F.greatest(F.lit(1), F.size(F.filter(F.split(own, r"\s+"), lambda w: w != ""))).cast("long").alias("_words"), F.lower(F.trim(F.regexp_replace(own, r"\s+", " "))).alias("_content"), *[c.alias(n) for n, c in flags.items()],
    )
    return rows.groupBy("increment").agg(
        F.count("*").alias("total_chunks"), *[F.count_if(n).alias(n) for n in flags], F.sum("_chars").alias("chars"), F.min("_chars").alias("least_chars"), F.max("_chars").alias("most_chars"),
        F.kll_sketch_agg_bigint("_chars", KLL_K).alias("char_lengths"), F.kll_sketch_agg_bigint("_words", KLL_K).alias("word_lengths"),
        F.hll_sketch_agg("_id", HLL_K).alias("ids"), F.hll_sketch_agg("_document", HLL_K).alias("documents"), F.hll_sketch_agg(F.xxhash64("_content"), HLL_K).alias("contents"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """One row of the same kind for all increments."""
    counters = [c for c in rows.columns if c not in ("increment", "least_chars", "most_chars", "char_lengths", "word_lengths", "ids", "documents", "contents")]
    return rows.agg(
        *[F.sum(c).alias(c) for c in counters], F.min("least_chars").alias("least_chars"), F.max("most_chars").alias("most_chars"),
        *[F.kll_merge_agg_bigint(c).alias(c) for c in ("char_lengths", "word_lengths")], *[F.hll_union_agg(c).alias(c) for c in ("ids", "documents", "contents")],
    )


def report(row: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The readable form of a merged row: counters, mean length, length quantiles and estimated counts of different ids, documents and contents."""
    sketches = ("char_lengths", "word_lengths", "ids", "documents", "contents", "chars")
    marks = [F.kll_sketch_get_quantile_bigint(s, F.lit(q)).alias(f"{s.split('_')[0]}_p{round(100 * q)}") for s in ("char_lengths", "word_lengths") for q in quantiles]
    return row.select(*[c for c in row.columns if c not in sketches], F.round(F.col("chars") / F.col("total_chunks"), 1).alias("mean_chars"), *marks, *[F.hll_sketch_estimate(s).alias(f"different_{s}") for s in ("ids", "documents", "contents")])


def exemplars(chunks: DataFrame, chunk_id: str, text: str, missing: dict[str, Column], most: int = EXEMPLARS) -> DataFrame:
    """(metric, rank, chunk_id, snippet): the first chunks, by id, that each flag holds for. Each task passes on no more than ``most`` of a metric."""
    own = F.coalesce(F.col(text), F.lit(""))
    flags = _flags(own, missing)
    named = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))).alias("metric")
    hits = chunks.select(F.col(chunk_id).alias("chunk_id"), F.substring(own, 1, 140).alias("snippet"), named)
    rank = F.row_number().over(Window.partitionBy("metric").orderBy("chunk_id", "snippet"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select("metric", "rank", "chunk_id", "snippet")


def severity(metric: Column) -> Column:
    """How grave a metric is."""
    return F.when(metric.isin("empty_chunks", "duplicate_chunk_ids"), "CRITICAL").when(metric.startswith("missing_") & (metric != "missing_content_hash"), "HIGH").when(metric.isin("missing_content_hash", "duplicate_content", "unusually_short_chunks"), "MEDIUM").otherwise("LOW")
