"""Ingestion of documents as chunks, once each, and what deterministic evaluation of retrieved chunks needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import lexical as L

CHUNK_CHARS, LEAST_CHARS = 800, 80


def cleaned(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " "))


def new_documents(docs: DataFrame, key: str, text: str, seen: DataFrame | None = None) -> DataFrame:
    """(document, clean, doc_hash): the first document of each cleaned text that is not empty and not among the seen hashes."""
    own = docs.select(F.col(key).alias("document"), cleaned(F.col(text)).alias("clean")).where("clean <> ''").withColumn("doc_hash", F.md5("clean"))
    if seen is not None:
        own = own.join(seen.select("doc_hash"), "doc_hash", "left_anti")
    first = own.groupBy("doc_hash").agg(F.min("document").alias("document"))
    return own.join(first, ["doc_hash", "document"], "left_semi").dropDuplicates(["doc_hash"]).select("document", "clean", "doc_hash")


def chunks(clean: DataFrame, size: int = CHUNK_CHARS, least: int = LEAST_CHARS) -> DataFrame:
    """(document, doc_hash, place, chunk, chunk_hash): pieces of so many characters; those that are too short, or have no letter, are no good."""
    places = F.sequence(F.lit(0), F.floor((F.length("clean") - 1) / size).cast("int"))
    cut = clean.select("document", "doc_hash", F.explode(places).alias("place"), "clean").withColumn("chunk", F.substring("clean", F.col("place") * size + 1, F.lit(size)))
    good = cut.where((F.length("chunk") >= least) & F.col("chunk").rlike("[A-Za-z]"))
    return good.select("document", "doc_hash", "place", "chunk", F.md5("chunk").alias("chunk_hash"))


def ingest(docs: DataFrame, key: str, text: str, records: DataFrame | None = None, size: int = CHUNK_CHARS, least: int = LEAST_CHARS) -> DataFrame:
    """New records (document, doc_hash, place, chunk_hash, n_chars, chunk) of a batch; records are those of earlier batches.

    A repeated text, or a text among the records, is ingested no more; of equal chunks the first by document and place stays,
    unless the records have it. A batch that is run again after its records were written gives nothing, so a restart is safe.
    Null and empty texts give nothing.
    """
    found = chunks(new_documents(docs, key, text, records), size, least)
    if records is not None:
        found = found.join(records.select("chunk_hash"), "chunk_hash", "left_anti")
    first = found.groupBy("chunk_hash").agg(F.min(F.struct("document", "place")).alias("at"))
    kept = found.join(first.select("chunk_hash", F.col("at.document").alias("document"), F.col("at.place").alias("place")), ["chunk_hash", "document", "place"], "left_semi")
    return kept.select("document", "doc_hash", "place", "chunk_hash", F.length("chunk").alias("n_chars"), "chunk")


def distinct_coverage(needles: Column, haystack: Column) -> Column:
    """Share of the distinct needles (an array) that are in the haystack; 0 without needles."""
    own = F.array_distinct(needles)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, haystack)) / F.size(own)).otherwise(0.0)


def asked(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, n_chars, q, t): each later turn of a conversation beside the tokens of its first."""
    tokens = turns.select("conv_id", "turn", "role", F.length("text").alias("n_chars"), L.content_tokens(F.col("text")).alias("t"))
    first = tokens.groupBy("conv_id").agg(F.min_by("t", "turn").alias("q"), F.min("turn").alias("_first"))
    return tokens.join(first, "conv_id").where(F.col("turn") > F.col("_first")).drop("_first")


def tagged(kind: str, value: Column) -> Column:
    """A typed cell as JSON that keeps its type; null stays null."""
    return F.when(value.isNotNull(), F.to_json(F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))))


def cache_key(*parts: Column, filters: Column) -> Column:
    """One key of the parts and a map of filters, whatever the order of its entries."""
    entries = F.transform(F.array_sort(F.map_entries(filters)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.array_join(entries, "&")))


def restrained_level(levels: DataFrame, key: str, level: str, anchor: Column, weight: Column) -> DataFrame:
    """(key, anchor, floor, level): of the rows that may be anchors the one of most weight; its level is the floor, and the
    least level at or above it is taken. Without an anchor all are null: no decision."""
    best = levels.groupBy(key).agg(F.max(F.when(anchor, F.struct(weight.alias("w"), F.col(level).alias("floor")))).alias("best"))
    known = levels.join(best, key).groupBy(key).agg(F.first("best.floor").alias("floor"), F.min(F.when(F.col(level) >= F.col("best.floor"), F.col(level))).alias("level"))
    return known.select(key, "floor", "level")
