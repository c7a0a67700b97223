"""Segmentation of documents into paragraphs, sections and chunks, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (kind, level, pattern) of a line that opens a part, in order.
OPENERS = (
    ("chapter", 1, r"(?i)^chapter\s+([ivxlc]+|\d+)"),
    ("section", 2, r"(?i)^(?:section\s+)?(\d{1,4})\.\s"),
    ("subsection", 3, r"^\((\d{1,3})\)\s"),
    ("clause", 4, r"^\(([a-z]{1,2})\)\s"),
)


def numbered_lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, line) of the lines that are not blank."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def classified_lines(lines: DataFrame) -> DataFrame:
    """Adds kind, level and number of the part that a line opens; body lines have none."""
    line = F.col("line")
    kind = F.coalesce(*[F.when(line.rlike(p), F.lit(k)) for k, _, p in OPENERS])
    level = F.coalesce(*[F.when(line.rlike(p), F.lit(n)) for _, n, p in OPENERS])
    number = F.coalesce(*[F.when(line.rlike(p), F.regexp_extract(line, p, 1)) for _, _, p in OPENERS])
    return lines.withColumn("kind", kind).withColumn("level", level).withColumn("number", number)


def paragraphs(lines: DataFrame, key: str) -> DataFrame:
    """(key, part, pos, kind, level, number, text): a part runs from its opening line to the next."""
    w = Window.partitionBy(key).orderBy("pos")
    marked = classified_lines(lines).withColumn("part", F.sum(F.col("kind").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    first = lambda c: F.min_by(c, "pos").alias(c)
    return marked.groupBy(key, "part").agg(F.min("pos").alias("pos"), first("kind"), first("level"), first("number"), text.alias("text"))


def with_parents(parts: DataFrame, key: str) -> DataFrame:
    """Adds parent: the last part before of a lower level."""
    w = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("level") > n, F.last(F.when(F.col("level") == n, F.col("part")), ignorenulls=True).over(w)) for n in (3, 2, 1)]
    return parts.withColumn("parent", F.greatest(*above, F.lit(None).cast("bigint")))


def chunks(docs: DataFrame, key: str, text: Column, size: int, overlap: int) -> DataFrame:
    """(key, chunk, start, text) of overlapping windows of characters that cover a text."""
    step = size - overlap
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - overlap - 1) / step)).cast("int"))
    rows = docs.select(key, text.alias("_t"), F.explode(starts).alias("chunk"))
    return rows.select(key, "chunk", (F.col("chunk") * step).alias("start"), F.expr(f"substring(_t, chunk * {step} + 1, {size})").alias("text"))
