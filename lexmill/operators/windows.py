"""Ordered computations inside groups. Every order ends in a tie-break that the caller names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, by: list[str], order: list[str], columns: list[str], flag: str | None = None) -> DataFrame:
    """Fills columns with the last value before; flag says whether the first column is the row's own."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"{c}_filled": F.last(c, ignorenulls=True).over(w) for c in columns})
    return out.withColumn(flag, F.col(columns[0]).isNotNull()) if flag else out


def group_flags(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn("first_of_group", F.row_number().over(w.orderBy(*order)) == 1).withColumn("group_size", F.count("*").over(w))


def changes_only(df: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the one before, and numbers them from 1 without gaps."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_was", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    kept = marked.where(F.col("_first") | ~value.eqNullSafe(F.col("_was"))).drop("_was", "_first")
    return kept.withColumn("version", F.row_number().over(w))


def inversions(df: DataFrame, by: list[str], step: list[str], at: str) -> DataFrame:
    """Dated steps that come before the dated step ahead of them."""
    w = Window.partitionBy(*by).orderBy(*step)
    return df.where(F.col(at).isNotNull()).withColumn("_was", F.lag(at).over(w)).where(F.col(at) < F.col("_was")).drop("_was")


def sequence_codes(df: DataFrame, prefix: str, at: str, order: list[str]) -> DataFrame:
    """PREFIX-YEAR-00001, without gaps inside a year."""
    number = F.row_number().over(Window.partitionBy(F.year(at)).orderBy(*order))
    return df.withColumn("code", F.concat_ws("-", F.lit(prefix), F.year(at), F.lpad(number.cast("string"), 5, "0")))


def letters(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A to Z in order; rows beyond the 26th have none."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("letter", F.when(n <= 26, F.char(F.lit(64) + n)))


def pack_budget(df: DataFrame, by: list[str], order: list[Column], text: str, budget: int, least: int) -> DataFrame:
    """Texts in order while they fit a budget of characters; the first that does not fit is cut if more than
    ``least`` characters are left for it, and nothing follows it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_upto", F.sum(F.length(text)).over(w)).withColumn("_left", budget - (F.col("_upto") - F.length(text)))
    over = F.col("_upto") > budget
    ranked = summed.withColumn("_over", F.sum(over.cast("int")).over(w))
    kept = ranked.where((F.col("_over") == 0) | ((F.col("_over") == 1) & over & (F.col("_left") > least)))
    return kept.withColumn(text, F.when(over, F.expr(f"substring(`{text}`, 1, _left)")).otherwise(F.col(text))).drop("_upto", "_left", "_over")


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def chained(df: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """(by, pos, order, curr_hash): SHA-256 of the hash before and the row's fields.

    A hash needs the one before, so the rows of a group pass one task in order; it holds nothing but the last hash. Groups run in parallel.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    rows = df.select(*by, *order, line.alias("_line")).repartition(*by).sortWithinPartitions(*by, *order, "_line")
    keys, names = len(by), [*by, "pos", *order, "curr_hash"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, pos = None, "", -1
        for batch in batches:
            hashes, places = [], []
            for own, text in zip(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if own != key:
                    key, last, pos = own, "", -1
                last, pos = hashlib.sha256((last + text).encode()).hexdigest(), pos + 1
                hashes.append(last)
                places.append(pos)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], pa.array(places, pa.int32()), *batch.columns[keys:-1], pa.array(hashes, pa.string())], names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(fold, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "pos int", *[f"`{c}` {kinds[c]}" for c in order], "curr_hash string"]))


def chain_intact(df: DataFrame, by: list[str], order: list[str], line: Column, prev: str, curr: str) -> DataFrame:
    """Per group whether every row continues the one before and hashes to what it says. One window, no fold."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.lag(curr).over(w), F.lit(""))
    ok = (F.coalesce(F.col(prev), F.lit("")) == before) & (F.col(curr) == F.sha2(F.concat(before, line), 256))
    return df.withColumn("_ok", ok).groupBy(*by).agg(F.bool_and("_ok").alias("intact"), F.count("*").alias("n"))
