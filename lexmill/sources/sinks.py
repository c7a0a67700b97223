"""Sinks: keyed tables, archives, exports, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import escape_formula


def upserted(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key of both; new rows win where the order is equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, "_new")).alias("_r"))
    return last.select(key, "_r.*").select(*old.columns)


def without(rows: DataFrame, ids: DataFrame | None = None, documents: DataFrame | None = None, key: str = "chunk_id", document: str = "document_id") -> DataFrame:
    """Deletes by ids, else by documents; ids decide when both are given."""
    if ids is not None:
        return rows.join(ids.select(key), key, "left_anti")
    if documents is not None:
        return rows.join(documents.select(document), document, "left_anti")
    raise ValueError("ids or documents must be given")


def digest(points: DataFrame) -> DataFrame:
    """One row (count, sha256): the digest of the sums of the rows' own digests, whatever the order of the rows."""
    own = F.sha2(F.to_json(F.struct(*points.columns)), 256)
    part = lambda i: F.sum(F.conv(F.substring("own", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return points.select(own.alias("own")).agg(F.count("*").alias("count"), F.sha2(F.concat_ws(" ", *[part(i).cast("string") for i in range(4)]), 256).alias("sha256"))


def save_archive(points: DataFrame, path: str) -> None:
    """An archive as point_archive reads it: the folder ``points`` of JSON lines, and ``manifest`` with their count and digest. Refuses to be empty."""
    if points.isEmpty():
        raise ValueError("there is nothing to archive")
    points.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/points")
    digest(points.sparkSession.read.schema(points.schema).json(f"{path}/points")).withColumn("schema", F.lit(points.schema.json())).write.mode("overwrite").json(f"{path}/manifest")


def save_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; text cells that a spreadsheet would run are escaped."""
    cells = [escape_formula(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def save_compact_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def save_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def append_log(rows: DataFrame, path: str, day: str) -> None:
    """Appends to a log partitioned by day, so later scans prune."""
    rows.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def keep_newest(names: DataFrame, column: str, n: int) -> DataFrame:
    """The names that go when the n greatest stay."""
    kept = names.orderBy(F.desc(column)).limit(max(1, n))
    return names.join(kept, column, "left_anti")
