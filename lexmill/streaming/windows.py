"""Event-time windows; the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, by: list[str], at: str = "ts", late: str | None = None) -> DataFrame:
    """Counts and sums per window; with ``late`` a stream forgets windows that much after their end."""
    if late:
        events = events.withWatermark(at, late)
    grouped = events.groupBy(F.window(at, size).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, size: str, slide: str, by: list[str], at: str = "ts", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, size, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, by: list[str], at: str = "ts", late: str | None = None) -> DataFrame:
    """Sessions end when a key is silent for the gap."""
    if late:
        events = events.withWatermark(at, late)
    return events.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def histogram(events: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """Cumulative bucket counts, as a metrics endpoint reports them; the last bucket holds all."""
    counts = [F.count_if(F.col(value) <= e).alias(f"le_{e:g}") for e in edges]
    return events.groupBy(*by).agg(*counts, F.count("*").alias("le_inf"))
