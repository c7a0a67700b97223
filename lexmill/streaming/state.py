"""Keyed state: change capture, expiry, circuit breaker, rate limit.

Each has a batch form over the full history, and a streaming form that keeps only the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_state(changes: DataFrame, key: str, order: list[str], op: str = "op") -> DataFrame:
    """What a feed of inserts, updates and deletes leaves: the last change of each key unless it deletes."""
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(key, "_r.*").where(F.col(op) != "delete").drop(op)


def sync_table(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str, op: str = "op"):
    """Keeps the latest state of a change stream in versions under path, one per micro-batch that changed it.

    A batch that runs again writes the same version, so a restart neither loses nor doubles changes.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else None
        merged = batch if old is None else old.unionByName(batch)
        rest = [c for c in merged.columns if c != key]
        last = merged.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
        last.select(*merged.columns).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def breaker_runs(events: DataFrame, by: list[str], order: list[str], failed: Column, threshold: int) -> DataFrame:
    """Adds the run of failures up to each event, and whether it trips the breaker."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = events.withColumn("_failed", failed).withColumn("_run", run)
    within = Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    length = F.sum(F.col("_failed").cast("int")).over(within)
    return marked.withColumn("failures", length).withColumn("trips", F.col("failures") == threshold).drop("_failed", "_run")


def rate_gaps(events: DataFrame, by: list[str], order: list[str], at: str, seconds: float) -> DataFrame:
    """Events that follow the one before them sooner than the least gap."""
    w = Window.partitionBy(*by).orderBy(*order)
    now = F.unix_micros(F.col(at).cast("timestamp"))
    gap = now - F.lag(now).over(w)
    return events.withColumn("_gap", gap).where(F.col("_gap") < seconds * 1e6).drop("_gap")


def breaker_stream(stream: DataFrame, key: str, threshold: int, open_seconds: float) -> DataFrame:
    """(key, ts, state) of a keyed circuit breaker over rows (key, ts, failed): closed, open, half_open.

    ``threshold`` failures in a row open it; after open_seconds one call is let through, whose outcome closes or opens it again.
    """

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, run, since = state.get if state.exists else ("closed", 0, 0.0)
        out = []
        for row in sorted((r for b in batches for r in b[["ts", "failed"]].itertuples(index=False)), key=lambda r: r.ts):
            now = row.ts.timestamp()
            if name == "open" and now - since >= open_seconds:
                name = "half_open"
            if name != "open":
                run = run + 1 if row.failed else 0
                if row.failed and (name == "half_open" or run >= threshold):
                    name, since = "open", now
                elif not row.failed:
                    name = "closed"
            out.append((own[0], row.ts, name))
        state.update((name, run, since))
        yield pd.DataFrame(out, columns=[key, "ts", "state"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, "ts", "failed").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, state string", "name string, run int, since double", "append", GroupStateTimeout.NoTimeout)


def expiring_cache(stream: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """(key, value, expired): each value as it comes, and once more, expired, when its key was silent for the time to live."""

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (value,) = state.get
            state.remove()
            yield pd.DataFrame({key: [own[0]], "value": [value], "expired": [True]})
            return
        value = None
        for b in batches:
            value = b["value"].iloc[-1]
        state.update((value,))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [own[0]], "value": [value], "expired": [False]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, "value").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, value string, expired boolean", "value string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def running_means(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Online count and mean per key: an ordinary aggregate, which a stream keeps up to date."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def allowlisted(c: Column, allowed: list[str]) -> Column:
    """Bounds the number of labels: what is not listed is ``other``."""
    return F.when(c.isin(*allowed), c).otherwise("other")
