"""Change feeds, windows, state machines and keyed counters over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import enrichment as N
from lexmill.operators.rules import Rule, evaluate
from lexmill.plans._registering import register
from lexmill.sources import sinks
from lexmill.sources.shared import shared_folder
from lexmill.streaming import state as S
from lexmill.streaming import windows as W
from lexmill.streaming.synced import SyncedTable


@register("cdc_latest_state", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'click'", "events")
def cdc_latest(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "delete").otherwise("upsert")
    return S.latest_state(events.select("user_id", "event_id", "ts", "value", op.alias("op")), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@register("keyed_upsert", "SELECT o_custkey, arg_max(v, (y, new)) AS v, max(y) AS y FROM (SELECT o_custkey, year(o_orderdate)::INTEGER AS y, 1 - o_orderkey % 2 AS new, max(o_orderkey) AS v FROM orders GROUP BY 1, 2, 3) GROUP BY 1", "orders")
def keyed_upsert(orders: DataFrame) -> DataFrame:
    """Odd orders are the table, even ones the batch, one row a customer and year: the latest year stays, the batch's if both have it."""
    rows = orders.groupBy("o_custkey", F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 2).alias("odd")).agg(F.max("o_orderkey").alias("v"))
    part = lambda odd: rows.where(F.col("odd") == odd).select("o_custkey", "v", "y")
    return sinks.upserted(part(1), part(0), "o_custkey", ["y"])


@register("breaker_runs", """SELECT user_id, event_id, failures, failures = 3 AS trips FROM (SELECT user_id, event_id, sum(f) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures FROM (SELECT *, (event_type = 'view')::INT AS f, sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events))""", "events")
def breaker(events: DataFrame) -> DataFrame:
    return S.breaker_runs(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", 3).select("user_id", "event_id", "failures", "trips")


@register("rate_gap_violations", "SELECT user_id, event_id FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap < 3600000000", "events")
def rate_gaps(events: DataFrame) -> DataFrame:
    return S.rate_gaps(events, ["user_id"], ["ts", "event_id"], "ts", 3600).select("user_id", "event_id")


@register("tumbling_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2", "events")
def tumbling(events: DataFrame) -> DataFrame:
    return W.tumbling(events, "1 day", ["event_type"])


@register("sliding_windows", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS start FROM events) GROUP BY 1, 2", "events")
def sliding(events: DataFrame) -> DataFrame:
    return W.sliding(events, "24 hours", "12 hours", ["event_type"])


@register("session_windows", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6 hours')::INT AS new FROM events)) GROUP BY user_id, s""", "events")
def session(events: DataFrame) -> DataFrame:
    return W.sessions(events, "6 hours", ["user_id"])


@register("running_means", "SELECT event_type, user_id % 3 AS action, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2", "events")
def running(events: DataFrame) -> DataFrame:
    return S.running_means(events.withColumn("action", F.col("user_id") % 3), ["event_type", "action"], "value").withColumn("mean", F.round("mean", 6))


@register("request_histogram", "SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS label, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) AS le_inf FROM events GROUP BY 1", "events")
def request_histogram(events: DataFrame) -> DataFrame:
    label = S.allowlisted(F.col("event_type"), ["view", "click"])
    return W.histogram(events.withColumn("label", label), "value", [10, 50], ["label"])


@register("research_targets", "SELECT event_type AS query, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN arg_max(value, (ts, event_id)) > 50 THEN 'open' ELSE 'closed' END AS status FROM events GROUP BY 1", "events")
def research_targets(events: DataFrame) -> DataFrame:
    """A keyed running count whose state opens again on a repeat."""
    last = F.max_by("value", F.struct("ts", "event_id"))
    return events.groupBy(F.col("event_type").alias("query")).agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.when(last > 50, "open").otherwise("closed").alias("status"))


@register("last_checkpoint", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 1", "orders")
def last_checkpoint(orders: DataFrame) -> DataFrame:
    return orders.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey", "o_orderdate")


@register("high_watermark", "SELECT o_custkey, max(o_orderdate) > TIMESTAMP '1997-01-01' AS rebuild FROM orders GROUP BY 1", "orders")
def high_watermark(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg((F.max("o_orderdate") > F.lit("1997-01-01").cast("timestamp")).alias("rebuild"))


@register("idempotency_keys", "SELECT event_id, sha256(concat_ws(':', event_type, user_id::VARCHAR, props)) AS key FROM events", "events")
def idempotency(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.sha2(F.concat_ws(":", "event_type", F.col("user_id").cast("string"), "props"), 256).alias("key"))


@register("prune_archives", "SELECT s_name AS name FROM supplier WHERE s_name NOT IN (SELECT s_name FROM supplier ORDER BY s_name DESC LIMIT 5)", "supplier")
def prune(supplier: DataFrame) -> DataFrame:
    return sinks.keep_newest(supplier.select(F.col("s_name").alias("name")), "name", 5)


@register("rule_findings", """SELECT o_orderkey, unnest(['old', 'large']) AS rule, unnest(['warning', 'error']) AS severity, '' AS message FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' AND o_totalprice > 200000
UNION ALL SELECT o_orderkey, 'old', 'warning', '' FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' AND o_totalprice <= 200000 UNION ALL SELECT o_orderkey, 'large', 'error', '' FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_totalprice > 200000""", "orders")
def rule_findings(orders: DataFrame) -> DataFrame:
    rules = [Rule("old", "warning", F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")), Rule("large", "error", F.col("o_totalprice") > 200000)]
    return evaluate(orders, "o_orderkey", rules)


@register("synced_changes", """WITH c AS (SELECT user_id, event_type, event_id, value, CASE WHEN event_id % 17 = 0 THEN 'delete_parent' WHEN event_id % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM events),
g AS (SELECT user_id, max(event_id) AS gone FROM c WHERE op = 'delete_parent' GROUP BY 1),
l AS (SELECT * FROM c WHERE op <> 'delete_parent' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT user_id, event_type, event_id, value FROM l LEFT JOIN g USING (user_id) WHERE op = 'upsert' AND (gone IS NULL OR event_id > gone)""", "events")
def synced_changes(events: DataFrame) -> DataFrame:
    """A table kept by three batches of changes that come out of order; some remove a user with all that is theirs."""
    op = F.when(F.col("event_id") % 17 == 0, "delete_parent").when(F.col("event_id") % 5 == 0, "delete").otherwise("upsert")
    changes = events.select("user_id", "event_type", "event_id", "value", op.alias("op"))
    # Nothing is old enough to be forgotten.
    table = SyncedTable(events.sparkSession, f"{shared_folder(events.sparkSession)}/{uuid.uuid4().hex}", "user_id", "event_type", "event_id", buckets=16, keep_for=1 << 40)
    for number in (1, 0, 2):
        table.apply(changes.where(F.col("event_id") % 3 == number))
    return table.read()


_CHUNK = "text || ' See section ' || ((turn * 7 + conv_id) % 9 + 1) || '.'"


@register("enriched_chunks", f"""WITH c AS (SELECT conv_id, turn, conv_id || '#' || turn AS chunk_id, {_CHUNK} AS t, CASE WHEN turn = 0 THEN CAST(conv_id % 10 AS VARCHAR) END AS section, ((turn * 7 + conv_id) % 9 + 1)::VARCHAR AS named FROM conversations WHERE text IS NOT NULL),
h AS (SELECT section, arg_min(chunk_id, (conv_id, turn)) AS holder FROM c WHERE section IS NOT NULL GROUP BY 1)
SELECT conv_id AS document, chunk_id, lag(chunk_id) OVER w AS before, lead(chunk_id) OVER w AS after, named AS names, coalesce(CASE WHEN holder <> chunk_id THEN holder END, '') AS targets,
CASE WHEN length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) < {N.LEAST_LETTERS} THEN 'FAILED' ELSE 'ENRICHED' END AS status
FROM c LEFT JOIN h ON h.section = c.named WINDOW w AS (PARTITION BY conv_id ORDER BY turn, chunk_id)""", "conversations")
def enriched_chunks(conv: DataFrame) -> DataFrame:
    """Turns as chunks, each with a stated mention behind its text; first turns hold a section. Batches are committed one by one."""
    chunks = conv.where("text IS NOT NULL").select(
        F.col("conv_id").alias("document"), F.concat_ws("#", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("chunk_index"), F.lit("act").alias("act"),
        F.when(F.col("turn") == 0, (F.col("conv_id") % 10).cast("string")).alias("section"), F.expr(_CHUNK).alias("text"),
    )
    path = f"{shared_folder(conv.sparkSession)}/{uuid.uuid4().hex}"
    N.run(chunks, path, 4)
    return N.rows(conv.sparkSession, path).withColumn("names", F.array_join("names", ",")).withColumn("targets", F.array_join("targets", ","))
