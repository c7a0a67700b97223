"""Round trips through sources and sinks, over given tables: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.operators import ingest as I
from lexmill.operators.rules import Registry, SeenHashes, Stage, run_stages
from lexmill.plans._registering import register
from lexmill.plans.evaluation_queries import _ingest_sql
from lexmill.sources import readers, sinks
from lexmill.sources.shared import saved, shared_folder
from lexmill.streaming import state


def _folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"


@register("archived_points", "SELECT o_orderkey AS id, o_custkey AS customer, o_orderpriority AS priority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders", "orders")
def archived_points(orders: DataFrame) -> DataFrame:
    """An archive that is read back only if its count and digest hold."""
    path = _folder(orders)
    points = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"))
    sinks.save_archive(points, path)
    return readers.point_archive(orders.sparkSession, path)


@register("typed_csv_rows", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS customer, o_orderkey % 2 = 0 AS urgent, o_orderdate::DATE AS day,
CASE WHEN o_orderkey % 5 = 0 THEN '''=' || o_orderpriority ELSE o_orderpriority END AS note FROM orders""", "orders")
def typed_csv_rows(orders: DataFrame) -> DataFrame:
    """Cells written as text, some empty, some as None, some that a spreadsheet would run, read by declared types."""
    path, number = _folder(orders), F.col("o_orderkey")
    customer = F.when(number % 6 == 0, "").when(number % 3 == 0, "None").otherwise(F.col("o_custkey").cast("string"))
    note = F.concat(F.when(number % 5 == 0, "=").otherwise(""), "o_orderpriority")
    cells = orders.select(number.alias("id"), customer.alias("customer"), F.when(number % 4 == 0, "yes").when(number % 2 == 0, "True").otherwise("no").alias("urgent"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), note.alias("note"))
    sinks.save_csv(cells, path)
    return readers.typed_csv(orders.sparkSession, path, StructType.fromDDL("id long, customer long, urgent boolean, day date, note string"))


@register("loose_json_rows", "SELECT s_suppkey AS id, s_name AS name, s_nationkey % 2 = 0 AS near FROM supplier", "supplier")
def loose_json_rows(supplier: DataFrame) -> DataFrame:
    """Objects with bare keys and single quotes."""
    path = _folder(supplier)
    line = F.concat(F.lit("{id: "), F.col("s_suppkey"), F.lit(", name: '"), F.col("s_name"), F.lit("', near: "), (F.col("s_nationkey") % 2 == 0).cast("string"), F.lit("}"))
    supplier.select(line.alias("value")).write.text(path)
    return readers.loose_json(supplier.sparkSession, path, "id long, name string, near boolean", lines=True)


_STORED = "CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || chr(12) || 'second sheet of ' || doc_id ELSE coalesce(text, '') END"


@register("directory_pages", f"""WITH d AS (SELECT doc_id, string_split({_STORED}, chr(12)) AS s FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, i - 1 AS sheet, s[i] AS t FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM d)),
c AS (SELECT doc_id, sheet, k AS part, substr(t, 1 + k * 4000, 4000) AS t FROM (SELECT *, unnest(range(0, greatest(1, (length(t) + 3999) // 4000))) AS k FROM p))
SELECT doc_id, sheet::INTEGER AS sheet, part::INTEGER AS part, length(t)::INTEGER AS n_chars, md5(t) AS hash FROM c""", "documents")
def directory_pages(docs: DataFrame) -> DataFrame:
    """Texts as files of a directory, one row a file, some in two sheets and some in another encoding; read as pages."""
    path, text = _folder(docs), F.expr(_STORED.replace("chr(12)", "char(12)"))
    known = docs.where("doc_id IS NOT NULL").select("doc_id", text.alias("text"))
    files = known.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.encode("text", "UTF-8")).alias("content"))
    files.write.parquet(path)
    decoded = docs.sparkSession.read.parquet(path).select(F.col("doc_id").cast("string").alias("path"), readers.decoded("content").alias("text"))
    return readers.paged(decoded).select(F.col("path").cast("long").alias("doc_id"), "sheet", "part", F.length("text").alias("n_chars"), F.md5("text").alias("hash"))


@register("ingested_twice", f"WITH {_ingest_sql('a', 'WHERE doc_id % 2 = 0', None)}, {_ingest_sql('b', '', 'a')} SELECT 0 AS run, * FROM a UNION ALL SELECT 1, * FROM b", "documents")
def ingested_twice(docs: DataFrame) -> DataFrame:
    """A directory that grows between two runs: the second takes in what the first has not seen."""
    first = saved(I.ingest(docs.where("doc_id % 2 = 0"), "doc_id", "text").drop("chunk"))
    second = I.ingest(docs, "doc_id", "text", first).drop("chunk")
    return first.select(F.lit(0).alias("run"), "*").unionByName(second.select(F.lit(1).alias("run"), "*"))


@register("staged_ranking", """WITH r AS (SELECT o_custkey AS query, o_orderkey AS item, o_totalprice AS score FROM orders WHERE o_orderstatus <> 'P')
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS rank FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 3""", "orders")
def staged_ranking(orders: DataFrame) -> DataFrame:
    """Stages from a registry, in order: one is switched off, one fails to be planned and is passed over."""
    known = Registry()
    known.add("open")(lambda df: df.where("status <> 'P'"))
    known.add("best")(lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))).where("rank <= 3"))
    stages = [Stage("open", known.parts["open"]), Stage("broken", lambda df: df.select("no such column"), isolate=True), Stage("off", lambda df: df.limit(0), enabled=False), Stage("best", known.parts["best"])]
    rows = orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("status"))
    return run_stages(rows, stages).select("query", "item", "rank")


@register("seen_batches", "SELECT md5(p_name) AS hash, min(p_partkey % 4) AS batch FROM part GROUP BY p_name", "part")
def seen_batches(part: DataFrame) -> DataFrame:
    """Four batches against a store of hashes that grows: in which batch each name was new."""
    rows = part.select(F.md5("p_name").alias("hash"), (F.col("p_partkey") % 4).alias("batch"))
    store, out = SeenHashes(rows.limit(0)), None
    for number in range(4):
        batch = rows.where(F.col("batch") == number).select("hash").distinct()
        new, _ = store.split(batch)
        own = saved(new.withColumn("batch", F.lit(number).cast("long")))
        store = store.record(batch)
        out = own if out is None else out.union(own)
    return out


@register("breaker_states", None, "events")
def breaker_states(events: DataFrame) -> DataFrame:
    """The keyed breaker as a stream over the events, views as failures, until all is read."""
    spark, path = events.sparkSession, _folder(events)
    rows = events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "view").alias("failed")).where("key IS NOT NULL")
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    found = state.breaker_stream(stream, "key", 2, 3600.0)
    found.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")
