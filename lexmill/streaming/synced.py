"""A table kept in step with a change feed, by copy on write of the buckets that changes touch.

Rows lie in buckets by a hash of their parent (a document, say), so a change of one row, and the removal of a parent with all its rows, stay in
one bucket. A version is a small manifest that names the folder of every bucket; a batch writes new folders for the
buckets it touches and then a manifest, by which it takes effect as a whole. Other buckets keep their files. A batch that runs again
after its manifest was written does nothing; one that was lost before leaves files that nothing names, and is done anew.

Removed keys and parents stay as tombstones, so that late changes of an older order do not bring them back, until the newest order seen is more
than ``keep_for`` ahead. Versions before the last ``versions`` are pruned, with the folders that only they name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.sources import manifest as M

UPSERT, DELETE, DELETE_PARENT = "upsert", "delete", "delete_parent"


class SyncedTable:
    """Rows (parent, key, order, value columns); order is a number, ties go to the removal, then to the greater values.

    Changes are rows of the same columns and ``op``: upsert, delete (of a key of a parent) or delete_parent (the key is ignored).
    Changes without a parent, or without a key where one is needed, or without an order are left out.
    """

    def __init__(self, spark: SparkSession, path: str, parent: str, key: str, order: str, buckets: int = 64, versions: int = 3, keep_for: int = 1000):
        self.spark, self.path, self.parent, self.key, self.order = spark, path, parent, key, order
        self.buckets, self.versions, self.keep_for = buckets, versions, keep_for

    def manifest(self, version: int | None = None) -> dict | None:
        known = self._known()
        if not known:
            return None
        return json.loads(M.text_of(self.spark, f"{self.path}/manifest/{known[-1] if version is None else version}.json"))

    def _known(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in M.names_in(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows and tombstones of some buckets, by their folders alone."""
        schema = StructType.fromJson(state["schema"])
        held = {int(b): v for b, v in state["folders"].items() if buckets is None or int(b) in buckets}
        paths = [f"{self.path}/data/{v}/_bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of an older one that is still kept."""
        state = self.manifest(version)
        return self._rows(state).where(F.col("op") == UPSERT).drop("op")

    def apply(self, changes: DataFrame, batch: int | None = None) -> dict:
        """Takes a batch of changes; batch numbers ascend, and one that is not above the last is known already."""
        state = self.manifest() or {"version": 0, "batch": -1, "newest": None, "folders": {}, "schema": json.loads(changes.schema.json())}
        if batch is not None and batch <= state["batch"]:
            return state
        named = F.col(self.parent).isNotNull() & F.col(self.order).isNotNull() & (F.col(self.key).isNotNull() | (F.col("op") == DELETE_PARENT))
        bucket = F.pmod(F.xxhash64(self.parent), F.lit(self.buckets)).cast("int")
        own = changes.select(*StructType.fromJson(state["schema"]).names).where(named)
        newest = own.agg(F.max(self.order)).first()[0]
        if newest is None:
            return state
        newest = max(newest, state["newest"]) if state["newest"] is not None else newest
        # At most one number a bucket.
        touched = sorted(r[0] for r in own.select(bucket).distinct().collect())
        version = state["version"] + 1
        folder = f"v{version}"
        merged = self._merged(self._rows(state, touched).unionByName(own), newest)
        merged.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        written = {int(n.removeprefix("_bucket=")) for n in M.names_in(self.spark, f"{self.path}/data/{folder}") if n.startswith("_bucket=")}
        folders = {b: v for b, v in state["folders"].items() if int(b) not in touched} | {str(b): folder for b in written}
        new = {"version": version, "batch": state["batch"] if batch is None else batch, "newest": newest, "folders": folders, "schema": state["schema"]}
        M.replace_text(self.spark, f"{self.path}/manifest/{version}.json", json.dumps(new))
        self._prune()
        return new

    def _merged(self, rows: DataFrame, newest) -> DataFrame:
        """Of each key the last change, less those that a later removal of their parent covers, and the tombstones that are still needed."""
        names = rows.columns
        by_parent = rows.where(F.col("op") == DELETE_PARENT).groupBy(self.parent).agg(F.max(self.order).alias("_gone"))
        late = [c for c in names if c not in (self.parent, self.key, self.order, "op")]
        rank = F.struct(F.col(self.order), (F.col("op") == DELETE).alias("_removed"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(late)])
        single = rows.where(F.col("op") != DELETE_PARENT)
        last = single.groupBy(self.parent, self.key).agg(F.max_by(F.struct(*[c for c in names if c not in (self.parent, self.key)]), rank).alias("_r")).select(self.parent, self.key, "_r.*").select(*names)
        kept = last.join(by_parent, self.parent, "left").where(F.col("_gone").isNull() | (F.col(self.order) > F.col("_gone"))).select(*names)
        needed = F.col(self.order) >= F.lit(newest) - self.keep_for
        stones = by_parent.where(F.col("_gone") >= F.lit(newest) - self.keep_for)
        kinds = {f.name: f.dataType for f in rows.schema}
        parents = stones.select(*[F.col("_gone").alias(c) if c == self.order else F.col(c) if c == self.parent else F.lit(DELETE_PARENT).alias(c) if c == "op" else F.lit(None).cast(kinds[c]).alias(c) for c in names])
        return kept.where((F.col("op") == UPSERT) | needed).unionByName(parents)

    def _prune(self) -> None:
        known = self._known()
        old, kept = known[: -self.versions], known[-self.versions :]
        if not old:
            return
        used = {(v, int(b)) for n in kept for b, v in self.manifest(n)["folders"].items()}
        folders = {v for v, _ in used}
        for number in old:
            for b, v in self.manifest(number)["folders"].items():
                if (v, int(b)) not in used:
                    M.remove(self.spark, f"{self.path}/data/{v}/_bucket={b}" if v in folders else f"{self.path}/data/{v}")
            M.remove(self.spark, f"{self.path}/manifest/{number}.json")

    def keep(self, stream: DataFrame, checkpoint: str):
        """A writer that applies every micro-batch of a change stream once."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number) and None).option("checkpointLocation", checkpoint)
