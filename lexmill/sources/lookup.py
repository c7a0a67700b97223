"""Payloads by id over several collections: a written table in buckets, of which a lookup opens only those that can hold its ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to which a lookup is a filter of the scan; more are joined, bucket by bucket.
STATED = 1000


def _bucket(item: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int")


def build_lookup(collections: dict[str, DataFrame], path: str, key: str, buckets: int = 64) -> PayloadLookup:
    """Writes (id, collection, position, payload) of collections, of which later ones override earlier ones; a payload is all columns of its row as JSON.

    Inside a bucket rows are in order of id, and files carry Bloom filters of the ids, so a filter skips most of what it does open. Rows
    without an id are left out. Of rows of one id in one collection the first payload in order of text is kept.
    """
    parts = [df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.lit(name).alias("collection"), F.lit(number).alias("position"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload")) for number, (name, df) in enumerate(collections.items())]
    rows = reduce(DataFrame.unionByName, parts).groupBy("id", "collection", "position").agg(F.min("payload").alias("payload"))
    dealt = rows.withColumn("bucket", _bucket(F.col("id"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "id", "position")
    dealt.write.option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket").parquet(path)
    return PayloadLookup(rows.sparkSession, path, buckets)


class PayloadLookup:
    """A written lookup."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("id string, collection string, position int, payload string, bucket int").parquet(self.path)

    def all_of(self, ids: DataFrame) -> DataFrame:
        """(id, collection, position, payload) of every collection that has an id of rows (id). Ids that none has are missing."""
        wanted = ids.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
        few = [r[0] for r in wanted.limit(STATED + 1).collect()]
        if len(few) <= STATED:
            buckets = [r[0] for r in self.spark.createDataFrame([(i,) for i in few], "id string").select(_bucket(F.col("id"), self.buckets)).distinct().collect()]
            return self._rows().where(F.col("bucket").isin(buckets) & F.col("id").isin(few)).drop("bucket")
        return self._rows().join(wanted.withColumn("bucket", _bucket(F.col("id"), self.buckets)), ["bucket", "id"], "left_semi").drop("bucket")

    def payloads(self, ids: DataFrame) -> DataFrame:
        """(id, collection, payload): of each id the payload of the last collection that has it."""
        best = self.all_of(ids).groupBy("id").agg(F.max_by(F.struct("collection", "payload"), "position").alias("r"))
        return best.select("id", "r.*")
