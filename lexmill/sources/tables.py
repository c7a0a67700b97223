"""Readers of the fixture tables. Paths are opened by Spark alone, so any store it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of long texts, whose rows are dear to work on.
TEXTS = ("documents", "conversations", "pages")
#: Bytes a core up to which a table in few files is dealt out; larger files have row groups enough for all.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt out to all: one row group is one task, whatever the cores.
    Filters and column choices still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL * cores
    return df.repartition(cores) if small and 2 * len(df.inputFiles()) <= cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df
