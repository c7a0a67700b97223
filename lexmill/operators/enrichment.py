"""Enrichment of chunks in two passes, in batches that a ledger commits one by one.

The first pass reads all chunks: which chunk first names a section of an act. The second goes document by document, dealt to batches by a hash,
and adds to each chunk its neighbours, the sections it names, the chunks that hold these, and a quality status. A batch's rows
are written to a folder of their own; then one small file of the ledger names that folder, and only what the ledger names is read. So a job that is lost
between the two leaves nothing behind that counts, and a batch that is done is passed over as long as a digest of its input and of the first pass is the same.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import extract as X
from lexmill.sources import manifest as M
from lexmill.sources.shared import saved

LEAST_LETTERS = 20


def section_index(chunks: DataFrame) -> DataFrame:
    """(act, section, holder): the first chunk, by document and chunk_index, whose own section it is."""
    own = chunks.where("section IS NOT NULL AND chunk_id IS NOT NULL")
    return own.groupBy("act", "section").agg(F.min_by("chunk_id", F.struct("document", "chunk_index", "chunk_id")).alias("holder"))


def named_sections(text: Column) -> Column:
    """Different sections that a text names, in order of their first mention."""
    return F.array_distinct(F.transform(X.references_in(text, "HIGH"), lambda r: F.regexp_extract(r["raw"], r"(\d[\w.]*)", 1)))


def enriched(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(document, chunk_id, before, after, names, targets, status) of rows (document, chunk_id, chunk_index, act, section, text).

    targets are the holders of the named sections of the same act, others than the chunk itself, in order of mention; FAILED is a chunk with
    fewer than LEAST_LETTERS letters.
    """
    order = Window.partitionBy("document").orderBy("chunk_index", "chunk_id")
    near = chunks.withColumn("before", F.lag("chunk_id").over(order)).withColumn("after", F.lead("chunk_id").over(order)).withColumn("names", named_sections(F.coalesce("text", F.lit(""))))
    letters = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]", ""))
    rows = near.select("document", "chunk_id", "chunk_index", "act", "before", "after", "names", F.when(letters < LEAST_LETTERS, "FAILED").otherwise("ENRICHED").alias("status"))
    mentions = rows.select("document", "chunk_id", "act", F.posexplode("names").alias("at", "section"))
    met = mentions.join(index, (mentions.section == index.section) & mentions.act.eqNullSafe(index.act)).where(F.col("holder") != F.col("chunk_id"))
    targets = met.groupBy("document", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("at", "holder"))).alias("t"))
    found = rows.join(targets, ["document", "chunk_id"], "left")
    empty = F.array().cast("array<string>")
    return found.select("document", "chunk_id", "before", "after", "names", F.coalesce(F.array_distinct(F.transform("t", lambda x: x["holder"])), empty).alias("targets"), "status")


class Ledger:
    """Which folder holds the rows of each batch, one small file a batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entry(self, name: str) -> dict | None:
        text = M.text_of(self.spark, f"{self.path}/ledger/{name}.json")
        return json.loads(text) if text else None

    def commit(self, name: str, entry: dict) -> None:
        M.replace_text(self.spark, f"{self.path}/ledger/{name}.json", json.dumps(entry))

    def entries(self) -> dict[str, dict]:
        names = [n.removesuffix(".json") for n in M.names_in(self.spark, f"{self.path}/ledger") if n.endswith(".json")]
        return {n: self.entry(n) for n in names}


def run(chunks: DataFrame, path: str, batches: int, enrich: Callable[[DataFrame, DataFrame], DataFrame] = enriched) -> dict[str, int]:
    """Brings the enriched rows under path up to date with the chunks; returns how many batches were written and passed over."""
    spark = chunks.sparkSession
    ledger = Ledger(spark, path)
    dealt = chunks.withColumn("_batch", F.pmod(F.xxhash64("document"), F.lit(batches)).cast("int"))
    digest = F.bit_xor(F.xxhash64(*chunks.columns))
    # One row a batch.
    inputs = {r[0]: (r[1], r[2]) for r in dealt.groupBy("_batch").agg(F.count("*"), digest).collect()}
    whole = f"{sum(n for n, _ in inputs.values())}-{hash_of(inputs)}"
    index = ledger.entry("index")
    if not index or index["input"] != whole:
        folder = f"{path}/index/{whole}"
        section_index(chunks).write.mode("overwrite").parquet(folder)
        ledger.commit("index", {"folder": folder, "input": whole})
    known = spark.read.parquet(f"{path}/index/{whole}")
    # What the index says, not how it came about: changed texts with the same sections leave other batches alone.
    said = hash_of({0: tuple(known.agg(F.count("*"), F.bit_xor(F.xxhash64(*known.columns))).first())})
    done = {"written": 0, "passed": 0, "failed": 0}
    for number, (count, mark) in sorted(inputs.items()):
        name, own = f"batch-{number}", f"{count}-{mark}-{said}"
        entry = ledger.entry(name)
        if entry and entry["input"] == own:
            done["passed"] += 1
            continue
        folder = f"{path}/rows/{name}-{own}"
        enrich(dealt.where(F.col("_batch") == number).drop("_batch"), known).write.mode("overwrite").parquet(folder)
        failed = spark.read.parquet(folder).where("status = 'FAILED'").count()
        ledger.commit(name, {"folder": folder, "input": own, "processed": count, "failed": failed})
        if entry and entry["folder"] != folder:
            M.remove(spark, entry["folder"])
        done["written"] += 1
        done["failed"] += failed
    for name in ledger.entries():
        # Batches that have no documents any more.
        if name.startswith("batch-") and int(name.removeprefix("batch-")) not in inputs:
            M.remove(spark, f"{path}/ledger/{name}.json")
    return done


def hash_of(values: dict) -> str:
    """A digest of a few numbers, the same in every process."""
    return hashlib.sha256(repr(sorted(values.items())).encode()).hexdigest()[:16]


def rows(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows."""
    folders = [e["folder"] for n, e in Ledger(spark, path).entries().items() if n.startswith("batch-")]
    return spark.read.parquet(*sorted(folders)) if folders else None


def once(chunks: DataFrame) -> DataFrame:
    """Both passes without a ledger, for tables that one job enriches."""
    own = saved(chunks)
    return enriched(own, section_index(own))
