"""Sharding by sampled splitters: shards of nearly equal bytes, in order of the key.

A size-weighted sample of keys gives quantile boundaries, which range-partition the records. Ranges
that hold more than their share are subdivided by the sampled keys that lie inside them. Splitters are of key, CRC and
row number, so that a key, or a text, that a third of all rows has is spread like any other. The exact totals of
the final ranges, summed in key order, place every record: with S bytes before it, size s and T bytes
in all, a record goes to shard floor(shards * (S + s / 2) / T). So the sample decides how even the
work is, never the result, and shard sizes differ by no more than the records at their edges.

DataFrame functions only. There are as many ranges as keep ``ROWS`` rows each, between two bounds. What reaches the driver
is the sample, ``SAMPLED`` keys a range, and one row per range. Windows run inside ranges, over digest rows without texts.

A null text has size 8 and CRC 0. A null key sorts first. Repeated rows are separate records; equal
keys are ordered by CRC, and rows equal in both by the order in which they were read. An empty table gives
an empty result. Only the two named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm._shared import saved

SHARDS = 24
OVERHEAD = 8
#: Rows that a first range should have, the bounds of the number of these ranges, expected number of sampled keys of each,
#: and parts that an overfull range may get at most.
ROWS, LEAST_RANGES, MOST_RANGES, SAMPLED, PARTS = 1 << 20, 128, 1024, 32, 64
_SPLITTER = ("key", "text_crc32", "row")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _position(place: Column, bounds: list[tuple]) -> Column:
    """How many of the sorted bounds are at most the place, by a balanced tree of comparisons; null keys are least."""
    literal = lambda b: F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(b, _SPLITTER, strict=True)])

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(place < literal(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds)) if bounds else F.lit(0)


def _ascending(place: tuple) -> tuple:
    return (place[0] is not None, place[0] or 0, *place[1:])


def _quantiles(sample: list[tuple[tuple, float]], parts: int) -> list[tuple]:
    """Places that cut a weighted, sorted sample into parts of equal weight."""
    total, seen, cuts = sum(w for _, w in sample), 0.0, []
    for place, weight in sample:
        seen += weight
        wanted = min(parts - 1, int(seen * parts / total))
        cuts += [place] * (wanted - len(cuts))
    return sorted(set(cuts), key=_ascending)


def size_ranges(sized: DataFrame, total: int, rows: int, ranges: int | None = None) -> DataFrame:
    """Adds ``range`` to (key, text_crc32, row, size): numbers that ascend with the place, of nearly equal bytes.

    A record is sampled with probability size * sample / total, by a hash of its place, and weighs the
    excess where that is over 1.
    """
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, rows // ROWS))
    chance = F.col("size") * F.lit(float(SAMPLED * ranges)) / F.lit(float(max(total, 1)))
    spot = F.pmod(F.xxhash64(*_SPLITTER), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = sized.where(spot < chance).select(*_SPLITTER, F.greatest(chance, F.lit(1.0)).alias("weight"))
    sample = sorted((((*r[:3],), r[3]) for r in drawn.collect()), key=lambda x: _ascending(x[0]))
    place = F.struct(*[F.col(c).cast("long").alias(c) for c in _SPLITTER])
    bounds = _quantiles(sample, ranges)
    placed = sized.withColumn("_coarse", _position(place, bounds))
    # Ranges over their share get splitters from the part of the sample that lies in them.
    held = {r[0]: r[1] for r in placed.groupBy("_coarse").agg(F.sum("size")).collect()}
    share = max(1.0, total / ranges)
    at = [bisect.bisect_right(bounds, _ascending(p), key=_ascending) for p, _ in sample]
    inner = {n: _quantiles([x for x, k in zip(sample, at, strict=True) if k == n], min(PARTS, int(size // share) + 1)) for n, size in held.items() if size > 1.25 * share}
    fine = F.lit(0)
    for number, cuts in inner.items():
        if cuts:
            fine = F.when(F.col("_coarse") == number, _position(place, cuts)).otherwise(fine)
    return placed.withColumn("range", F.col("_coarse").cast("long") * (PARTS + 1) + fine).drop("_coarse")


def shard_table(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size, text_crc32, law ``bytes``, shard, slot (gapless from 0 by key) and grown_shard (null)."""
    text = F.col(text_column).cast("string")
    digest = saved(docs.select(F.col(id_column).alias("key"), record_size(text).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.monotonically_increasing_id().alias("row")))
    total, rows = digest.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranged = size_ranges(digest, total, rows)
    order = Window.partitionBy("range").orderBy(F.col("key").asc_nulls_first(), "text_crc32", "row")
    inside = ranged.withColumn("_upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # One row per range, on the driver: bytes before each range.
    starts, before = {}, 0
    for r in ranged.groupBy("range").agg(F.sum("size").alias("s")).orderBy("range").collect():
        starts[r[0]] = before
        before += r[1]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(list(starts.items()) or [(0, 0)], "range long, _start long")
    at = F.col("_start") + F.col("_upto") - F.col("size")
    # floor(shards * (at + size / 2) / total) in whole numbers
    shard = F.least(F.lit(shards - 1).cast("long"), F.expr(f"(({shards} * (2 * (_start + _upto - size) + size)) div (2 * {max(total, 1)}))"))
    placed = inside.join(F.broadcast(offsets), "range").withColumn("_at", at).withColumn("shard", shard.cast("int"))
    # Slots: rank inside (range, shard), after the records of earlier ranges in the same shard.
    placed = saved(placed.withColumn("_in", F.row_number().over(Window.partitionBy("range", "shard").orderBy(F.col("key").asc_nulls_first(), "text_crc32", "row"))).drop("_upto", "_start", "_at"))
    pieces = placed.groupBy("range", "shard").agg(F.count("*").alias("n"))
    first = pieces.withColumn("_first", F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    found = placed.join(first, ["range", "shard"])
    return found.select(
        F.col("key").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_first") + F.col("_in") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle_sql(shards: int = SHARDS) -> str:
    """CRC-32 is folded over the bytes with a table of 256 entries, itself made by eight shifts."""
    shift = "range(8)::BIGINT[]"
    return f"""
WITH entries AS (SELECT list(e ORDER BY i) AS t FROM (
    SELECT i, list_reduce({shift}, lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) AS e FROM range(256) r(i))),
raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS (SELECT doc_id, octet_length(b) + 8 AS size,
    xor(4294967295, list_reduce(list_transform(range(octet_length(b)), lambda k: (strpos('0123456789ABCDEF', h[2 * k + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * k + 2]) - 1)::BIGINT[],
      lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)]), 4294967295::BIGINT)) AS text_crc32 FROM raw, entries),
summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size AS below, sum(size) OVER ()::BIGINT AS total FROM crcs),
placed AS (SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, least({shards - 1}, ({shards} * (2 * below + size)) // (2 * total))::INTEGER AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed"""
