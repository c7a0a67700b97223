"""Embedding near-duplicates: balanced binary codes by iterative quantisation, multi-index Hamming tables, cosines of the original vectors.

Equal vectors are one class, with as many copies as rows. On a bounded sample of classes (``SAMPLE``) a rotation of the principal directions
is learned that brings the signs closest to the values: codes of at most ``CODE`` bits, half of them set. A code is cut into tables of as many bits as leave
about ``BUCKET`` vectors a bucket. Vectors whose codes differ in few bits agree in a whole table somewhere; where one code has too few
tables, further rotations from other starts give more. How many are needed is measured, not assumed: for vectors of the sample, partners (of a half that the rotations are not learned on) are made whose
cosine is the threshold itself, in directions of any kind and in those that the data takes, and tables are added until the share ``FOUND`` of
either kind meets (with fewer bits a table if ``TABLES`` do not do; no bits at all compares everything). Every link found is true: vectors that meet are compared by
their cosine in double precision.

Links are counted, never listed. A bucket is met as one matrix; one of more than ``SLAB`` vectors is dealt into slabs, each pair of slabs
a cell for a task of its own. A pair counts in the first table that it shares only. Of a cell come the counts of its vectors and one edge
for each member of a connected group. Counting all links of n near copies takes n * n comparisons; the rows stay linear in cells.

Null, empty and zero vectors, and those with null or non-finite components, link with nothing; so do rows without an id, whose component is
null. Shorter vectors count as filled up with zeros. Each row is a vector by itself, also if its vec_id is repeated: equal rows link with
each other. An empty table gives an empty result. Only the two named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexmill.llm._shared import components, forget, saved

COSINE = 0.9
#: Most vectors of the sample that rotations are learned on, and most numbers that it holds.
SAMPLE, SAMPLE_NUMBERS = 8192, 1 << 22
CODE, BUCKET, TABLES, FOUND = 64, 16, 64, 0.97
ROUNDS = 20
SLAB = 1024


class Tables(NamedTuple):
    """Bit i of a code: unit vector @ directions[:, i] > offsets[i]. Table t reads the bits bits * t to bits * (t + 1)."""

    directions: np.ndarray
    offsets: np.ndarray
    bits: int
    count: int

    def keys(self, units: np.ndarray) -> np.ndarray:
        """The key of every vector in every table."""
        if not self.bits:
            return np.zeros((len(units), 1), np.int64)
        set_bits = units @ self.directions > self.offsets
        return set_bits.reshape(len(units), self.count, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))


def units(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def learned_rotation(projected: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The rotation after which signs approximate values best: signs and rotation are fitted in turn (iterative quantisation)."""
    size = projected.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
    for _ in range(rounds):
        signs = np.where(projected @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ signs)
        rotation = left @ right
    return rotation


def partners(sample: np.ndarray, cosine: float, seed: int = 1) -> list[np.ndarray]:
    """For each unit vector one of exactly this cosine, away in any direction, and away in a direction between two others."""
    rng = np.random.default_rng(seed)
    out = []
    for away in (rng.normal(size=sample.shape), sample[rng.permutation(len(sample))] - sample[rng.permutation(len(sample))]):
        away = away - np.einsum("ij,ij->i", away, sample)[:, None] * sample
        length = np.sqrt(np.einsum("ij,ij->i", away, away))
        some = length > 1e-9
        out.append(np.where(some[:, None], cosine * sample + math.sqrt(max(0.0, 1 - cosine * cosine)) * away / np.where(some, length, 1)[:, None], sample))
    return out


def learn_tables(sample: np.ndarray, rows: int, cosine: float = COSINE, found: float = FOUND, most: int = TABLES) -> Tables:
    """Tables for so many vectors in all: rotations from one half of the unit vectors, their number from what the other half finds."""
    none = Tables(np.zeros((sample.shape[1], 0)), np.zeros(0), 0, 1)
    if len(sample) < 4:
        return none
    fitted, tried = sample[::2], sample[1::2]
    mean = fitted.mean(0)
    _, weight, axes = np.linalg.svd(fitted - mean, full_matrices=False)
    axes = axes[: min(CODE, int((weight > 1e-9 * max(weight[0], 1e-300)).sum()))].T
    if not axes.shape[1]:
        return none
    projected, pairs = (fitted - mean) @ axes, partners(tried, cosine)
    rotations: list[np.ndarray] = []
    for bits in range(max(1, min(axes.shape[1], round(math.log2(max(2.0, rows / BUCKET))))), 0, -1):
        each = axes.shape[1] // bits
        chosen: list[np.ndarray] = []
        missed = np.ones((2, len(tried)), bool)
        while len(chosen) < most and missed.mean(1).max() > 1 - found:
            rotation, table = divmod(len(chosen), each)
            if rotation == len(rotations):
                rotations.append(axes @ learned_rotation(projected, rotation))
            own = rotations[rotation][:, table * bits : (table + 1) * bits]
            here = tried @ own > mean @ own
            missed &= np.array([((p @ own > mean @ own) != here).any(1) for p in pairs])
            chosen.append(own)
        if missed.mean(1).max() <= 1 - found:
            directions = np.concatenate(chosen, 1)
            return Tables(directions, mean @ directions, bits, len(chosen))
    return none


def _rows(column: pa.Array, wide: int, kind: str = "<f8") -> np.ndarray:
    out = np.zeros((len(column), wide))
    for row, raw in zip(out, column, strict=True):
        own = np.frombuffer(raw.as_buffer(), kind)
        row[: len(own)] = own
    return out


def _coded(tables, wide: int, kind: str):
    """(node, copies, packed vector, keys)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(2)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
            full = np.zeros((len(vectors), wide))
            at = np.arange(len(flat)) - np.repeat(np.concatenate(([0], ends[:-1])), np.diff(np.concatenate(([0], ends))))
            full[np.repeat(np.arange(len(vectors)), np.diff(np.concatenate(([0], ends)))), at] = flat
            # An exact change of scale, lest squares leave the range of doubles.
            full = np.ldexp(full, -np.frexp(np.abs(full).max(1))[1][:, None])
            keys = tables.value.keys(units(full))
            packed = [x.tobytes() for x in full.astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "copies", "vector", "keys"])

    return code


def stars(hit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The connected groups of a symmetric matrix of links: one member of each and the others."""
    todo = hit.any(0)
    while todo.any():
        root = int(todo.argmax())
        todo[root] = False
        front, group = np.array([root]), []
        while len(front):
            front = np.flatnonzero(hit[front].any(0) & todo)
            todo[front] = False
            group.append(front)
        yield root, np.concatenate(group)


def _meet(cosine: float, wide: int, kind: str):
    """Of rows (number, key, low, high, slab, node, copies, vector, keys) sorted by the first four, cell by cell: (a, null, links of a) and edges (a, b, 0)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            starts = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]).any(1))))
            if held and [held[-1].column(i)[-1].as_py() for i in range(4)] != cells[0].tolist():
                yield from found(held)
                held = []
            for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield from found([*held, batch.slice(at, end - at)])
                held = []
            held.append(batch.slice(int(starts[-1])))
        if held:
            yield from found(held)

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(p.num_rows for p in parts) < 2:
            return
        cell = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
        number, low, high = (cell.column(i)[0].as_py() for i in (0, 2, 3))
        slab, node, copies = (cell.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
        rows = units(_rows(cell.column(7), wide, kind))
        hit = rows @ rows.T >= cosine
        np.fill_diagonal(hit, False)
        if low != high:
            hit &= slab[:, None] != slab[None, :]
        if not hit.any():
            return
        keys = cell.column(8).flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
        for earlier in range(number):
            hit &= keys[:, earlier, None] != keys[None, :, earlier]
        linked = np.flatnonzero(hit.any(1))
        if not len(linked):
            return
        counts = hit[linked].astype(np.float64) @ copies.astype(np.float64)
        edges = [np.stack((np.full(len(others), node[root]), node[others]), 1) for root, others in stars(hit)]
        edge = np.concatenate(edges)
        a = np.concatenate((node[linked], edge[:, 0]))
        b = pa.array(np.concatenate((np.zeros(len(linked), np.int64), edge[:, 1])), mask=np.arange(len(a)) < len(linked))
        yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate((counts.astype(np.int64), np.zeros(len(edge), np.int64))))], ["a", "b", "n"])

    return meet


def near_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE, slab: int = SLAB, found: float = FOUND) -> DataFrame:
    """id, n_links, component_id and kept for every row."""
    spark = embeddings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = embeddings.schema[vector_column].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    values = F.col(vector_column) if single else F.col(vector_column).cast("array<double>")
    rows = embeddings.select(F.col(id_column).cast("long").alias("id"), values.alias("v"))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.where("usable").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()))
    count, wide = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    size = max(2, min(SAMPLE, SAMPLE_NUMBERS // (wide or 1)))
    spot = F.pmod(F.xxhash64("v"), F.lit(1 << 32))
    sample = classes.where(spot < min(1 << 32, (2 * size << 32) // max(count, 1))).select("v").limit(size).collect()
    known = np.zeros((len(sample), wide or 1))
    for to, r in zip(known, sample, strict=True):
        to[: len(r[0])] = r[0]
    known = np.ldexp(known, -np.frexp(np.abs(known).max(1, initial=0))[1][:, None])
    tables = spark.sparkContext.broadcast(learn_tables(units(known), count, cosine, found))
    packed = "<f4" if single else "<f8"
    coded = saved(classes.select("node", "copies", "v").mapInArrow(_coded(tables, wide or 1, packed), "node long, copies long, vector binary, keys array<long>"))
    full = coded.select(F.posexplode("keys").alias("number", "key")).groupBy("number", "key").count().where(F.col("count") > slab)
    slabs = saved(full.select("number", "key", F.ceil(F.col("count") / slab).cast("int").alias("slabs")))
    each = coded.select("node", "copies", "vector", "keys", F.posexplode("keys").alias("number", "key")).join(slabs, ["number", "key"], "left")
    dealt = each.withColumn("slabs", F.coalesce("slabs", F.lit(1))).withColumn("slab", F.pmod(F.xxhash64("node"), F.col("slabs")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
    cells = met.select("number", "key", F.least("slab", "other").alias("low"), F.greatest("slab", "other").alias("high"), "slab", "node", "copies", "vector", "keys")
    ordered = cells.repartition(parts, "number", "key", "low", "high").sortWithinPartitions("number", "key", "low", "high")
    links = saved(ordered.mapInArrow(_meet(cosine, wide or 1, packed), "a long, b long, n long"))
    forget(coded)
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(links.where("b IS NOT NULL").select("a", "b"))
    labelled = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    final = labelled.join(counts, "node", "left").join(lowest, "component").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("usable").join(final, "v").select("id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).withColumnRenamed("id", id_column)
