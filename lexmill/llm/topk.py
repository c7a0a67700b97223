"""Exact top-k inner products by score-at-a-time over an impact-ordered index.

Vectors become whole numbers, floor(scale * x), and are dealt into blocks, those of greater norm into earlier ones. Each
block is indexed once: its postings (component, vector, value) are grouped by quantised impact, the bit length of
the magnitude, whole levels at a time into segments of descending impact, and written, with the norm of what of each
vector the later segments hold.

A block of queries takes a block's segments in order. After each segment every score is known up to
norm(query) * norm(what of the vector is unprocessed), by Cauchy and Schwarz; the k-th best lower bound rules out every
vector whose upper bound is less. The bound of the first block, which has the greatest norms, is carried to all others:
a block that cannot reach it is not even sent to those queries. Processing stops when the proof leaves few possible
members, and these are rescored exactly; without a proof it goes on to the last segment, where all scores are exact.
For each block the best k a query return, and a window keeps the best k of all. A segment is accumulated as one product
of dense arrays, as wide as the block, since single postings are slower in numpy.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as filled up with
zeros. A repeated vec_id is a candidate as often as it occurs, but never for a query of its own id. Ties go to the
smaller vec_id. With fewer than k candidates all are returned; an empty table gives an empty result. Only the two named
columns are read.

Scores of the index are 64-bit. Vectors with components so large that a product could exceed that do not enter it: what they take part in is
scored in whole numbers of any length, block against block, and ranked together with the rest. Such a score that is no 64-bit number is
returned as the nearest one; its rank is exact. A table of such vectors alone is a plain product in Python's numbers, about a thousand times slower.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm._shared import saved

SCALE, K, EVERY = 64, 20, 20
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: Classes of norms, from which blocks are filled in descending order.
NORM_CLASSES = 8
#: Least share of a block's postings in a segment; levels are joined until they have it.
LEAST_SEGMENT = 0.25
#: Possible members per query at which processing stops, as a multiple of k.
FEW = 4
#: Vectors of a block that is scored in numbers of any length.
LARGE_BLOCK = 256
_BLOCK = "block int, top double, ids binary, norms binary, segments array<struct<positions:binary,components:binary,values:binary,width:int,rest:binary>>"
_QUERIES = "q int, length double, ids binary, matrix binary"


def whole_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<bigint>, raw array<double>) of the vectors that take part; raw only where v would not be exact, null elsewhere."""
    usable = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform(vector_column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    doubles = F.col(vector_column).cast("array<double>")
    large = F.exists(doubles, lambda x: F.abs(x) * scale >= float(1 << 52))
    kept = embeddings.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).where(usable)
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), F.when(large, doubles).alias("raw"))


class Segment(NamedTuple):
    """Postings of some impact levels, and of every vector the norm of what lower levels hold, rounded up."""

    positions: np.ndarray
    components: np.ndarray
    values: np.ndarray
    rest: np.ndarray


def impact_segments(matrix: np.ndarray, least: float = LEAST_SEGMENT) -> list[Segment]:
    """The non-zero postings of a block by descending impact level."""
    at, component = np.nonzero(matrix)
    value = matrix[at, component]
    level = np.frexp(np.abs(value).astype(np.float64))[1]
    order = np.lexsort((at, component, -level))
    at, component, value, level = at[order], component[order], value[order], level[order]
    ends = np.append(np.flatnonzero(level[1:] != level[:-1]) + 1, len(level)) if len(level) else []
    left, low, out = (matrix.astype(np.float64) ** 2).sum(1), 0, []
    for end in ends:
        if end - low >= least * len(level) or end == len(level):
            own = slice(low, end)
            left -= np.bincount(at[own], value[own].astype(np.float64) ** 2, len(matrix))
            rest = np.sqrt(np.maximum(left, 0) + 1e-9 * (matrix.astype(np.float64) ** 2).sum(1)) * (1 + 1e-6) if end < len(level) else np.zeros(len(matrix))
            out.append(Segment(at[own].astype(np.uint32), component[own].astype(np.uint32), value[own], np.nextafter(rest.astype(np.float32), np.float32(np.inf)) if end < len(level) else rest.astype(np.float32)))
            low = end
    return out


def _dense(rows: list[list[int]]) -> np.ndarray:
    matrix = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for row, v in zip(matrix, rows, strict=True):
        row[: len(v)] = v
    return matrix


def _pack(table: pa.Table) -> pa.Table:
    """The index of one block."""
    matrix = _dense(table.column("v").to_pylist())
    narrow = not matrix.size or np.abs(matrix).max() < 1 << 15
    segments = [{"positions": s.positions.tobytes(), "components": s.components.astype(np.uint16 if matrix.shape[1] < 1 << 16 else np.uint32).tobytes(), "values": s.values.astype(np.int16 if narrow else np.int64).tobytes(), "width": 2 if narrow else 8, "rest": s.rest.tobytes()} for s in impact_segments(matrix)]
    norms = np.sqrt((matrix.astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)
    kinds = pa.list_(pa.struct([("positions", pa.binary()), ("components", pa.binary()), ("values", pa.binary()), ("width", pa.int32()), ("rest", pa.binary())]))
    ids = np.array(table.column("vec_id").to_pylist(), np.int64)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "top": pa.array([float(norms.max(initial=0))]), "ids": pa.array([ids.tobytes()], pa.binary()), "norms": pa.array([norms.tobytes()], pa.binary()), "segments": pa.array([segments], kinds)})


def _pack_queries(table: pa.Table) -> pa.Table:
    matrix = _dense(table.column("v").to_pylist())
    ids = np.array(table.column("vec_id").to_pylist(), np.int64)
    length = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(1)).max(initial=0))
    return pa.table({"q": pa.array([table.column("q")[0].as_py()], pa.int32()), "length": pa.array([length]), "ids": pa.array([ids.tobytes()], pa.binary()), "matrix": pa.array([matrix.tobytes()], pa.binary())})


def _spot(parts: Column) -> Column:
    """A row's part: of repeated ids each row by itself."""
    return F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), parts)


def build_index(vectors: DataFrame, rows: int = CANDIDATE_BLOCK, classes: int = NORM_CLASSES) -> tuple[DataFrame, int]:
    """The written index of (vec_id, v), and its number of blocks. Block 0 is among those of the greatest norms."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    normed = vectors.select("vec_id", "v", norm.alias("norm"))
    cuts = sorted(set(normed.agg(F.percentile_approx("norm", [i / classes for i in range(1, classes)], 1000)).first()[0] or []), reverse=True)
    kind = F.lit(0)
    for cut in cuts:
        kind = kind + (F.col("norm") < cut).cast("int")
    classed = normed.withColumn("kind", kind)
    first, parts, at = {}, {}, 0
    for number, count in sorted(map(tuple, classed.groupBy("kind").count().collect())):
        first[number], parts[number] = at, max(1, math.ceil(count / rows))
        at += parts[number]
    if not at:
        return saved(vectors.sparkSession.createDataFrame([], _BLOCK)), 0
    known = lambda of: F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("kind"))
    numbered = classed.select("vec_id", "v", (known(first) + _spot(known(parts))).cast("int").alias("block"))
    return saved(numbered.groupBy("block").applyInArrow(_pack, _BLOCK)), at


def score_at_a_time(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, norms: np.ndarray, segments: list[Segment], k: int, bars: np.ndarray | None = None) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, int]:
    """For each query its best k of the block (query id, vector ids, exact scores), its k-th best score or bar so far, and the postings read.

    bars: scores below which nothing is asked for.
    """
    wide = max([queries.shape[1], *(int(s.components.max(initial=0)) + 1 for s in segments)])
    queries = np.pad(queries, ((0, 0), (0, wide - queries.shape[1])))
    most = int(np.abs(queries).max(initial=0)) * max((int(np.abs(s.values).max(initial=0)) for s in segments), default=0) * max(wide, 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    real = np.float32 if kind is np.float32 else np.float64
    bar = np.full(len(queries), -np.inf) if bars is None else bars.astype(np.float64)
    q, q_norm = queries.astype(kind), np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)
    own = query_ids[:, None] == ids[None, :]
    score = np.zeros((len(queries), len(ids)), kind)
    read, few, exact = 0, max(FEW * k, 1), not segments
    possible = ~own
    if not (q_norm * norms.max(initial=0) + 1 >= bar).any():
        possible[:] = False
        segments = []

    def bounded(slack) -> np.ndarray:
        return ~own & (score + slack + (0 if exact else 1) >= bar[:, None])

    def raised(slack) -> np.ndarray:
        """Bars by the k-th best lower bound."""
        if len(ids) < k:
            return bar
        return np.maximum(bar, np.partition(np.where(own, -np.inf, score - slack), len(ids) - k, axis=1)[:, len(ids) - k])

    few_enough = few * len(queries)
    some = slice(None, None, max(1, len(ids) // 128))
    for s in segments:
        dense = np.zeros((len(ids), wide), kind)
        dense[s.positions, s.components] = s.values
        score += q @ dense.T
        read += len(s.values)
        exact = s is segments[-1]
        if exact:
            possible = bounded(0)
            if possible.sum() > 4 * few_enough:
                bar = raised(0)
                possible = bounded(0)
            break
        # Bounds cost as much as the product: with bars from an earlier block they are taken of all vectors only if some show that it pays.
        if bars is not None and (score[:, some] + np.multiply.outer(q_norm, s.rest[some]) + 1 >= bar[:, None]).mean() * len(ids) > 4 * few:
            continue
        slack = (np.multiply.outer(q_norm, s.rest) * (1 + 1e-6)).astype(real)
        bar = raised(slack)
        possible = bounded(slack)
        if possible.sum() <= few_enough:
            break
    found, ended = [], bar.copy()
    for i, query_id in enumerate(query_ids.tolist()):
        at = np.flatnonzero(possible[i])
        if exact:
            full = score[i, at].astype(np.int64)
        else:
            place = np.full(len(ids), -1)
            place[at] = np.arange(len(at))
            full = np.zeros(len(at), np.int64)
            for s in segments:
                to = place[s.positions]
                use = to >= 0
                np.add.at(full, to[use], s.values[use].astype(np.int64) * queries[i, s.components[use]])
        best = np.lexsort((ids[at], -full))[:k]
        found.append((query_id, ids[at[best]], full[best]))
        if len(best) == k:
            ended[i] = max(ended[i], float(np.nextafter(float(full[best[-1]]), -np.inf)) if abs(int(full[best[-1]])) >= 1 << 53 else full[best[-1]])
    return found, ended, read


def _unpacked(segments: list[dict]) -> list[Segment]:
    return [Segment(np.frombuffer(s["positions"], np.uint32), np.frombuffer(s["components"], np.uint16 if len(s["components"]) * 2 == len(s["positions"]) else np.uint32), np.frombuffer(s["values"], np.int16 if s["width"] == 2 else np.int64), np.frombuffer(s["rest"], np.float32)) for s in segments]


def _search(k: int):
    """Of cells (q, bars, query ids, query matrix, ids, norms, segments): q, the bars after it, and what was found."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, bars, qi, qm, ci, cn, segments = (batch.column(j)[i].as_py() for j in range(7))
                query_ids, ids = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                queries = np.frombuffer(qm, np.int64).reshape(len(query_ids), -1)
                found, ended, _ = score_at_a_time(queries, query_ids, ids, np.frombuffer(cn, np.float64), _unpacked(segments), k, None if bars is None else np.frombuffer(bars, np.float64))
                rows = [{"query_id": x, "vec_id": v, "score": s} for x, vs, ss in found for v, s in zip(vs.tolist(), ss.tolist(), strict=True)]
                kind = pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([ended.tobytes()], pa.binary()), pa.array([float(ended.min(initial=np.inf))]), pa.array([rows], kind)], ["q", "bars", "bar", "found"])

    return search


_FOUND = "q int, bars binary, bar double, found array<struct<query_id:long,vec_id:long,score:long>>"


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    return int(x) * scale if abs(x) >= 1 << 53 else math.floor(scale * x)


def _key(score: int) -> str:
    """Text that sorts as the numbers do."""
    digits = str(abs(score))
    return f"1{len(digits):05d}{digits}" if score >= 0 else f"0{99999 - len(digits):05d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _key_column(score: Column) -> Column:
    digits = F.regexp_replace(score.cast("string"), "-", "")
    above = F.concat(F.lit("1"), F.lpad(F.length(digits).cast("string"), 5, "0"), digits)
    below = F.concat(F.lit("0"), F.lpad((99999 - F.length(digits)).cast("string"), 5, "0"), F.translate(digits, "0123456789", "9876543210"))
    return F.when(score >= 0, above).otherwise(below)


def _any_length(k: int, scale: int):
    """(query_id, vec_id, score, key) of cells (queries, candidates) of arrays (vec_id, v, raw, large); pairs without a large vector are left out."""
    most, least = (1 << 63) - 1, -(1 << 63)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda r: [whole(x, scale) for x in r["raw"]] if r["raw"] is not None else r["v"]
        for batch in batches:
            for queries, candidates in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = [(c["vec_id"], numbers(c), c["large"]) for c in candidates]
                rows = []
                for q in queries:
                    own = numbers(q)
                    found = sorted(((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v, large in known if i != q["vec_id"] and (large or q["large"])))[:k]
                    rows += [(q["vec_id"], i, max(least, min(most, -s)), _key(-s)) for s, i in found]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score", "key"])

    return score


def _large_pairs(vectors: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    """The best k of every query among the pairs that hold a large vector: large queries meet all vectors, the other queries large ones."""

    def blocks(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        count = max(1, math.ceil(rows.count() / LARGE_BLOCK))
        dealt = rows.withColumn(name, _spot(F.lit(count)).cast("int"))
        return saved(dealt.groupBy(name).agg(F.collect_list(F.struct("vec_id", "v", "raw", "large")).alias(f"{name}s"))), count

    parts = []
    for asked, known in ((queries.where("large"), vectors), (queries.where("NOT large"), vectors.where("large"))):
        (q, _), (c, count) = blocks(asked, "q"), blocks(known, "c")
        parts.append(q.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(c, "c").select("qs", "cs").mapInArrow(_any_length(k, scale), "query_id long, vec_id long, score long, key string"))
    return parts[0].union(parts[1])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of queries its k best of all vectors but its own id.

    Both have (vec_id, v, raw) as from whole_vectors; raw may be left out.
    """
    wide = max(1, *[df.agg(F.max(F.size("v"))).first()[0] or 0 for df in (vectors, queries)])
    limit = math.isqrt(((1 << 63) - 1) // wide)
    large = F.col("raw").isNotNull() | F.exists("v", lambda x: (x > limit) | (x < -limit))
    vectors, queries = ((df if "raw" in df.columns else df.withColumn("raw", F.lit(None).cast("array<double>"))).withColumn("large", large) for df in (vectors, queries))
    small = _indexed(vectors.where("NOT large").select("vec_id", "v"), queries.where("NOT large").select("vec_id", "v"), k)
    if vectors.union(queries).where("large").isEmpty():
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return small.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    every = small.withColumn("key", _key_column(F.col("score"))).unionByName(_large_pairs(vectors, queries, k, scale))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _indexed(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of every query in each block that may hold one of its best k, by the index."""
    asked = queries.count()
    blocks, count = build_index(vectors)
    parts = max(1, math.ceil(asked / QUERY_BLOCK))
    query_blocks = saved(queries.select("vec_id", "v", _spot(F.lit(parts)).cast("int").alias("q")).groupBy("q").applyInArrow(_pack_queries, _QUERIES))
    right = query_blocks.select("q", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    cell = ["q", "bars", "q_ids", "q_matrix", "ids", "norms", "segments"]
    # The first block sets a bar for every query; a pair of blocks that cannot reach it is left out before it is sent.
    seeds = saved(right.withColumn("block", F.lit(0)).join(blocks.where("block = 0"), "block").withColumn("bars", F.lit(None).cast("binary")).select(*cell).mapInArrow(_search(k), _FOUND))
    asks = query_blocks.select("q", "length").join(seeds.select("q", "bar"), "q")
    numbers = F.explode(F.sequence(F.lit(1), F.lit(count - 1))) if count > 1 else F.explode(F.array().cast("array<int>"))
    pairs = asks.withColumn("block", numbers).join(blocks.select("block", "top"), "block").where(F.col("length") * F.col("top") * (1 + 1e-5) + 1 >= F.col("bar")).select("block", "q")
    cells = pairs.join(blocks, "block").join(right.join(seeds.select("q", "bars"), "q"), "q").select(*cell)
    return seeds.select("found").union(cells.mapInArrow(_search(k), _FOUND).select("found")).select(F.inline("found"))


def top_k_table(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    vectors = saved(whole_vectors(embeddings))
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}"""
