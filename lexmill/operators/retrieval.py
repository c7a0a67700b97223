"""Ranking: lexical and dense arms, fusion, selection. A ranked list is rows (query, rank, item, score)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.functions import lexical as L
from lexmill.sources.shared import saved

RRF_K = 60
#: Vectors of a block of queries, and of points.
QUERY_BLOCK, POINT_BLOCK = 1024, 4096


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered from 1. Spark prunes each task's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, item, tf, len) of every content token."""
    return _counted(docs.select(F.col(key).alias("item"), L.content_tokens(text).alias("t")))


def tokenised(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(item, t) with the content tokens of every item, written: several steps read them, one makes them."""
    return saved(docs.select(F.col(key).alias("item"), L.content_tokens(text).alias("t")))


def _counted(tokens: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(term, item, tf, len); with wanted terms, others are left out before anything is shuffled."""
    every = tokens.select("item", F.size("t").alias("len"), F.explode("t").alias("term"))
    every = every if wanted is None else every.join(wanted, "term", "left_semi")
    return every.groupBy("term", "item").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def term_statistics(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def bm25(tokens: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of all items that share a term with a query; tokens as from ``tokenised``, queries are (query, term).

    The number of items and their mean length are one row, joined. Items are dealt out once, before they are taken apart: their terms are
    counted, weighed and summed where they lie, and of each query a task passes on its best k. Queries are stated, they and their terms' counts are broadcast.
    """
    wanted = queries.distinct()
    dealt = tokens.repartition("item")
    size = tokens.where(F.size("t") > 0).agg(F.count("*").alias("total"), F.avg(F.size("t")).alias("mean"))
    used = _counted(dealt, F.broadcast(wanted.select("term").distinct()))
    idf = F.log1p((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    weighed = used.join(F.broadcast(term_statistics(used)), "term").join(F.broadcast(size)).select("term", "item", weight.alias("w"))
    scored = weighed.join(F.broadcast(wanted), "term").groupBy("query", "item").agg(F.round(F.sum("w"), 9).alias("score"))
    return top_per(scored, ["query"], [F.desc("score"), F.asc("item")], k)


def pool_tf_idf(pool: DataFrame, terms: DataFrame, weight: float = 0.5) -> DataFrame:
    """Inside each query's own pool: tf * ln((n + 1) / df) of the query's terms over 10, at most 1, blended with the old score."""
    n = pool.groupBy("query").agg(F.count_distinct("item").alias("n"))
    hits = pool.select("query", "item", F.explode(L.content_tokens(F.col("text"))).alias("term")).join(terms, ["query", "term"]).groupBy("query", "item", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("query", "term").agg(F.count("*").alias("df"))
    lexical = hits.join(df, ["query", "term"]).join(n, "query").groupBy("query", "item").agg(F.sum(F.col("tf") * F.log((F.col("n") + 1) / F.col("df"))).alias("raw"))
    best = F.least(F.coalesce(F.col("raw"), F.lit(0.0)) / 10, F.lit(1.0))
    return pool.join(lexical, ["query", "item"], "left").withColumn("score", F.round((1 - weight) * F.col("score") + weight * best, 9)).drop("raw", "text")


def term_hits(docs: DataFrame, key: str, text: Column, terms: list[str], k: int) -> DataFrame:
    """Items by how many terms they contain: two at least, one if fewer than three are asked for."""
    hits = sum((F.coalesce(F.lower(text).contains(t.lower()).cast("int"), F.lit(0)) for t in terms), F.lit(0))
    return docs.select(F.col(key).alias("item"), hits.alias("hits")).where(F.col("hits") >= (1 if len(terms) < 3 else 2)).orderBy(F.desc("hits"), "item").limit(k)


def _matrices(rows: DataFrame, item: str, vector: str, block: int) -> tuple[DataFrame, int]:
    """Written blocks (size, b, ids, rows) of unit vectors of one size, as matrices, and into how many parts each size is dealt.
    Vectors that are null or hold nulls take no part; a zero vector stays zero, so its cosines are 0."""
    known = rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())).select(F.col(item).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    parts = max(1, -(-known.count() // block))
    kind = known.schema["id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        vectors = np.array(table.column("v").to_pylist(), np.float64).reshape(table.num_rows, -1)
        length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        units = vectors / np.where(length > 0, length, 1)[:, None]
        ids = pa.array([table.column("id").combine_chunks().to_pylist()], pa.list_(table.schema.field("id").type))
        return pa.table({"size": table.column("size").slice(0, 1), "b": table.column("b").slice(0, 1), "ids": ids, "rows": pa.array([units.tobytes()], pa.binary())})

    dealt = known.withColumn("size", F.size("v")).withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"))
    return saved(dealt.groupBy("size", "b").applyInArrow(pack, f"size int, b int, ids array<{kind}>, rows binary")), parts


def cosine_topk(points: DataFrame, queries: DataFrame, k: int | None, threshold: float = -1.0) -> DataFrame:
    """Exact cosine of stated queries (query, q) against all points (item, v) of their size; without k all hits, unranked.

    Queries and points are packed into matrices of unit vectors, norms once a vector; each pair of blocks is one product, of which a query passes on its
    best k, or all hits over the threshold, which are then as many as there are. Scores are rounded to nine places.
    """
    asked, _ = _matrices(queries, "query", "q", QUERY_BLOCK)
    known, parts = _matrices(points, "item", "v", POINT_BLOCK)
    q_kind, i_kind = asked.schema["ids"].dataType.elementType, known.schema["ids"].dataType.elementType

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, queries_, own, items, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(x, np.float64).reshape(-1, size) if size else np.zeros((len(ids), 0)) for x, ids in ((own, queries_), (rows, items)))
                scores = np.round(a @ b.T, 9)
                if k is not None and k < len(items):
                    # All that tie with the k-th go on; a window breaks ties by item.
                    least = np.maximum(np.partition(scores, len(items) - k, axis=1)[:, len(items) - k], threshold)
                else:
                    least = np.full(len(queries_), threshold)
                i, j = np.nonzero(scores >= least[:, None])
                columns = [pa.array([queries_[x] for x in i.tolist()], to_arrow_type(q_kind)), pa.array([items[x] for x in j.tolist()], to_arrow_type(i_kind)), pa.array(scores[i, j])]
                yield pa.RecordBatch.from_arrays(columns, ["query", "item", "score"])

    cells = asked.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(known.select("size", F.col("b").alias("p"), F.col("ids").alias("items"), F.col("rows").alias("points")), ["size", "p"])
    hits = cells.select("size", "ids", "rows", "items", "points").mapInArrow(meet, f"query {q_kind.simpleString()}, item {i_kind.simpleString()}, score double")
    return hits if k is None else top_per(hits, ["query"], [F.desc("score"), F.asc("item")], k)


def rrf(lists: DataFrame, k: int = RRF_K, weight: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion of rows (query, arm, rank, item); ranks count from 1. A repeated item in one arm adds up."""
    part = 1 / (F.col("rank") + k)
    part = part if weight is None else part * weight
    fused = lists.where(F.col("item").isNotNull()).groupBy("query", "item").agg(F.round(F.sum(part), 12).alias("score"))
    return fused


def priority_fusion(lists: DataFrame, priority: Column, top: int, k: int = RRF_K) -> DataFrame:
    """Each list's reciprocal ranks times its priority; of repeated items the best stays."""
    scored = lists.withColumn("score", F.round(priority / (F.col("rank") + k), 12))
    best = top_per(scored.drop("rank"), ["query", "item"], [F.desc("score"), F.asc("arm")], 1).drop("rank")
    return top_per(best, ["query"], [F.desc("score"), F.asc("item")], top)


def protected_fusion(base: DataFrame, other: DataFrame, protect: int, top: int, k: int = RRF_K) -> DataFrame:
    """The first ``protect`` of the base list stay ahead; the other list and the rest of the base fill up, distinct."""
    a = base.select("query", "item", F.when(F.col("rank") <= protect, 0).otherwise(2).alias("tier"), "rank")
    b = other.select("query", "item", F.lit(1).alias("tier"), "rank")
    first = top_per(a.unionByName(b).withColumnRenamed("rank", "was"), ["query", "item"], [F.asc("tier"), F.asc("was")], 1).drop("rank")
    placed = top_per(first, ["query"], [F.asc("tier"), F.asc("was"), F.asc("item")], top)
    return placed.select("query", "item", "rank", F.round(1 / (F.col("rank") + k), 12).alias("score"))


def promote_primary(ranked: DataFrame, primary: Column) -> DataFrame:
    """The best row of the primary kind becomes the first; the others keep their order."""
    w = Window.partitionBy("query")
    marked = ranked.withColumn("_p", F.when(primary, F.col("rank")))
    best = F.min("_p").over(w)
    order = F.when(F.col("rank") == best, 0).otherwise(F.col("rank"))
    return marked.withColumn("rank", F.row_number().over(w.orderBy(order))).drop("_p")


def keep_best(df: DataFrame, by: list[str]) -> DataFrame:
    """The highest score of each item; equal scores by the order of all columns."""
    return top_per(df, by, [F.desc("score"), *[F.asc(c) for c in df.columns if c not in by and c != "score"]], 1).drop("rank")


def quota_merge(groups: DataFrame, top: int) -> DataFrame:
    """Rows (group, item, score): an equal quota of each group's best, distinct, then the best of what is left."""
    n = groups.agg(F.count_distinct("group").alias("n"))
    own = groups.withColumn("_r", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "item"))).join(F.broadcast(n))
    quota = F.greatest(F.lit(1), F.floor(F.lit(top) / F.col("n")))
    tiered = own.withColumn("_late", (F.col("_r") > quota).cast("int"))
    once = top_per(tiered, ["item"], [F.asc("_late"), F.desc("score"), F.asc("group")], 1).drop("rank")
    return once.orderBy("_late", F.desc("score"), "item").limit(top).select("group", "item", "score")


def diverse_first(ranked: DataFrame, section: str, k: int) -> DataFrame:
    """The best of each section first, then by score."""
    first = F.row_number().over(Window.partitionBy("query", section).orderBy(F.desc("score"), "item"))
    return top_per(ranked.withColumn("_n", first).drop("rank"), ["query"], [F.asc(F.col("_n") > 1), F.desc("score"), F.asc("item")], k).drop("_n")


def minmax_by(df: DataFrame, by: list[str], score: str, constant: float) -> Column:
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(constant)).otherwise((F.col(score) - low) / (high - low))


def _per_query(df: DataFrame, schema: str, pick: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Sequential choice inside one query's pool, which the caller has cut to a bounded head."""
    return df.groupBy("query").applyInPandas(pick, schema)


def _within(pool: DataFrame, k: int, slack: float) -> DataFrame:
    """Rows whose score is at most ``slack`` under the k-th best of their query. Of the k best one is always left to choose, so where other terms are worth no
    more than the slack, no other row can ever be chosen before it."""
    least = top_per(pool.select("query", "item", "score"), ["query"], [F.desc("score"), F.asc("item")], k).where(F.col("rank") == k).select("query", (F.col("score") - slack - 1e-9).alias("_least"))
    return pool.join(least, "query", "left").where(F.col("_least").isNull() | (F.col("score") >= F.col("_least"))).drop("_least")


def mmr(pool: DataFrame, k: int, balance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over (query, item, score, tokens): relevance against the most similar one chosen, by Jaccard."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "item"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(t) for t in rows["tokens"]]
        chosen: list[int] = []
        worst = [0.0] * len(rows)
        while len(chosen) < min(k, len(rows)):
            best = max((i for i in range(len(rows)) if i not in chosen), key=lambda i: (balance * rows["score"][i] - (1 - balance) * worst[i], -i))
            chosen.append(best)
            for i in range(len(rows)):
                union = len(sets[i] | sets[best])
                worst[i] = max(worst[i], len(sets[i] & sets[best]) / union if union else 0.0)
        return pd.DataFrame({"query": rows["query"][chosen], "item": rows["item"][chosen], "rank": range(1, len(chosen) + 1)})

    cut = _within(pool, k, (1 - balance) / balance).select("query", "item", "score", "tokens")
    return _per_query(cut, "query long, item long, rank int", pick)


def evidence_set(pool: DataFrame, most: int, least: int) -> DataFrame:
    """Greedy choice over (query, item, score, type_rank, tokens): 0.6 score + 0.02 type + 0.2 new tokens - 0.3 redundancy.

    The best starts; items over 0.9 redundant are passed over once ``least`` are chosen; the set is filled up to ``least``. Any item of the
    pool may come up in the end, so a query's whole pool, what retrieval left of it, is looked at.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "item"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(t) for t in rows["tokens"]]
        chosen, held = [0], set(sets[0])
        left = list(range(1, len(rows)))
        while left and len(chosen) < most:
            new = {i: len(sets[i] - held) / len(sets[i]) if sets[i] else 0.0 for i in left}
            best = max(left, key=lambda i: (0.6 * rows["score"][i] + 0.02 * rows["type_rank"][i] + 0.2 * new[i] - 0.3 * (1 - new[i]), -i))
            left.remove(best)
            if 1 - new[best] > 0.9 and len(chosen) >= least:
                continue
            chosen.append(best)
            held |= sets[best]
        return pd.DataFrame({"query": rows["query"][chosen], "item": rows["item"][chosen], "rank": range(1, len(chosen) + 1)})

    return _per_query(pool.select("query", "item", "score", "type_rank", "tokens"), "query long, item long, rank int", pick)


def with_family(pool: DataFrame, k: int, bonus: float = 0.2) -> DataFrame:
    """Prefers parents and children (by section prefix) of what is chosen: (query, item, score, section)."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "item"], ascending=[False, True]).reset_index(drop=True)
        chosen: list[int] = []
        kin = lambda a, b: a != b and (a.startswith(b) or b.startswith(a))
        while len(chosen) < min(k, len(rows)):
            best = max((i for i in range(len(rows)) if i not in chosen), key=lambda i: (rows["score"][i] + bonus * any(kin(rows["section"][i], rows["section"][c]) for c in chosen), -i))
            chosen.append(best)
        return pd.DataFrame({"query": rows["query"][chosen], "item": rows["item"][chosen], "rank": range(1, len(chosen) + 1)})

    cut = _within(pool, k, bonus).select("query", "item", "score", "section")
    return _per_query(cut, "query long, item long, rank int", pick)
