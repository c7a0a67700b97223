"""Retrieval quality and significance. Ranked rows are (query, rank, item), gold rows (query, item[, gain])."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Ranked rows with ``hit``; an item that is ranked twice counts at its first rank."""
    first = ranked.groupBy("query", "item").agg(F.min("rank").alias("rank"))
    marked = gold.select("query", "item").distinct().withColumn("hit", F.lit(1))
    return first.join(marked, ["query", "item"], "left").na.fill(0, ["hit"])


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int, empty_recall: float = 1.0) -> DataFrame:
    """recall, precision, reciprocal rank and nDCG at k per query. A query without gold has recall ``empty_recall``."""
    marked = hits(ranked, gold)
    inside = F.col("rank") <= k
    per = marked.groupBy("query").agg(
        F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias("found"), F.count_if(inside).alias("seen"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(inside & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    wanted = gold.groupBy("query").agg(F.count_distinct("item").alias("wanted"))
    both = per.join(wanted, "query", "full").na.fill(0, ["found", "seen", "wanted"]).na.fill(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("wanted").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return both.select(
        "query", F.round(F.when(F.col("wanted") == 0, empty_recall).otherwise(F.col("found") / F.col("wanted")), 6).alias("recall"),
        F.round(F.when(F.col("seen") == 0, 0.0).otherwise(F.col("found") / F.col("seen")), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(F.col("wanted") == 0, 0.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg"),
    )


def graded_ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """nDCG at k of rows (query, rank, gain) with gain 2**g - 1; 0 where nothing has gain."""
    part = F.pow(F.lit(2.0), F.col("gain")) - 1
    dcg = F.sum(F.when(F.col("rank") <= k, part / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    gains = F.slice(F.sort_array(F.collect_list("gain"), asc=False), 1, k)
    rows = ranked.groupBy("query").agg(dcg.alias("dcg"), gains.alias("gains"))
    ideal = F.aggregate(F.zip_with(F.col("gains"), F.sequence(F.lit(1), F.size("gains")), lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("query", F.round(F.when(ideal == 0, 0.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg"))


def set_scores(chosen: Column, gold: Column) -> tuple[Column, Column, Column]:
    """recall (1 without gold), precision (0 without a choice) and F1 of two arrays."""
    both, n, m = F.size(F.array_intersect(chosen, gold)), F.size(F.array_distinct(chosen)), F.size(F.array_distinct(gold))
    recall = F.when(m == 0, 1.0).otherwise(both / m)
    precision = F.when(n == 0, 0.0).otherwise(both / n)
    return recall, precision, F.when(recall + precision == 0, 0.0).otherwise(2 * recall * precision / (recall + precision))


def mcnemar_counts(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Discordant counts and the statistic with continuity correction (null without discordance)."""
    n = rows.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    gap = F.greatest(F.lit(0), F.abs(F.col("only_a") - F.col("only_b")) - 1)
    return n.withColumn("statistic", F.when(F.col("only_a") + F.col("only_b") > 0, F.round(gap * gap / (F.col("only_a") + F.col("only_b")), 6)))


def exact_binomial(one: Column, other: Column) -> Column:
    """The two-sided exact p that two counts come from a fair coin: twice the tail of the smaller, at most 1, and 1 without any.
    Terms are kept as logarithms, each from the one before, so no binomial coefficient leaves the range of doubles."""
    n, least = one + other, F.least(one, other).cast("int")
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("tail"))
    step = lambda s, i: F.struct((s["log"] + F.log((n - i).cast("double") / (i + 1))).alias("log"), (s["tail"] + F.exp(s["log"] - n * math.log(2))).alias("tail"))
    return F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0), least), start, step, lambda s: s["tail"]))


#: Chances that a Poisson count of mean one is at most 0, 1, 2 and so on.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def paired_bootstrap(rows: DataFrame, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """95 % interval of the mean difference a - b, per group; (group, a, b).

    A Poisson bootstrap: in each iteration a row counts 0, 1, 2, ... times by a hash of itself and the iteration, so tasks sum
    what they hold, at most one row an iteration and group of a batch, and no group meets in one task.
    """
    salt = np.arange(1, iterations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, own in batch.groupby("group", dropna=False):
                total, count = np.zeros(iterations), np.zeros(iterations, np.int64)
                for at in range(0, len(own), 1024):
                    part = own.iloc[at : at + 1024]
                    h = part["h"].to_numpy(np.int64).view(np.uint64)[:, None] + salt
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
                    times = np.searchsorted(_POISSON, (h >> np.uint64(11)) / float(1 << 53), "right")
                    total += part["gap"].to_numpy(float) @ times
                    count += times.sum(0)
                yield pd.DataFrame({"group": group, "n": len(own), "gap": own["gap"].sum(), "iteration": np.arange(iterations), "total": total, "count": count})

    gap = (F.col("a") - F.col("b")).cast("double")
    known = rows.select(F.col("group").cast("string").alias("group"), gap.alias("gap"), F.xxhash64(F.lit(seed), "group", "a", "b", F.monotonically_increasing_id()).alias("h")).where("gap IS NOT NULL")
    sums = known.mapInPandas(weigh, "group string, n long, gap double, iteration int, total double, count long").groupBy("group", "iteration").agg(*[F.sum(c).alias(c) for c in ("n", "gap", "total", "count")])
    means = sums.groupBy("group").agg((F.max("gap") / F.max("n")).alias("mean"), F.percentile(F.try_divide("total", "count"), [0.025, 0.975]).alias("p"))
    low, high = F.get("p", 0), F.get("p", 1)
    return means.select("group", "mean", low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).alias("significant"))


def isotonic(rows: DataFrame) -> DataFrame:
    """Pool-adjacent-violators calibration of (group, score, label): one row per block of equal fit. A group meets as one row per distinct score."""

    def fit(sums: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []
        for score, total, count in sums.sort_values("score")[["score", "total", "n"]].itertuples(index=False):
            blocks.append([score, float(total), float(count)])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                last = blocks.pop()
                blocks[-1][1] += last[1]
                blocks[-1][2] += last[2]
        return pd.DataFrame({"group": sums["group"].iloc[0], "from_score": [b[0] for b in blocks], "value": [b[1] / b[2] for b in blocks]})

    sums = rows.groupBy("group", "score").agg(F.sum("label").cast("double").alias("total"), F.count("label").alias("n")).where("n > 0")
    return sums.groupBy("group").applyInPandas(fit, "group string, from_score double, value double")


def fit_temperature(rows: DataFrame, low: int = 5, high: int = 50) -> DataFrame:
    """One row (temperature, loss): the tenth from low to high by which logits (logit, label) are divided for the least log loss.

    Each task sums the losses of its rows for all tenths at once; of equal losses the lowest temperature is taken.
    """
    scaled = rows.where("logit IS NOT NULL AND label IS NOT NULL").withColumn("t", F.explode(F.sequence(F.lit(low), F.lit(high))))
    z = F.col("logit") * 10 / F.col("t")
    loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col("label")
    losses = scaled.groupBy("t").agg(F.round(F.avg(loss), 9).alias("loss"))
    return losses.agg(F.min(F.struct("loss", "t")).alias("best")).select((F.col("best.t") / 10).alias("temperature"), F.col("best.loss").alias("loss"))
