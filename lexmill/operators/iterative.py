"""Retrieval in rounds: queries whose evidence lacks a kind that they need are asked again for that kind, all of them at once.

A round fetches for the queries that are still open only. What they find joins their pools, where of a repeated item the best score stays; the
pool is cut to its best, evidence is selected, and queries that are covered well enough, or lack nothing, or were asked in the last round, leave
with what they have. Each round is written before the next reads it, so plans do not grow with rounds, and there are no more than stated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.retrieval import top_per
from lexmill.sources.shared import saved


def _best(pool: DataFrame, top_k: int) -> DataFrame:
    """(query, item, kind, score): of each item the best row, of each query the best items."""
    once = pool.groupBy("query", "item").agg(F.max_by("kind", "score").alias("kind"), F.max("score").alias("score"))
    return top_per(once, ["query"], [F.desc("score"), F.asc("item")], top_k).drop("rank")


def selected(pool: DataFrame, most: int) -> DataFrame:
    """Evidence of each query: the best item of every kind first, then the rest by score; place counts from 1."""
    first = F.row_number().over(Window.partitionBy("query", "kind").orderBy(F.desc("score"), "item"))
    ranked = pool.withColumn("_again", (first > 1).cast("int"))
    return top_per(ranked, ["query"], [F.asc("_again"), F.desc("score"), F.asc("item")], most).withColumnRenamed("rank", "place").drop("_again")


def _covered(evidence: DataFrame, required: DataFrame) -> DataFrame:
    """(query, coverage, missing): the share of required kinds that the evidence has, and the first that it lacks, by priority."""
    have = evidence.select("query", "kind").distinct().withColumn("_have", F.lit(1))
    met = required.join(have, ["query", "kind"], "left")
    return met.groupBy("query").agg((F.count("_have") / F.count("*")).alias("coverage"), F.min_by("kind", F.when(F.col("_have").isNull(), F.struct("priority", "kind"))).alias("missing"))


def iterate(
    queries: DataFrame, required: DataFrame, gap_terms: DataFrame, fetch: Callable[[DataFrame], DataFrame],
    rounds: int = 3, least_coverage: float = 0.7, top_k: int = 20, most: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Evidence (query, item, kind, score, place) and a report (query, rounds, coverage, gaps) of queries (query, term).

    required is (query, kind, priority), one row a kind; a query without any is covered. gap_terms (kind, term) are added to a query's own when a kind is
    asked for. fetch takes rows (query, term) and gives (query, item, kind, score). Queries that find nothing stay open until the last round.
    """
    every = saved(queries.select("query").distinct())
    required = saved(required.join(every, "query", "left_semi"))
    pool = saved(_best(fetch(queries), top_k))
    state = every.select("query", F.lit(1).alias("rounds"), F.array().cast("array<string>").alias("gaps"))
    finished: list[tuple[DataFrame, DataFrame]] = []
    for number in range(1, rounds + 1):
        evidence = saved(selected(pool, most))
        report = saved(state.join(_covered(evidence, required), "query", "left").withColumn("coverage", F.coalesce("coverage", F.lit(1.0))))
        going = report.where((F.col("coverage") < least_coverage) & F.col("missing").isNotNull()) if number < rounds else report.limit(0)
        going = saved(going)
        done = report.join(going, "query", "left_anti")
        finished.append((evidence.join(done, "query", "left_semi"), done.select("query", "rounds", "coverage", "gaps")))
        if going.isEmpty():
            break
        asked = going.select("query", F.col("missing").alias("kind"))
        again = queries.join(asked, "query", "left_semi").select("query", "term").union(asked.join(gap_terms, "kind").select("query", "term")).distinct()
        pool = saved(_best(pool.join(asked, "query", "left_semi").unionByName(fetch(again).select("query", "item", "kind", "score")), top_k))
        state = going.select("query", F.lit(number + 1).alias("rounds"), F.concat("gaps", F.array("missing")).alias("gaps"))
    both = [reduce(DataFrame.unionByName, parts) for parts in zip(*finished, strict=True)]
    return both[0], both[1]
