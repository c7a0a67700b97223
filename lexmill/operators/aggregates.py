"""Grouped counts and sums as dashboards need them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def counts_with_total(df: DataFrame, key: str, total: str = "TOTAL") -> DataFrame:
    """Count by key and the grand total, in one pass over the rows."""
    grouped = df.rollup(key).agg(F.count("*").alias("n"), F.grouping(key).alias("_all"))
    return grouped.select(F.when(F.col("_all") == 1, total).otherwise(F.col(key).cast("string")).alias(key), "n")


def sums_with_total(df: DataFrame, key: Column, value: Column, total: str = "TOTAL", other: str = "Other") -> DataFrame:
    """Count and sum by type (empty or null: other), with the grand total."""
    kind = F.coalesce(F.nullif(key, F.lit("")), F.lit(other))
    grouped = df.select(kind.alias("kind"), value.alias("value")).rollup("kind").agg(F.count("*").alias("n"), F.sum("value").alias("amount"), F.grouping("kind").alias("_all"))
    return grouped.select(F.when(F.col("_all") == 1, total).otherwise(F.col("kind")).alias("kind"), "n", "amount")


def flag_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row per flag with how many rows have it, from a single aggregate."""
    row = df.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    return row.unpivot([], list(flags), "flag", "n")


def top_groups(df: DataFrame, key: str, limit: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(limit)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()])


def tag_cloud(df: DataFrame, tags: Column) -> DataFrame:
    """Counts of comma-separated, trimmed tags."""
    return df.select(F.explode(F.split(tags, ",")).alias("tag")).select(F.trim("tag").alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def concentration(df: DataFrame, key: str) -> DataFrame:
    """Herfindahl index of the groups' shares."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.round(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 6).alias("hhi"))


def severity_score(df: DataFrame, key: str, severity: Column, per_error: float, per_warning: float, grades: list[tuple[float, str]]) -> DataFrame:
    """Findings by severity, a score from 100 down, and the first grade whose threshold it reaches."""
    counted = df.groupBy(key).agg(F.count_if(severity == "error").alias("errors"), F.count_if(severity == "warning").alias("warnings"), F.count("*").alias("findings"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - per_error * F.col("errors") - per_warning * F.col("warnings")))
    scored = counted.withColumn("score", score)
    grade = F.lit(grades[-1][1])
    for least, name in reversed(grades[:-1]):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return scored.withColumn("grade", grade)


def confusion(df: DataFrame, truth: Column, score: Column, threshold: float) -> DataFrame:
    said = score >= threshold
    return df.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(tp == 0, 0.0).otherwise((1 + b) * tp / ((1 + b) * tp + b * fn + fp))


def means_by(df: DataFrame, key: Column, metrics: list[str], digits: int = 4) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in metrics])
