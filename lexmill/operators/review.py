"""Contradictions inside a pool of evidence, robust choices, fields with several sources, and reviews of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Amounts, percentages, and the wording of prohibition and permission.
AMOUNT = r"(?i)\b(Rs\.|₹|INR)\s*([\d,]+(?:\.\d+)?)"
PERCENT = r"\b(\d+(?:\.\d+)?)\s*%"
PROHIBITS = r"(?i)\b(?:no person shall|shall not\s+(?:\w+\s+){0,3}?(?:be\s+)?(?:added|sold|used|manufactured|imported)|prohibited)\b"
PERMITS = r"(?i)\b(?:may\s+(?:be\s+)?(?:added|sold|used|manufactured|imported|permitted)|shall be permitted|is permitted|are permitted|allowed)\b"
FORM = r"\bForm\s+([A-Z]{1,3}-?\d*|\d+[A-Z]?)\b"
STEP = r"(?m)^\s*\d+[.)]\s*(.+)$"


def asserted_values(text: Column) -> Column:
    """Different amounts (with their currency) and percentages of a text, amounts first, in order."""
    amounts = F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), lambda m: F.concat(F.regexp_extract(m, AMOUNT, 1), F.regexp_extract(m, AMOUNT, 2)))
    return F.array_distinct(F.concat(amounts, F.regexp_extract_all(text, F.lit(PERCENT), F.lit(1))))


def contradictions(pool: DataFrame) -> DataFrame:
    """(query, section, a, b, kind, values) of rows (query, item, section, text): pairs about one section of one query's pool that assert no common value, or
    of which the earlier item prohibits and the later permits. Items without a section contradict nothing; values are the first four of both.

    Pools are what retrieval left of a query, a few rows each; for whole corpora ``joins.conflicts`` counts without pairs.
    """
    text = F.coalesce("text", F.lit(""))
    own = pool.where(F.col("section").isNotNull()).select("query", "section", "item", asserted_values(text).alias("v"), text.rlike(PROHIBITS).alias("no"), text.rlike(PERMITS).alias("yes"))
    # Rows that assert nothing, prohibit nothing and permit nothing meet nobody.
    own = own.where((F.size("v") > 0) | F.col("no") | F.col("yes"))
    other = own.select("query", "section", F.col("item").alias("b"), F.col("v").alias("w"), F.col("yes").alias("permits"))
    met = own.withColumnRenamed("item", "a").join(other, ["query", "section"]).where("a < b")
    numeric = (F.size("v") > 0) & (F.size("w") > 0) & ~F.arrays_overlap("v", "w")
    kind = F.when(numeric, "numeric").when(F.col("no") & F.col("permits"), "prohibition")
    values = F.when(numeric, F.slice(F.array_sort(F.array_union("v", "w")), 1, 4)).otherwise(F.array().cast("array<string>"))
    return met.select("query", "section", "a", "b", kind.alias("kind"), values.alias("values")).where("kind IS NOT NULL")


def robust_levels(payoffs: DataFrame, profiles: DataFrame, fragility: float, optionality: float) -> DataFrame:
    """(level, answer, maximin, optionality, robust) of payoffs (level, answer, place, value) and profiles (level, reversibility, information): the other side's
    best answer takes the least value, the earlier of equal ones; convexity is reversibility * information less fragility * (1 - reversibility)."""
    worst = payoffs.groupBy("level").agg(F.min_by(F.struct("answer", "value"), F.struct("value", "place")).alias("w")).select("level", F.col("w.answer").alias("answer"), F.round("w.value", 6).alias("maximin"))
    bonus = F.round(F.col("reversibility") * F.col("information") - fragility * (1 - F.col("reversibility")), 6)
    return worst.join(profiles, "level").select("level", "answer", "maximin", bonus.alias("optionality"), F.round(F.col("maximin") + optionality * bonus, 6).alias("robust"))


def chosen_levels(cases: DataFrame, levels: DataFrame) -> DataFrame:
    """(case, level, answer, maximin, robust, margin): of the levels at or above a case's floor the one of most robust value, the lowest of equal ones, and
    how far it is ahead of the next. A case without a floor (no anchor) abstains: all null. Levels are a stated table of a few rows."""
    met = cases.join(F.broadcast(levels), cases.floor <= levels.level, "left")
    rank = F.row_number().over(Window.partitionBy("case").orderBy(F.desc_nulls_last("robust"), "level"))
    two = met.withColumn("_r", rank).where("_r <= 2")
    return two.groupBy("case").agg(
        *[F.max(F.when(F.col("_r") == 1, F.col(c))).alias(c) for c in ("level", "answer", "maximin", "robust")],
        F.round(F.max(F.when(F.col("_r") == 1, F.col("robust"))) - F.max(F.when(F.col("_r") == 2, F.col("robust"))), 3).alias("margin"),
    )


def authoritative(fields: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(document, field, value, source, sources, conflict) of rows (document, field, value, source, at): of each field the value of the source of most authority, of equal ones
    the latest, then the greater value. A conflict is open where another source's value differs. Null values say nothing; unknown sources rank last."""
    authority = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col("source")), F.lit(-1))
    said = fields.where(F.col("value").isNotNull()).withColumn("_rank", authority)
    best = said.groupBy("document", "field").agg(F.max_by(F.struct("value", "source"), F.struct("_rank", "at", "value", "source")).alias("r"), F.count_distinct("source").alias("sources"), F.count_distinct("value").alias("_values"))
    return best.select("document", "field", "r.value", "r.source", "sources", ((F.col("sources") > 1) & (F.col("_values") > 1)).alias("conflict"))


def corrections(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document, field, old, new): where two states (document, field, value) differ; a field that only one has is null in the other."""
    old, new = before.select("document", "field", F.col("value").alias("old")), after.select("document", "field", F.col("value").alias("new"))
    return old.join(new, ["document", "field"], "full").where(~F.col("old").eqNullSafe(F.col("new")))


def answer_reviews(answers: DataFrame) -> DataFrame:
    """(query, missing_forms, extra_forms, missing_steps, recommendations) of rows (query, answer, expected): forms and numbered steps that the answer lacks or invents,
    and what that recommends, gravest first."""
    forms = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(FORM), F.lit(1))))
    steps = F.transform(F.regexp_extract_all(F.coalesce("expected", F.lit("")), F.lit(STEP), F.lit(1)), lambda s: F.lower(F.trim(s)))
    low = F.lower(F.coalesce("answer", F.lit("")))
    found = answers.select("query", F.array_except(forms(F.col("expected")), forms(F.col("answer"))).alias("missing_forms"), F.array_except(forms(F.col("answer")), forms(F.col("expected"))).alias("extra_forms"), F.filter(steps, lambda s: ~low.contains(s)).alias("missing_steps"))
    advice = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(name)) for c, name in (("missing_forms", "critical:form_retrieval"), ("extra_forms", "critical:hallucination"), ("missing_steps", "moderate:step_coverage"))]))
    return found.withColumn("recommendations", advice)
