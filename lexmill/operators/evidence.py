"""Claims, grounding, amendments, provisions and evidence packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import extract as X
from lexmill.functions import lexical as L
from lexmill.operators.phrases import occurrences


def grounding(docs: DataFrame, key: str, text: str, synonyms: DataFrame, limit: int) -> DataFrame:
    """(key, concept, synonym, start, evidence, confidence): the first hit of each synonym, in synonym order, so many per concept.

    synonyms is a stated table (concept, pos, synonym), of any size. The first synonym of a concept has confidence 0.9, others 0.75.
    """
    stated = synonyms.sparkSession.createDataFrame([(i, r.concept, r.pos, r.synonym) for i, r in enumerate(synonyms.select("concept", "pos", "synonym").collect())], "id int, concept string, pos int, synonym string")
    found = occurrences(docs, key, text, stated.select("id", F.col("synonym").alias("phrase")), whole_words=False, around=(60, 80)).join(stated, "id")
    rank = F.row_number().over(Window.partitionBy(key, "concept").orderBy("pos"))
    kept = found.withColumn("_r", rank).where(F.col("_r") <= limit)
    return kept.select(key, "concept", "synonym", F.col("first").cast("int").alias("start"), F.col("around").alias("evidence"), F.when(F.col("pos") == 0, 0.9).otherwise(0.75).alias("confidence"))


def linked_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References (case_id, ref) to targets (case_id, letter, pos): a number means the position from 1, else the letter; unresolved ones keep null."""
    by_number = F.col("ref").rlike(r"^\d+$")
    hit = (refs.case_id == targets.case_id) & F.when(by_number, F.col("ref").try_cast("int") == F.col("pos")).otherwise(F.upper("ref") == F.col("letter"))
    return refs.join(targets, hit, "left").select(refs.case_id, "ref", "letter", F.col("letter").isNotNull().alias("resolved"))


def amendment_events(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, action, year) of what a text says was done to a provision, in order."""
    pattern = r"(?i)\b(substituted|inserted|omitted|repealed|amended)\b(?:[^.]{0,80}?(\d{4}))?"
    actions = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    years = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    rows = docs.select(key, F.posexplode(F.arrays_zip(actions.alias("action"), years.alias("year"))).alias("pos", "e"))
    return rows.select(key, "pos", F.lower("e.action").alias("action"), F.col("e.year").try_cast("int").alias("year"))


def state_after(events: DataFrame, key: str, year: int, base: str = "current") -> DataFrame:
    """The last terminal event up to the year decides: repealed or omitted, else the base."""
    terminal = F.col("action").isin("repealed", "omitted") & (F.col("year").isNull() | (F.col("year") <= year))
    last = events.groupBy(key).agg(F.max_by(F.when(terminal, F.col("action")), F.when(terminal, F.col("pos"))).alias("last"))
    return last.select(key, F.coalesce("last", F.lit(base)).alias("state"))


def verified(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim_id, confidence, support) of claims (claim_id, query, claim) against each query's chunks (query, item, text).

    A named section that a chunk names counts 0.85, else 0.7 times the share of content tokens; only chunks that can bear the
    claim (numbers, polarity) count.
    """
    pairs = claims.join(chunks, "query").where(X.supports(F.col("claim"), F.col("text")))
    same = F.size(F.array_intersect(X.sections_in(F.col("claim")), X.sections_in(F.col("text")))) > 0
    share = L.overlap_share(L.content_tokens(F.col("text")), L.content_tokens(F.col("claim")))
    score = F.greatest(F.when(same, 0.85).otherwise(0.0), 0.7 * share)
    best = pairs.select("claim_id", "item", F.round(score, 6).alias("score")).groupBy("claim_id").agg(F.max("score").alias("confidence"), F.max_by("item", F.struct("score", -F.col("item"))).alias("support"))
    return claims.select("claim_id").join(best, "claim_id", "left").select("claim_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "support")


def faithfulness(verdicts: DataFrame, least: float = 0.5) -> DataFrame:
    return verdicts.agg(F.round(F.avg((F.col("confidence") >= least).cast("int")), 6).alias("faithfulness"), F.count("*").alias("claims"))


def provisions(chunks: DataFrame, known: list[int] | None = None) -> DataFrame:
    """One row per (document, section) of chunks (document, section, idx, text): first chunk, number of chunks, body length."""
    rows = chunks.where(F.col("section").isNotNull())
    if known is not None:
        rows = rows.where(F.col("section").isin(known))
    return rows.groupBy("document", "section").agg(F.min("idx").alias("first"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("body"))


def payload_quality(provisions: DataFrame, least_body: int) -> DataFrame:
    """Injectable and stub counts, stub rate and lower median of the body lengths."""
    n = F.count("*")
    stub = F.count_if(F.col("body") < least_body)
    return provisions.agg((n - stub).alias("injectable"), stub.alias("stubs"), F.round(stub / n, 4).alias("stub_rate"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY body)").alias("median_body"))


def expanded(selected: DataFrame, pool: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """The chosen items and, after them, what they refer to in the pool, at most so many per query."""
    more = selected.select("query", F.col("item").alias("src")).join(links, "src").select("query", F.col("dst").alias("item")).distinct()
    extra = more.join(pool, ["query", "item"], "left_semi").join(selected, ["query", "item"], "left_anti")
    both = selected.select("query", "item", F.lit(0).alias("tier")).unionByName(extra.withColumn("tier", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("tier", "item"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most)


def sparse_vectors(index: DataFrame, buckets: int = 1 << 20, k1: float = 1.2, b: float = 0.75, mean: float = 100.0) -> DataFrame:
    """(item, vector): BM25 term weights by hashed term, without idf, which the search applies."""
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    hashed = index.select("item", F.pmod(F.hash("term"), F.lit(buckets)).alias("i"), weight.alias("w")).groupBy("item", "i").agg(F.round(F.sum("w"), 6).alias("w"))
    return hashed.groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("i", "w")))).alias("vector"))


def renumbered_lines(text: Column) -> Column:
    """List markers such as ``3.`` at line starts, numbered anew from 1."""
    marker = r"(?m)^\s*\d+(?=\.[^\S\n])"
    found, gaps = F.regexp_extract_all(text, F.lit(marker), F.lit(0)).alias("found"), F.split(text, marker, -1).alias("gap")
    # A gap before each marker, and one behind the last; zipped, so that the text is split once.
    part = lambda x, i: F.concat(x["gap"], F.coalesce(F.concat(F.regexp_extract(x["found"], r"^\s*", 0), (i + 1).cast("string")), F.lit("")))
    return F.array_join(F.transform(F.arrays_zip(found, gaps), part), "")


def steps_missing(said: Column, wanted: Column) -> Column:
    """Numbered steps of the wanted text that the other does not contain."""
    steps = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^\s*\d+[.)]\s*(.+)$"), F.lit(1)), lambda x: F.lower(F.trim(x)))
    return F.filter(steps(wanted), lambda s: ~F.lower(said).contains(s))


def text_edges(docs: DataFrame, key: str, text: str, act: Column) -> DataFrame:
    """(source, target, relation, evidence): an edge for every section or rule that a text names, ten characters around it as evidence.

    Targets are ``act::number``, or the number where no act is known. Null ids and texts give no edges.
    """
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("source"), act.alias("act"), F.col(text).alias("_text"))
    rows = named.select("source", "act", "_text", F.explode(X.references_in(F.col("_text"), "HIGH")).alias("r"))
    first = F.greatest(F.col("r.start") - 10, F.lit(0))
    target = F.concat_ws("::", "act", F.regexp_extract("r.raw", r"(\d\S*)$", 1))
    return rows.select("source", target.alias("target"), F.lit("refs").alias("relation"), F.substring(F.col("_text"), first + 1, F.col("r.end") + 10 - first).alias("evidence"))


def bundle(rows: DataFrame, query: str, group: str, item: str, score: str, satisfies: Column, most: int = 5, each: int = 2) -> DataFrame:
    """(query, group, item, part, rank): the evidence of each query in two parts.

    Groups rank by their best score, ties by name. Primary are the satisfying items of the best group that has any, best first,
    at most ``most``; related are the ``each`` best items of every other group, best groups first, at most ``most``. Equal
    scores go by item. Ranks are cut per task before the shuffle's rows are sorted out; no group is collected.
    """
    own = rows.select(query, group, item, score, F.coalesce(satisfies, F.lit(False)).alias("_good"))
    groups = own.groupBy(query, group).agg(F.max(score).alias("_best"), F.max("_good").alias("_any"))
    chosen = groups.where("_any").groupBy(query).agg(F.min(F.struct((-F.col("_best")).alias("b"), F.col(group).alias("g")))["g"].alias("_chosen"))
    known = own.join(groups.drop("_any"), [query, group]).join(chosen, query, "left")
    within = F.row_number().over(Window.partitionBy(query, group).orderBy(F.desc(score), item))
    primary = known.where((F.col(group) == F.col("_chosen")) & F.col("_good")).withColumn("rank", within).where(F.col("rank") <= most)
    others = known.where(F.col("_chosen").isNull() | (F.col(group) != F.col("_chosen"))).withColumn("_r", within).where(F.col("_r") <= each)
    across = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_best"), group, "_r"))
    related = others.withColumn("rank", across).where(F.col("rank") <= most)
    parts = [part.select(query, group, item, F.lit(name).alias("part"), "rank") for name, part in (("primary", primary), ("related", related))]
    return parts[0].union(parts[1])


def task_coverage(tasks: DataFrame, chunks: DataFrame, plan: str, task: str, least: float) -> DataFrame:
    """(plan, tasks, covered, coverage): how many tasks (plan, task, question) some chunk (task, text) covers at least so far.

    A task without content tokens or without chunks is not covered.
    """
    needles = tasks.select(plan, task, L.content_tokens(F.col("question")).alias("_needles"))
    joined = needles.join(chunks.select(task, "text"), task, "left")
    hit = (F.size("_needles") > 0) & F.coalesce(L.token_coverage(F.col("_needles"), F.col("text")) >= least, F.lit(False))
    by_task = joined.groupBy(plan, task).agg(F.max(hit).alias("_hit"))
    covered = F.count_if("_hit")
    return by_task.groupBy(plan).agg(F.count("*").alias("tasks"), covered.alias("covered"), F.round(covered / F.count("*"), 4).alias("coverage"))
