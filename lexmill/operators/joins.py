"""Joins over records and typed edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.shared import saved


def merged_series(left: DataFrame, right: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Two grouped series side by side, missing values 0."""
    return left.join(right, key, "full").na.fill(0, names)


def typed_neighbours(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges of the given types with the far node, by source."""
    if types:
        edges = edges.where(F.col("type").isin(types))
    return edges.join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")


def with_collected(roots: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """Each root with a sorted array of its neighbours for every edge type; roots without any have empty arrays.

    All types in one aggregate instead of one outer join each.
    """
    parts = [F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("dst")))).alias(t) for t in types]
    found = edges.where(F.col("type").isin(types)).groupBy(F.col("src").alias("id")).agg(*parts)
    joined = roots.join(found, "id", "left")
    empty = F.array().cast(found.schema[types[0]].dataType)
    return joined.select(*roots.columns, *[F.coalesce(F.col(t), empty).alias(t) for t in types])


def without_edge(nodes: DataFrame, edges: DataFrame, kind: str, end: str = "src") -> DataFrame:
    """Nodes that no edge of the type starts (or ends) at."""
    return nodes.join(edges.where(F.col("type") == kind).select(F.col(end).alias("id")), "id", "left_anti")


def with_but_without(nodes: DataFrame, edges: DataFrame, has: str, lacks: str) -> DataFrame:
    some = nodes.join(edges.where(F.col("type") == has).select(F.col("src").alias("id")), "id", "left_semi")
    return without_edge(some, edges, lacks)


def merge_actions(local: DataFrame, remote: DataFrame, key: str, version: str) -> DataFrame:
    """A full merge of two versioned tables: insert, apply, conflict, push or same, per key."""
    a, b = local.select(key, F.col(version).alias("local")), remote.select(key, F.col(version).alias("remote"))
    action = F.when(F.col("local").isNull(), "insert").when(F.col("remote").isNull(), "push").when(F.col("remote") > F.col("local"), "apply").when(F.col("remote") < F.col("local"), "conflict").otherwise("same")
    return a.join(b, key, "full").withColumn("action", action)


def dirty_rows(rows: DataFrame, state: DataFrame, key: str, synced_at: str, updated_at: str | None = None) -> DataFrame:
    """Rows never synced or without a sync time; with updated_at also those changed since."""
    joined = rows.join(state.select(key, F.col(synced_at).alias("_at")), key, "left")
    stale = F.col("_at").isNull()
    if updated_at:
        stale = stale | (F.col(updated_at) > F.col("_at"))
    return joined.where(stale).drop("_at")


def tiered_lookup(candidates: DataFrame, index: DataFrame, tiers: list[tuple[list[str], str]], value: str) -> DataFrame:
    """Looks candidates up by each tier's columns in turn; the first tier that finds any decides.

    Of several finds the least value is the anchor; one find has confidence 0.95, several 0.7, none null.
    """
    out = candidates
    for keys, name in tiers:
        found = index.groupBy(*keys).agg(F.min(value).alias(f"_v_{name}"), F.count("*").alias(f"_n_{name}"))
        out = out.join(found, keys, "left")
    first = lambda stem: F.coalesce(*[F.col(f"_{stem}_{name}") for _, name in tiers])
    tier = F.coalesce(*[F.when(F.col(f"_n_{name}") > 0, name) for _, name in tiers])
    confidence = F.when(first("n") == 1, 0.95).when(first("n") > 1, 0.7)
    return out.select(*candidates.columns, first("v").alias("anchor"), tier.alias("tier"), confidence.alias("confidence"))


#: Facts that hold a value, beyond which they are counted by subsets instead of met one by one; most such values of a set that is treated so.
OFTEN, SUBSETS = 100, 12


def conflicts(facts: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """(key, order, n_conflicts): with how many facts about the same key each shares no value; facts without values take no part.

    Facts of equal value sets are one class; what is counted is those that agree. Values that few classes of a key hold let these
    meet, at most OFTEN each. Over the values that many hold, inclusion and exclusion of a set's subsets counts without pairs. A set
    with more than SUBSETS such values meets every class that shares a value: pairs, but each is made once and none is held.
    A null key has no conflicts, a null order is none that others conflict with, and facts of one order count together.
    """
    own = saved(facts.select(key, order, F.array_sort(F.array_distinct(F.array_compact(values))).alias("_set")).where(F.size("_set") > 0))
    classes = saved(own.where(F.col(key).isNotNull()).groupBy(key, "_set").agg(F.count(order).alias("_n")).withColumn("_id", F.monotonically_increasing_id()))
    held = classes.select(key, "_id", F.explode("_set").alias("_v"))
    often = held.groupBy(key, "_v").count().where(F.col("count") > OFTEN).select(key, "_v")
    heavy = held.join(often, [key, "_v"]).groupBy("_id").agg(F.array_sort(F.collect_list("_v")).alias("_often"))
    none = F.array().cast(own.schema["_set"].dataType)
    marked = saved(classes.join(heavy, "_id", "left").withColumn("_often", F.coalesce("_often", none)).withColumn("_wide", F.size("_often") > SUBSETS))
    narrow, wide = marked.where("NOT _wide"), marked.where("_wide")

    sets = narrow.where(F.size("_often") > 0).groupBy(key, "_often").agg(F.sum("_n").alias("_n"))
    grown = F.aggregate("_often", F.array(none), lambda done, v: F.concat(done, F.transform(done, lambda t: F.concat(t, F.array(v)))))
    subsets = sets.select(key, "_often", "_n", F.explode(grown).alias("_t")).where(F.size("_t") > 0)
    holding = subsets.groupBy(key, "_t").agg(F.sum("_n").alias("_m"))
    signed = F.when(F.size("_t") % 2 == 1, F.col("_m")).otherwise(-F.col("_m"))
    counted = narrow.join(subsets.join(holding, [key, "_t"]).groupBy(key, "_often").agg(F.sum(signed).alias("_m")), [key, "_often"]).select("_id", "_m")

    # The first value that two sets share stands for the pair, so no pair is made twice.
    first = F.get(F.array_intersect("_set", "_set2"), 0) == F.col("_v")
    other = lambda rows: rows.select(key, "_v", *[F.col(c).alias(c + "2") for c in ("_id", "_n", "_set", "_often", "_wide")])
    seldom = narrow.withColumn("_v", F.explode(F.array_except("_set", "_often")))
    met = seldom.join(other(seldom), [key, "_v"]).where(~F.arrays_overlap("_often", "_often2") & first).select("_id", F.col("_n2").alias("_m"))
    pairs = wide.withColumn("_v", F.explode("_set")).join(other(marked.withColumn("_v", F.explode("_set"))), [key, "_v"]).where(first)
    ways = F.array(F.struct("_id", F.col("_n2").alias("_m")), F.struct(F.when(~F.col("_wide2"), F.col("_id2")).alias("_id"), F.col("_n").alias("_m")))
    widely = pairs.select(F.explode(ways).alias("_p")).select("_p.*").where("_id IS NOT NULL")

    agree = counted.union(met).union(widely).groupBy("_id").agg(F.sum("_m").alias("_agree"))
    total = classes.groupBy(key).agg(F.sum("_n").alias("_total"))
    against = classes.join(agree, "_id").join(total, key).select(key, "_set", (F.col("_total") - F.col("_agree")).alias("_against"))
    return own.join(against, [key, "_set"], "left").groupBy(key, order).agg(F.sum(F.coalesce("_against", F.lit(0))).alias("n_conflicts"))


def covers(item_family: Column, item_section: Column, family: Column, section: Column) -> Column:
    """A gold unit without a section is covered by any item of its family."""
    return (item_family == family) & (section.isNull() | (item_section == section))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key as one aggregate; the order must be total."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
