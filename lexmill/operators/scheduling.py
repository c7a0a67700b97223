"""Plans of many questions at once: rules give each question its tasks, and waves, critical paths and slack follow from what needs what.

A task starts when the last of its needs has ended. Then, from the last wave back, the latest end that does not delay a plan. Each plan is scheduled
by itself, where its tasks and needs have been brought together. Tasks on a circle, or behind one, have no wave.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def planned(questions: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks (plan, task, cost) and edges (plan, task, need) of questions (plan, kind, ...), by rules (kind, task, cost, needs: array).

    The rules are a stated table. Needs that a plan does not have, and a task's need of itself, are no edges.
    """
    own = questions.join(rules, "kind").select("plan", "task", "cost", "needs")
    tasks = own.select("plan", "task", "cost")
    edges = own.select("plan", "task", F.explode("needs").alias("need")).where("need <> task").distinct()
    return tasks, edges.join(tasks.select("plan", F.col("task").alias("need")), ["plan", "need"], "left_semi").select("plan", "task", "need")


def _schedule(tasks: tuple, edges: tuple) -> list[tuple]:
    """(wave, start, end, slack, critical) of each task (task, cost) of one plan; edges are (task, need). Unknown costs leave unknown ends."""
    cost = {task: own for task, own in tasks if task is not None}
    needs: dict = {task: set() for task in cost}
    for task, need in edges:
        if task in needs:
            needs[task].add(need)
    follow: dict = {}
    for task, own in needs.items():
        for need in own:
            follow.setdefault(need, []).append(task)
    wave, start, end, met = {}, {}, {}, {task: len(own) for task, own in needs.items()}
    here, number, order = [task for task, left in met.items() if not left], 0, []
    while here:
        then = []
        for task in here:
            ends = [end[n] for n in needs[task] if end[n] is not None]
            wave[task], start[task] = number, max(ends) if ends else None if needs[task] else 0
            end[task] = None if start[task] is None or cost[task] is None else start[task] + cost[task]
            order.append(task)
            for other in follow.get(task, ()):
                met[other] -= 1
                if not met[other]:
                    then.append(other)
        here, number = then, number + 1
    whole = max((e for e in end.values() if e is not None), default=None)
    latest: dict = {}
    for task in reversed(order):
        by = [latest[t] - cost[t] for t in follow.get(task, ()) if t in wave and latest[t] is not None and cost[t] is not None]
        latest[task] = min(by, default=whole)
    slack = {task: None if latest[task] is None or end[task] is None else latest[task] - end[task] for task in wave}
    return [(wave[t], start[t], end[t], slack[t], None if slack[t] is None else slack[t] == 0) if t in wave else (None,) * 5 for t, _ in tasks]


def _plans(schema: pa.Schema):
    """Rows of ``scheduled`` from (plan, tasks, edges); plans of equal tasks and edges are scheduled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(1 << 12)(_schedule)
        for batch in batches:
            rows = []
            for plan, tasks, edges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tuple((t["task"], t["cost"]) for t in tasks)
                found = [(None,) * 5] * len(own) if plan is None else known(own, tuple((e["task"], e["need"]) for e in edges))
                rows += [(plan, *task, *times) for task, times in zip(own, found, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def scheduled(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, task, cost, wave, start, end, slack, critical) of tasks (plan, task, cost) and edges (plan, task, need). Waves count from 0.

    Tasks of a plan have different names. The tasks and needs of a plan are moved to one place once.
    """
    task = F.when(F.col("is_task"), F.struct("task", "cost"))
    edge = F.when(~F.col("is_task"), F.struct("task", "need"))
    both = tasks.select("plan", "task", "cost", F.lit(None).cast(edges.schema["need"].dataType).alias("need"), F.lit(True).alias("is_task"))
    both = both.union(edges.select("plan", "task", F.lit(None).cast(tasks.schema["cost"].dataType).alias("cost"), "need", F.lit(False).alias("is_task")))
    # Nulls are not collected; in one order, equal plans look equal.
    whole = both.groupBy("plan").agg(F.array_sort(F.collect_list(task)).alias("tasks"), F.array_sort(F.collect_list(edge)).alias("edges"))
    kinds = [(n, tasks.schema[n].dataType.simpleString()) for n in ("plan", "task", "cost")] + [("wave", "int"), ("start", "bigint"), ("end", "bigint"), ("slack", "bigint"), ("critical", "boolean")]
    fields = ", ".join(f"`{n}` {kind}" for n, kind in kinds)
    return whole.mapInArrow(_plans(to_arrow_schema(StructType.fromDDL(fields))), fields)
