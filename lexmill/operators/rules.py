"""Pluggable parts: validation rules, retrieval stages, providers, hash stores, each a named function of frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.joins import union_all


@dataclass(frozen=True)
class Rule:
    """A finding for every row that the predicate holds for."""

    name: str
    severity: str
    finds: Column
    message: str = ""


def evaluate(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, rule, severity, message) of all findings, in one pass over the rows."""
    found = [F.when(r.finds, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in rules]
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.*")


@dataclass(frozen=True)
class Stage:
    """A step of a ranked list; ``isolate`` keeps the input where the step fails to be planned."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    enabled: bool = True
    isolate: bool = False


def run_stages(ranked: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        if not stage.enabled:
            continue
        try:
            ranked = stage.apply(ranked)
        except Exception:
            if not stage.isolate:
                raise
    return ranked


@dataclass
class Registry:
    """Named providers; the last registration of a name counts."""

    parts: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def add(self, name: str):
        def keep(build: Callable[..., DataFrame]):
            self.parts[name] = build
            return build

        return keep

    def __call__(self, name: str, *frames: DataFrame, **options) -> DataFrame:
        if name not in self.parts:
            raise KeyError(f"no provider {name!r}; known: {', '.join(sorted(self.parts))}")
        return self.parts[name](*frames, **options)


class SeenHashes:
    """A store of hashes as a table: split a batch into new and seen, then record it."""

    def __init__(self, seen: DataFrame, column: str = "hash"):
        self.seen, self.column = seen.select(column).distinct(), column

    def split(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        return batch.join(self.seen, self.column, "left_anti"), batch.join(self.seen, self.column, "left_semi")

    def record(self, batch: DataFrame) -> SeenHashes:
        return SeenHashes(union_all([self.seen, batch.select(self.column)]), self.column)
