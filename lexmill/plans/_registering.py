"""Registers queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None, *tables: str):
    """A query made of a function of the named tables; its SQL reads the same tables as views. A name is taken once."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def keep(build: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(*[read_table(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return keep
