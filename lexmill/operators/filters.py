"""Predicates and filtered selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def payload_filter(spec: dict) -> Column:
    """A filter of fields. Flat entries must all hold; a list asks for every member at once, so a scalar column
    meets a list of two different values never (see member_filter for any of them). ``must``, ``should`` and
    ``must_not`` hold lists of such filters: all, at least one if there are any, none."""
    if spec.keys() & {"must", "should", "must_not"}:
        parts = [payload_filter(p) for p in spec.get("must", [])]
        if spec.get("should"):
            parts.append(any_of([payload_filter(p) for p in spec["should"]]))
        parts += [~F.coalesce(payload_filter(p), F.lit(False)) for p in spec.get("must_not", [])]
        return all_of(parts)
    return all_of([F.col(name) == v for name, value in spec.items() for v in (value if isinstance(value, list) else [value])])


def member_filter(spec: dict) -> Column:
    """Each field equals one of its values."""
    return all_of([F.col(name).isin(value if isinstance(value, list) else [value]) for name, value in spec.items()])


def section_scope(section: Column, act: Column, title: Column, number: str | None, name: str | None) -> Column | None:
    """Section and act (by name or document title); None where neither is asked for."""
    parts = [] if number is None else [section == number]
    parts += [] if name is None else [(act == name) | (title == name)]
    return all_of(parts) if parts else None


def merged_filter(own: dict, caller: dict, pin: str = "section") -> Column:
    """The own filter and the caller's; where both pin the same field the caller's pin stands."""
    kept = {k: v for k, v in own.items() if not (k == pin and pin in caller)}
    return payload_filter(kept) & payload_filter(caller)


def contains_any(columns: list[str], text: str) -> Column:
    """Case-insensitive containment in any column; the text is literal, so nothing needs escaping."""
    return any_of([F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in columns])


def matching_entities(tables: list[tuple[str, DataFrame, str, list[str]]], text: str, limit: int) -> DataFrame:
    """Per entity type up to ``limit`` rows, by key, that contain the text; (kind, table, key, columns) each."""
    parts = [df.where(contains_any(columns, text)).orderBy(key).limit(limit).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key")) for kind, df, key, columns in tables]
    return reduce(DataFrame.unionByName, parts)


def optional_filters(df: DataFrame, equal: dict | None = None, like: dict | None = None, start=None, end=None, date: str | None = None) -> DataFrame:
    """Equality, containment and an inclusive date range, each only where a value is given."""
    for name, value in (equal or {}).items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    for name, value in (like or {}).items():
        if value:
            df = df.where(F.lower(F.col(name)).contains(value.lower()))
    if date and start is not None:
        df = df.where(F.to_date(date) >= F.lit(start).cast("date"))
    if date and end is not None:
        df = df.where(F.to_date(date) <= F.lit(end).cast("date"))
    return df


def first_class(value: Column, families: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The first family one of whose aliases the value contains."""
    out = F.lit(default).cast("string")
    for name, aliases in reversed(families):
        out = F.when(any_of([value.contains(a) for a in aliases]), name).otherwise(out)
    return out


def located(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """Rows whose two coordinates are known."""
    return df.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
