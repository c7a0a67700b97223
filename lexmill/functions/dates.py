"""Dates, deadlines, validity and amounts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The date forms that are tried, in order, and the terms in days.
FORMS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd MMM, yyyy", "yyyyMMdd")
PETITION_DAYS, COMPLIANCE_DAYS, HANDOVER_DAYS = 365, 30, 30


def parse_date(c: Column) -> Column:
    """The first form that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in FORMS])


def parse_partial_date(c: Column) -> Column:
    """Also year and month, and a date anywhere in the text."""
    anywhere = F.regexp_extract(c, r"(\d{4}-\d{1,2}-\d{1,2})", 1)
    return F.coalesce(parse_date(c), F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM")).cast("date"), F.try_to_timestamp(anywhere, F.lit("yyyy-M-d")).cast("date"))


def petition_deadline(d: Column) -> Column:
    return F.date_add(d, PETITION_DAYS)


def compliance_deadline(d: Column) -> Column:
    return F.date_add(d, COMPLIANCE_DAYS)


def latest_date(a: Column, b: Column) -> Column:
    """The later of two dates; a missing one does not count."""
    return F.greatest(a, b)


def generation_blocked(a: Column, b: Column, today: Column) -> Column:
    return today < F.date_add(latest_date(a, b), HANDOVER_DAYS)


def indian_date(d: Column) -> Column:
    return F.date_format(d, "dd-MM-yyyy")


def valid_on(day: Column, status: Column, start: Column, end: Column) -> Column:
    """Repealed is invalid; current is valid from start to end, both included, open ends allowed; else unknown."""
    inside = (start.isNull() | (start <= day)) & (end.isNull() | (day <= end))
    return F.when(status == "repealed", "invalid").when(status == "current", F.when(inside, "valid").otherwise("invalid")).otherwise("unknown")


def price(c: Column) -> Column:
    """The number in a price text, 0 where there is none."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(c, r"^[^0-9]+", ""), r"[^0-9.]", "").try_cast("double"), F.lit(0.0))


def minmax(c: Column, low: Column, high: Column, constant: float) -> Column:
    """Min-max scaling; a constant input gives the stated value."""
    return F.when(high == low, F.lit(constant)).otherwise((c - low) / (high - low))


def latency_factor(ms: Column, cap: float) -> Column:
    return F.when(ms.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - ms / cap))


# Number words and the units of Indian currency.
ONES = (
    "", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven", "Twelve", "Thirteen",
    "Fourteen", "Fifteen", "Sixteen", "Seventeen", "Eighteen", "Nineteen",
)
TENS = ("", "", "Twenty", "Thirty", "Forty", "Fifty", "Sixty", "Seventy", "Eighty", "Ninety")
UNITS = ((10_000_000, "Crore"), (100_000, "Lakh"), (1000, "Thousand"), (100, "Hundred"))


def number_words(n: int) -> str:
    if n < 20:
        return ONES[n]
    if n < 100:
        return f"{TENS[n // 10]} {ONES[n % 10]}".strip()
    size, name = next(u for u in UNITS if n >= u[0])
    return f"{number_words(n // size)} {name} {number_words(n % size)}".strip()


@F.pandas_udf(StringType())
def rupees_in_words(n: pd.Series) -> pd.Series:
    return n.map(lambda x: None if pd.isna(x) else f"Rupees {number_words(int(x)) or 'Zero'} Only")
