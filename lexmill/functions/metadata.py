"""Entities, document types, metadata with confidence, tables of contents and query parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (type, confidence, pattern) of entities that rules find, in order.
ENTITIES = (
    ("statute", 0.9, r"\b(?:[A-Z][a-z]+ ){1,4}Act(?:, \d{4})?"),
    ("case", 0.85, r"\b[A-Z][a-z]+ v\. [A-Z][a-z]+"),
    ("organization", 0.8, r"\b(?:[A-Z][a-z]+ ){1,3}(?:Authority|Board|Ltd|Limited|Corporation)\b"),
    ("person", 0.7, r"\b(?:Mr|Ms|Mrs|Dr)\. [A-Z][a-z]+(?: [A-Z][a-z]+)?"),
)


def entities(text: Column) -> Column:
    """Array of (type, confidence, value) in pattern order, values once per type."""
    parts = []
    for kind, confidence, pattern in ENTITIES:
        values = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        parts.append(_tagged(values, kind, confidence))
    return F.concat(*parts)


def _tagged(values: Column, kind: str, confidence: float) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), v.alias("value")))


def document_type(text: Column) -> Column:
    """(kind, year, confidence): the first marker among the opening 500 characters."""
    head = F.lower(F.substring(text, 1, 500))
    kinds = (("act", r"\bact\b"), ("rules", r"\brules\b"), ("regulations", r"\bregulations?\b"), ("notification", r"\bnotification\b"), ("judgment", r"\b(judgment|petitioner)\b"))
    kind = F.coalesce(*[F.when(head.rlike(p), F.lit(k)) for k, p in kinds], F.lit("other"))
    year = F.nullif(F.regexp_extract(head, r"\b((?:18|19|20)\d{2})\b", 1), F.lit("")).cast("int")
    return F.struct(kind.alias("kind"), year.alias("year"), F.when(kind == "other", 0.3).when(year.isNull(), 0.7).otherwise(0.9).alias("confidence"))


def agreeing(fields: Column, text: Column) -> Column:
    """Confidences of (name, value, confidence) fields: 0.1 more where the text holds the value, 0.2 less where it does not; 0 to 1."""
    return F.transform(fields, lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f["confidence"] + F.when(text.contains(f["value"]), 0.1).otherwise(-0.2))), 6).alias("confidence")))


def toc_html(headings: Column) -> Column:
    """A nested list of (level, title) headings: a deeper heading opens a list, a shallower one closes those it leaves."""

    def step(done: Column, h: Column) -> Column:
        depth = h["level"]
        opens = F.repeat(F.lit("<ol>"), F.greatest(F.lit(0), depth - done["depth"]))
        closes = F.repeat(F.lit("</ol>"), F.greatest(F.lit(0), done["depth"] - depth))
        return F.struct(depth.alias("depth"), F.concat(done["out"], opens, closes, F.lit("<li>"), h["title"], F.lit("</li>")).alias("out"))

    return F.aggregate(headings, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda d: F.concat(d["out"], F.repeat(F.lit("</ol>"), d["depth"])))


def split_query(text: Column, connectives: tuple[str, ...] = ("in", "at", "near"), generic: tuple[str, ...] = ("shop", "store", "hotel")) -> Column:
    """(name, place): the words before and after the first inner connective; generic words do not count as name."""
    tokens = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: t != "")
    spots = F.array_compact(F.transform(tokens, lambda t, i: F.when(t.isin(*connectives) & (i > 0), i)))
    cut = F.when((F.size(spots) > 0) & (F.get(spots, 0) < F.size(tokens) - 1), F.get(spots, 0))
    name = F.when(cut.isNull(), tokens).otherwise(F.slice(tokens, 1, F.coalesce(cut, F.lit(0))))
    place = F.when(cut.isNull(), F.array().cast("array<string>")).otherwise(F.slice(tokens, F.coalesce(cut, F.lit(0)) + 2, F.size(tokens)))
    return F.struct(F.array_join(F.filter(name, lambda t: ~t.isin(*generic)), " ").alias("name"), F.array_join(place, " ").alias("place"))


def precedence(values: Column, order: tuple[str, ...]) -> Column:
    """Of an array of names the one that comes first in the order."""
    return F.coalesce(*[F.when(F.array_contains(values, name), F.lit(name)) for name in order])


def form_query(text: Column) -> Column:
    """A named form as a lexical query; null where none is named."""
    form = F.regexp_extract(text, r"(?i)\bform\s+([A-Z]{1,3}|\d{1,3}[A-Z]?)\b", 1)
    return F.when(form != "", F.concat(F.lit("form "), F.upper(form)))


def node_text(label: Column, meta: Column, keys: tuple[str, ...]) -> Column:
    """A label and the stated metadata in order, missing ones left out."""
    return F.concat_ws(" ", label, *[meta[k] for k in keys])
