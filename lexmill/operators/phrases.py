"""Many phrases and rules over texts in one pass: an automaton of all phrases is walked once along each text.

Phrases are a table. They are held against the texts in blocks of at most ``BLOCK`` letters, the only thing that is sent to every task; a table
of more blocks means as many passes, whose results are put together. Rules are phrases with a field and a value, or patterns; a pattern
that names a phrase without which it cannot match is tried only on texts where the automaton has met that phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 8 << 20


def _automaton(phrases: list[str]) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        if phrase:
            out.add_word(phrase, (i, len(phrase)))
    if not len(out):
        return None
    out.make_automaton()
    return out


def _part_of_word(letter: str) -> bool:
    return letter.isalnum() or letter == "_"


def _cuts_words(low: str, start: int, end: int) -> bool:
    """Whether a word goes on before the start or behind the end."""
    return (start > 0 and _part_of_word(low[start - 1]) and _part_of_word(low[start])) or (end < len(low) and _part_of_word(low[end]) and _part_of_word(low[end - 1]))


def _hits(automaton, low: str, whole_words: bool) -> Iterator[tuple[int, int, int]]:
    """(phrase, start, end) of all occurrences, overlapping ones too, in order of their ends."""
    for last, (i, size) in automaton.iter(low) if automaton else ():
        if not whole_words or not _cuts_words(low, last - size + 1, last + 1):
            yield i, last - size + 1, last + 1


def _lowered(text: str) -> str:
    """Lower case of the same length: the few letters whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def phrase_blocks(phrases: list[str], most: int = BLOCK) -> list[list[int]]:
    """Numbers of the phrases of each block."""
    out, size = [[]], 0
    for i, phrase in enumerate(phrases):
        if out[-1] and size + len(phrase) > most:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(phrase)
    return out


def occurrences(docs: DataFrame, key: str, text: str, phrases: DataFrame, whole_words: bool = True, block: int = BLOCK, around: tuple[int, int] = (0, 0)) -> DataFrame:
    """(key, id, first, n, around): where each phrase (id, phrase) first stands in a text, counted from 0, and how often, in any case of letters;
    around is the first with so many letters before and behind it.

    Phrases are a stated table; empty ones are nowhere. Null texts hold none. Repeated rows are counted each.
    """
    spark = docs.sparkSession
    listed = [(r.id, _lowered(r.phrase or "")) for r in phrases.select("id", "phrase").collect()]
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    id_kind = phrases.schema["id"].dataType
    schema = f"`{key}` {kind}, id {id_kind.simpleString()}, first long, n long, around string"
    parts = []
    for numbers in phrase_blocks([p for _, p in listed], block):
        shared = spark.sparkContext.broadcast([listed[i] for i in numbers])

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids: dict[str, list] = {}
            for i, phrase in shared.value:
                ids.setdefault(phrase, []).append(i)
            automaton, holders = _automaton(list(ids)), list(ids.values())
            for batch in batches:
                rows = []
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    body = text.as_py() or ""
                    seen: dict[int, list[int]] = {}
                    for i, start, end in _hits(automaton, _lowered(body), whole_words):
                        seen.setdefault(i, [start, end, 0])[2] += 1
                    rows += [(k, phrase_id, first, n, body[max(0, first - around[0]) : end + around[1]]) for i, (first, end, n) in sorted(seen.items()) for phrase_id in holders[i]]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [batch.schema.field(0).type, to_arrow_type(id_kind), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "id", "first", "n", "around"])

        parts.append(docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(find, schema))
    return reduce(DataFrame.union, parts)


class Rule(NamedTuple):
    """A phrase (any case, whole words) or a pattern of a field. value is what the field gets, the matched text (a pattern's first group) if it is None.
    needs is a phrase in lower case without which a pattern cannot match."""

    field: str
    name: str
    kind: str
    text: str
    confidence: float
    value: str | None = None
    needs: str | None = None


# Confidence by method.
METHODS = {"regex": 0.85, "heuristic": 0.55, "default": 0.30}


def candidates(docs: DataFrame, key: str, text: str, rules: list[Rule], block: int = BLOCK) -> DataFrame:
    """(key, field, value, confidence, rule): the first match of every rule in every text."""
    spark = docs.sparkSession
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, field string, value string, confidence double, rule int"
    parts = []
    for numbers in phrase_blocks([r.text + (r.needs or "") for r in rules], block):
        shared = spark.sparkContext.broadcast([(i, tuple(rules[i])) for i in numbers])

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = [(i, Rule(*r)) for i, r in shared.value]
            # Phrases stand as whole words, what a pattern needs anywhere.
            words = list(dict.fromkeys(r.text.lower() for _, r in own if r.kind == "phrase"))
            needed = list(dict.fromkeys(r.needs for _, r in own if r.needs))
            automaton = _automaton(list(dict.fromkeys(words + needed)))
            names = list(dict.fromkeys(words + needed))
            compiled = {i: re.compile(r.text) for i, r in own if r.kind == "pattern"}
            for batch in batches:
                rows = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    body = t.as_py() or ""
                    low = _lowered(body)
                    met, whole = set(), {}
                    for i, start, end in _hits(automaton, low, False):
                        met.add(names[i])
                        if names[i] not in whole and not _cuts_words(low, start, end):
                            whole[names[i]] = body[start:end]
                    for i, r in own:
                        if r.kind == "phrase":
                            if (found := whole.get(r.text.lower())) is not None:
                                rows.append((k, r.field, r.value or found, r.confidence, i))
                        elif (r.needs is None or r.needs in met) and (m := compiled[i].search(body)):
                            rows.append((k, r.field, r.value or " ".join((m.group(1) if m.re.groups else m.group()).split()), r.confidence, i))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], [key, "field", "value", "confidence", "rule"])

        parts.append(docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(match, schema))
    return reduce(DataFrame.union, parts)


def field_score(value: Column, method: Column, agree: Column, length: Column) -> Column:
    """Confidence of a field: by method, more where the best three candidates agree, by the length of value and text, less for short or mostly
    letterless values; 0 to 1. agree is the array of at most three best candidates."""
    base = F.lit(METHODS["default"])
    for name, x in METHODS.items():
        base = F.when(method == name, x).otherwise(base)
    alike = F.transform(agree, lambda v: F.lower(F.trim(v)))
    different = F.size(F.array_distinct(alike))
    consensus = F.when(F.size(alike) < 2, 0.0).when(different == 1, 0.10).when(different < F.size(alike), 0.05).otherwise(0.0)
    size = F.length(value)
    fits = F.when((size > 3) & (size < 200), 0.05).when(size > 200, -0.10).otherwise(0.0)
    quality = F.least(F.lit(0.05), length / 1_000_000 * 0.05)
    short = F.when(size < 3, 0.20).otherwise(0.0)
    letters = F.length(F.regexp_replace(value, r"[^\p{L}]", ""))
    noise = F.when((size > 0) & (letters / F.greatest(size, F.lit(1)) < 0.3), 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base - short - noise + consensus + fits + quality)), 4)


def metadata(docs: DataFrame, key: str, text: str, rules: list[Rule], defaults: dict[str, str], block: int = BLOCK) -> DataFrame:
    """(key, field, value, method, score): one row for every field of defaults and every row of docs with a key.

    Of a field's candidates the one of most confidence counts, of equal ones the earlier rule's. Without any the default is taken; its value may be
    empty. Blank texts have the defaults, with score 0 where these are empty.
    """
    own = docs.where(F.col(key).isNotNull()).select(F.col(key), F.length(F.coalesce(F.col(text), F.lit(""))).alias("_length"))
    every = own.select(key, "_length", F.explode(F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])).alias("field", "_default"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "rule", "value")))
    found = candidates(docs.where(F.col(key).isNotNull()), key, text, rules, block).groupBy(key, "field").agg(F.transform(F.slice(order, 1, 3), lambda x: x["value"]).alias("_best"))
    met = every.join(found, [key, "field"], "left").withColumn("_best", F.coalesce("_best", F.array().cast("array<string>")))
    value = F.coalesce(F.get("_best", F.lit(0)), F.col("_default"))
    method = F.when(F.size("_best") > 0, "regex").otherwise("default")
    scored = F.when((F.size("_best") == 0) & (F.col("_default") == ""), 0.0).otherwise(field_score(value, method, F.col("_best"), F.col("_length")))
    return met.select(key, "field", value.alias("value"), method.alias("method"), scored.alias("score"))


class TagRule(NamedTuple):
    """A semantic edge wherever a pattern matches. needs: a phrase in lower case without which it cannot. outside: a relation whose matches it must not overlap.
    apart: a pattern that must not stand within ``window`` letters of the match."""

    relation: str
    concept: str
    confidence: float
    pattern: str
    needs: str | None = None
    outside: str | None = None
    apart: str | None = None
    window: int = 60


def semantic_edges(docs: DataFrame, key: str, text: str, rules: list[TagRule], least: float = 0.7, shortest: int = 40) -> DataFrame:
    """(key, relation, concept, confidence, evidence, place): of each relation and concept the first rule of the table, in its order, that matches, at its first
    match that the rule allows. Evidence is the match with 60 letters before and 80 behind, white space collapsed.

    The table may hold thousands of rules; together they are at most ``BLOCK`` letters. Null and short texts have no edges.
    """
    if sum(len(r.pattern) for r in rules) > BLOCK:
        raise ValueError("the rules are more than one block; precedence needs them together")
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rules if r.confidence >= least])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [TagRule(*r) for r in shared.value]
        needed = list(dict.fromkeys(r.needs for r in own if r.needs))
        automaton = _automaton(needed)
        compiled = [(re.compile(r.pattern), re.compile(r.apart) if r.apart else None) for r in own]
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = t.as_py() or ""
                if len(body.strip()) < shortest:
                    continue
                met = {needed[i] for i, _, _ in _hits(automaton, _lowered(body), False)}
                seen, spans = set(), {}
                for r, (pattern, apart) in zip(own, compiled, strict=True):
                    if (r.relation, r.concept) in seen or (r.needs and r.needs not in met):
                        continue
                    barred = spans.get(r.outside, ())
                    for m in pattern.finditer(body):
                        if any(m.start() < e and s < m.end() for s, e in barred) or (apart and apart.search(body[max(0, m.start() - r.window) : m.end() + r.window])):
                            continue
                        seen.add((r.relation, r.concept))
                        spans.setdefault(r.relation, []).append((m.start(), m.end()))
                        rows.append((k, r.relation, r.concept, r.confidence, " ".join(body[max(0, m.start() - 60) : m.end() + 80].split()), m.start()))
                        break
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], [key, "relation", "concept", "confidence", "evidence", "place"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(tag, f"`{key}` {kind}, relation string, concept string, confidence double, evidence string, place int")
