"""What a provision is and says, and what a question asks, each parsed once into a struct of views."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import extract as X
from lexmill.functions import metadata as M

EXCEPTION = r"(?i)\b(provided that|except|unless|exempted|notwithstanding)\b"
DEFINITION = r"(?i)\b(means|is defined as|includes)\b"
#: (kind, pattern) of questions, in order.
QUESTIONS = [("definition", r"(?i)\b(what is|define|meaning of)\b"), ("penalty", r"(?i)\b(penalty|punish|fine)\b"), ("procedure", r"(?i)\b(how to|procedure|apply)\b")]


def _known(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _written(chain: Column) -> Column:
    """[31, 2, a] as ``31(2)(a)``; null if empty."""
    inner = F.transform(F.slice(chain, 2, F.greatest(F.size(chain) - 1, F.lit(0))), lambda x: F.concat(F.lit("("), x, F.lit(")")))
    return F.when(F.size(chain) > 0, F.concat(F.get(chain, 0), F.array_join(inner, "")))


def cross_references(text: Column) -> Column:
    """Sections by number, rules and schedules by name and number, sorted, each once; null text gives an empty array."""
    text = F.coalesce(text, F.lit(""))
    rules = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\brule\s+(\d+(?:\.\d+)*)"), F.lit(1)), lambda r: F.concat(F.lit("Rule "), r))
    schedules = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bschedule\s+([ivxlc]+|\d+)\b"), F.lit(1)), lambda s: F.concat(F.lit("Schedule "), s))
    return F.array_sort(F.array_distinct(F.concat(X.sections_in(text), rules, schedules)))


def identity(act: Column, section: Column, text: Column) -> Column:
    """(act, section, subsection, clause, rule, schedule, chapter, canonical_id, parent_unit, cross_references, has_definition, has_exception).

    ``section`` is a reference such as ``Section 31(2)(a)``. Without a section the first rule, schedule or chapter of the text
    names the unit; with nothing known the id is UNKNOWN. What is missing stays null, nothing is made up.
    """
    chain = X.section_chain(F.regexp_replace(section, r"(?i)^\s*sec(?:tion)?\.?\s*", ""))
    rest = F.slice(chain, 3, F.greatest(F.size(chain) - 2, F.lit(0)))
    rule = _known(F.regexp_extract(text, r"(?i)\brule\s+(\d+(?:\.\d+)*)", 1))
    schedule = _known(F.regexp_extract(text, r"(?i)\bschedule\s+([ivxlc]+|\d+)\b", 1))
    chapter = _known(F.regexp_extract(text, r"(?i)\bchapter\s+([ivxlc]+|\d+)\b", 1))
    unit = F.coalesce(_written(chain), F.concat(F.lit("Rule "), rule), F.concat(F.lit("Schedule "), schedule), F.concat(F.lit("Chapter "), chapter))
    parent = _written(F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0))))
    return F.struct(
        act.alias("act"),
        F.get(chain, 0).alias("section"),
        F.get(chain, 1).alias("subsection"),
        rest.alias("clause"),
        rule.alias("rule"),
        schedule.alias("schedule"),
        chapter.alias("chapter"),
        F.coalesce(_known(F.concat_ws("::", act, unit)), F.lit("UNKNOWN")).alias("canonical_id"),
        F.when(parent.isNotNull(), F.concat_ws("::", act, parent)).alias("parent_unit"),
        cross_references(text).alias("cross_references"),
        F.coalesce(text.rlike(DEFINITION), F.lit(False)).alias("has_definition"),
        F.coalesce(text.rlike(EXCEPTION), F.lit(False)).alias("has_exception"),
    )


def understood(text: Column, acts: dict[str, list[str]]) -> Column:
    """(kind, act, section, subsection, form, identifier, difficulty, subqueries) of a question; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    named = X.identifier_query(text, acts)
    chain = X.section_chain(named["section"])
    return F.struct(
        X.first_rule(text, QUESTIONS, "general").alias("kind"),
        named["act"].alias("act"),
        F.get(chain, 0).alias("section"),
        F.get(chain, 1).alias("subsection"),
        M.form_query(text).alias("form"),
        named["query"].alias("identifier"),
        X.difficulty(text).alias("difficulty"),
        X.subqueries(text).alias("subqueries"),
    )


#: (relation, concept, confidence, pattern, relation whose match it must stay out of) in order of precedence.
TAGS = (
    ("prohibits", "prohibition", 0.9, r"(?i)\bshall\s+not\b", None),
    ("prohibits", "prohibition", 0.85, r"(?i)\bno\s+person\s+shall\b", None),
    ("penalises", "penalty", 0.9, r"(?i)\bpunishable\s+with\b", None),
    ("empowers", "power", 0.8, r"(?i)\bpower\s+to\b", None),
    ("obliges", "duty", 0.75, r"(?i)\bshall\b", "prohibits"),
)


def _outside(barred: list[Column]):
    """A test that a span overlaps none of these, which may be null."""
    overlaps = lambda s, b: F.coalesce((s["start"] < b["end"]) & (b["start"] < s["end"]), F.lit(False))
    return lambda s: ~functools.reduce(Column.__or__, [overlaps(s, b) for b in barred])


def semantic_tags(text: Column, rules: tuple = TAGS, least: float = 0.7, shortest: int = 40) -> Column:
    """Array of (relation, concept, confidence, evidence): of each relation and concept the first rule that matches.

    A rule that must stay out of a relation takes its first match that overlaps none of that relation's. Evidence is the match
    with 60 characters before and 80 behind, white space collapsed. Null and short texts have no tags.
    """
    wanted = [r for r in rules if r[2] >= least]
    none = F.array().cast("array<struct<relation:string,concept:string,confidence:double,evidence:string>>")
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) >= shortest, _tagged(text, wanted, {})).otherwise(none)


def _tagged(text: Column, rules: list[tuple], found: dict[tuple[str, str], Column]) -> Column:
    """The tags of what is found so far and of further rules; each rule's match is bound before the next is looked for."""
    if not rules:
        return F.array_compact(F.array(*[_tag(text, relation, concept, s) for (relation, concept), s in found.items()]))
    (relation, concept, confidence, pattern, out_of), rest = rules[0], rules[1:]
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"), F.lit(confidence).cast("double").alias("confidence"))
    barred = [s for (r, _), s in found.items() if r == out_of]
    if barred:
        free = F.get(F.filter(X.match_spans(text, pattern, relation, ""), _outside(barred)), 0)
        hit = X.bound(free, lambda m: F.when(m.isNotNull(), span(m["start"], m["end"])))
    else:
        hit = X.bound(F.regexp_instr(text, F.lit(pattern)), lambda at: F.when(at > 0, span(at - 1, at - 1 + F.length(F.regexp_extract(text, pattern, 0)))))
    key = (relation, concept)
    # A later rule of the same tag is looked for only where the earlier ones are not found.
    hit = F.coalesce(found[key], hit) if key in found else hit
    return X.bound(hit, lambda s: _tagged(text, rest, found | {key: s}))


def _tag(text: Column, relation: str, concept: str, s: Column) -> Column:
    first = F.greatest(s["start"] - 60, F.lit(0))
    evidence = F.trim(F.regexp_replace(F.substring(text, first + 1, s["end"] + 80 - first), r"\s+", " "))
    return F.when(s.isNotNull(), F.struct(F.lit(relation).alias("relation"), F.lit(concept).alias("concept"), s["confidence"].alias("confidence"), evidence.alias("evidence")))
