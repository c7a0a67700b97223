"""References, hierarchy, classification, dates and quality from text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- sections and hierarchy ---


def section_chain(c: Column) -> Column:
    """``31(2)(a)`` as [31, 2, a]; empty where no number leads."""
    base = F.regexp_extract(c, r"^\s*(\d{1,4})", 1)
    rest = F.regexp_replace(c, r"^\s*\d{1,4}", "")
    inner = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNull() | (base == ""), F.array().cast("array<string>")).otherwise(F.concat(F.array(base), inner))


def chain_depth(chain: Column) -> Column:
    """1 without a section, then 3, 4, and 5 for a clause or deeper."""
    n = F.size(chain)
    return F.when(n == 0, 1).when(n == 1, 3).when(n == 2, 4).otherwise(5)


def chain_relation(a: Column, b: Column) -> Column:
    """exact, parent, child, sibling, adjacent, same_family or none. Neighbouring base numbers are adjacent at any depth."""
    n, m = F.size(a), F.size(b)
    shorter = F.least(n, m)
    equal = F.zip_with(F.slice(a, 1, F.greatest(shorter, F.lit(0))), F.slice(b, 1, F.greatest(shorter, F.lit(0))), lambda x, y: x == y)
    prefix = F.aggregate(equal, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    close = F.abs(F.get(a, 0).cast("int") - F.get(b, 0).cast("int")) == 1
    return (
        F.when((n == 0) | (m == 0), "none")
        .when(a == b, "exact")
        .when(prefix == 0, F.when(close, "adjacent").otherwise("none"))
        .when((prefix == shorter) & (n < m), "parent")
        .when((prefix == shorter) & (n > m), "child")
        .when((n == m) & (prefix == n - 1), "sibling")
        .otherwise("same_family")
    )


def relation_score(relation: Column) -> Column:
    return F.when(relation == "exact", 1.0).when(relation.isin("parent", "child"), 0.75).when(relation.isin("sibling", "same_family"), 0.5).when(relation == "adjacent", 0.25).otherwise(0.0)


def sections_in(c: Column) -> Column:
    """All section numbers that a text names, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)\bsections?\s+(\d{1,4}(?:\([0-9a-z]+\))*)"), F.lit(1)))


#: (kind, confidence, pattern) of references; the longer patterns come first.
REFERENCES = (
    ("section", "HIGH", r"(?i)\bsections?\s+\d{1,4}(?:\([0-9a-z]+\))*"),
    ("rule", "HIGH", r"(?i)\brules?\s+\d{1,4}(?:\([0-9a-z]+\))*"),
    ("schedule", "MEDIUM", r"(?i)\bschedule\s+(?:[ivxlc]+|\d{1,3})\b"),
    ("chapter", "MEDIUM", r"(?i)\bchapter\s+(?:[ivxlc]+|\d{1,3})\b"),
    ("relation", "LOW", r"(?i)\b(?:read with|subject to|notwithstanding|as amended by)\b"),
)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once a row however often it is used; inside array functions Spark computes it again at each use."""
    return F.get(F.transform(F.array(value), use), 0)


def match_spans(text: Column, pattern: str, kind: str, confidence: str) -> Column:
    """Array of (start, end, kind, confidence, raw) of a pattern's matches: match i follows i + 1 gaps and i matches."""
    later = lambda done, p: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + F.length(p["gap"]) + F.length(p["m"])

    def spans(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array().cast("array<int>"), lambda done, p: F.concat(done, F.array(later(done, p))))
        return F.zip_with(parts, ends, lambda p, end: F.struct((end - F.length(p["m"])).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), p["m"].alias("raw")))

    # A text without a match is not split.
    parts = lambda found: F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(found, lambda x: F.when(F.size(x) > 0, bound(parts(x), spans)).when(x.isNotNull(), F.array().cast(_SPANS)))


_SPANS = "array<struct<start:int,end:int,kind:string,confidence:string,raw:string>>"


def references_in(text: Column, least: str = "LOW") -> Column:
    """All references by start; of overlapping ones the kind that REFERENCES lists first stays."""
    order = ("HIGH", "MEDIUM", "LOW")
    kept = [r for r in REFERENCES if order.index(r[1]) <= order.index(least)]
    # Each kind is bound before the next is held against it.
    rest = lambda out, kinds: out if not kinds else bound(out, lambda before: rest(F.concat(before, _apart(bound_spans(kinds[0]), before)), kinds[1:]))
    bound_spans = lambda r: match_spans(text, r[2], r[0], r[1])
    return F.array_sort(rest(bound_spans(kept[0]), kept[1:]))


def _apart(own: Column, before: Column) -> Column:
    return F.filter(own, lambda s: ~F.exists(before, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


# --- classification by rules: (name, pattern) in order ---


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The first rule whose pattern the text matches."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in rules], F.lit(default).cast("string"))


def most_matches(text: Column, labels: list[tuple[str, list[str]]], none: str) -> Column:
    """The label most of whose patterns match, the first of equals; ``none`` where no pattern matches."""
    counts = [(name, sum((F.coalesce(text.rlike(p).cast("int"), F.lit(0)) for p in patterns), F.lit(0))) for name, patterns in labels]
    best = F.greatest(*[n for _, n in counts])
    return F.when(best == 0, none).otherwise(F.coalesce(*[F.when(n == best, F.lit(name)) for name, n in counts]))


def keyword_votes(text: Column, families: dict[str, list[str]], default: str, base: float = 1.0, step: float = 0.5) -> Column:
    """Scores by family, highest first: the default starts at base, every family gains a step per keyword."""
    lower = F.lower(text)
    scores = [F.struct((F.lit(-base if name == default else 0.0) - step * sum((lower.contains(k).cast("int") for k in words), F.lit(0))).alias("s"), F.lit(name).alias("name")) for name, words in families.items()]
    return F.transform(F.array_sort(F.array(*scores)), lambda x: F.struct(x["name"].alias("name"), (-x["s"]).alias("score")))


def numerics(text: Column) -> Column:
    """The distinct numbers of a text, thousands separators taken out, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"\.0+$", "")))


def claims(text: Column) -> Column:
    """Sentences of three words at least."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 3)


def supports(claim: Column, evidence: Column) -> Column:
    """Whether the evidence can bear the claim: no number that it lacks, and no opposite polarity."""
    missing = F.size(F.array_except(numerics(claim), numerics(evidence)))
    negative = lambda c: F.lower(c).rlike(r"\b(not|no|never|prohibited|forbidden)\b")
    return (missing == 0) & (negative(claim) == negative(evidence))


def citations(text: Column) -> Column:
    """Numbers of ``[3]`` and ``[Source 3]`` citations, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(?:Source\s+)?(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def abstains(text: Column, lexicon: tuple[str, ...] = ("cannot answer", "no information", "not enough evidence", "insufficient"), least: int = 20) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    said = F.lit(False)
    for phrase in lexicon:
        said = said | lower.contains(phrase)
    return (F.length(F.trim(lower)) < least) | said


def keywords(text: Column, most: int = 12) -> Column:
    """Title-case words, each once, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{3,}\b"), F.lit(0))), 1, most)


def date_candidates(text: Column, most: int = 10) -> Column:
    pattern = r"\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}"
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, most)


def script_of(text: Column) -> Column:
    """(language, confidence) by script: English when over half of the letters are Latin, else the script with most."""
    count = lambda p: F.length(F.regexp_replace(text, f"[^{p}]", ""))
    latin, deva, beng = count("A-Za-z"), count("ऀ-ॿ"), count("ঀ-৿")
    total = latin + deva + beng
    name = F.when((total == 0) | (latin * 2 > total), "English").when(deva >= beng, "Hindi").otherwise("Bengali")
    share = F.when(total == 0, 0.5).otherwise(F.least(F.lit(0.95), F.greatest(latin, deva, beng) / total))
    return F.struct(name.alias("language"), F.round(share, 6).alias("confidence"))


def chunk_quality(text: Column, short: int = 50, long: int = 4000) -> Column:
    """From 0.7: 0.3 less if short, 0.1 if very long, 0.1 without an end; 0.2 more with a reference; 0 to 1."""
    score = 0.7 - 0.3 * (F.length(text) < short).cast("int") - 0.1 * (F.length(text) > long).cast("int") - 0.1 * (~text.rlike(r"[.!?;:]\s*$")).cast("int") + 0.2 * text.rlike(r"(?i)\bsection\s+\d").cast("int")
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def grade(score: Column) -> Column:
    return F.when(score >= 0.85, "A").when(score >= 0.7, "B").when(score >= 0.5, "C").when(score >= 0.3, "D").otherwise("F")


def method_score(base: Column, agreeing: Column, length: Column) -> Column:
    """A field's confidence: its method's base, more for consensus of the candidates and for a long text, 1 at most."""
    boost = F.when(agreeing >= 3, 0.10).when(agreeing == 2, 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), base + boost + F.when(length > 1000, 0.02).otherwise(0.0)), 6)


# --- query understanding ---


def canonical(value: Column, aliases: dict[str, str]) -> Column:
    """Lower case with underscores, then an alias; null where neither is known."""
    key = F.translate(F.lower(F.trim(value)), "- ", "__")
    names = sorted({*aliases.values()})
    out = F.when(key.isin(*names), key)
    for alias, name in aliases.items():
        out = out.when(key == alias, name)
    return out


def identifier_query(text: Column, acts: dict[str, list[str]]) -> Column:
    """(act, section, form, query): what a question names outright; null where it names nothing."""
    lower = F.lower(text)
    hits = [(name, alias) for name, own in acts.items() for alias in [name.lower(), *own]]
    act = F.coalesce(*[F.when(lower.contains(alias), F.lit(name)) for name, alias in sorted(hits, key=lambda h: (-len(h[1]), h[1]))])
    section = F.nullif(F.regexp_extract(text, r"(?i)\bsection\s+(\d{1,4}(?:\([0-9a-z]+\))*)", 1), F.lit(""))
    form = F.when(act.isNotNull() & section.isNotNull(), "act_section").when(act.isNotNull(), "act_only").when(section.isNotNull(), "section_only")
    query = F.concat_ws(" section ", act, section)
    return F.when(form.isNotNull(), F.struct(act.alias("act"), section.alias("section"), form.alias("form"), query.alias("query")))


def subqueries(text: Column, most: int = 4) -> Column:
    """One query per named section if there are two and a conjunction; else the question itself."""
    named = sections_in(text)
    several = (F.size(named) >= 2) & F.lower(text).rlike(r"\b(and|or|versus)\b|,")
    return F.when(several, F.transform(F.slice(named, 1, most), lambda s: F.concat(F.lit("Section "), s, F.lit(" provisions")))).otherwise(F.array(text))


def difficulty(text: Column) -> Column:
    """0 to 7: one each for length, several sections, conjunction, comparison, time, exception and negation."""
    lower = F.lower(text)
    signs = [F.size(F.split(text, r"\s+")) > 12, F.size(sections_in(text)) > 1, lower.rlike(r"\band\b"), lower.rlike(r"\b(compare|versus|difference)\b"), lower.rlike(r"\b(before|after|since|until)\b"), lower.rlike(r"\b(except|unless|exempt)"), lower.rlike(r"\b(not|never|without)\b")]
    return sum((F.coalesce(s.cast("int"), F.lit(0)) for s in signs), F.lit(0))


# --- citations of courts, statutes, sections, dates and registries ---

#: Fixed values: (class, confidence, pattern, normal form) of citations, in order; case does not matter. Null: the match itself, without parentheses around it.
CITATIONS = (
    ("supreme_court", 0.95, r"\((\d{4})\s*SC\s*(\d+)/(\d+)\)", "$1 SC $2/$3"),
    ("supreme_court", 0.95, r"\((\d{4})\s*Supreme\s*Court\s*(\d+)/(\d+)\)", "$1 SC $2/$3"),
    ("supreme_court", 0.95, r"\((\d{4})\s*SC\s*(\d+)\)", "$1 SC $2"),
    ("high_court", 0.90, r"\(Honorable\s+HC\s+(\d+)/(\d+)\)", None),
    ("high_court", 0.90, r"\(Hon'ble\s+HC\s+(\d+)/(\d+)\)", None),
    ("high_court", 0.90, r"\(Honorable\s+High\s*Court\s+(\d+)/(\d+)\)", None),
    ("high_court", 0.90, r"\(HC\s+(\d+)/(\d+)\)", None),
    ("high_court", 0.90, r"\(High\s*Court\s+(\d+)/(\d+)\)", None),
    ("section", 0.85, r"Section\s+(\d+(?:\(\d+\))?)", "$0"),
    ("section", 0.85, r"Clause\s+\(([a-z])\)", "$0"),
    ("section", 0.85, r"clause\s+(\d+(?:\(\d+\))?)", "$0"),
    ("date_reference", 0.75, r"\b(\d{2}/\d{2}/\d{4})\s*(?:to|-)\s*(\d{2}/\d{2}/\d{4})\b", "$0"),
    ("date_reference", 0.75, r"\b(\d{1,2}\s+\w+\s+\d{4})\b", "$0"),
    ("registry", 0.85, r"\b([A-Z]\s*\d+/\d{4})\b", "$0"),
)
#: Fixed values: (group of the name, pattern) of statutes, in order; case matters.
STATUTES = (
    (1, r"The\s+((?:Indian\s+)?[A-Z][A-Za-z]+(?:\s+(?:of|the|and|for|to|in|on|with|by|or)?\s?[A-Z][A-Za-z]+)*)(?:\s+(?:Act|Code|Statute|Law|Regulation))?"),
    (1, r"([A-Z][A-Za-z]+(?:\s+(?:of|the|and|for|to|in|on|with|by|or)?\s?[A-Z][A-Za-z]+)*)\s+(?:Act|Statute|Law|Regulation)\b"),
    (0, r"(?i:Constitution\s+of\s+India)"),
)
#: Fixed value: how amendment notices speak.
AMENDMENT = r"(?i)(for the words|shall be substituted|the following section shall be substituted|and after the words|in the marginal heading)"


def citations_by_class(text: Column) -> Column:
    """Array of (kind, confidence, source, normalized): all matches of each citation pattern, patterns in order; null text gives null."""

    def tagged(kind: str, confidence: float, pattern: str, form: str | None) -> Column:
        normal = (lambda m: F.btrim(m, F.lit("()"))) if form is None else (lambda m: F.trim(F.regexp_replace(m, f"(?i)^{pattern}$", form)))
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), m.alias("source"), normal(m).alias("normalized")))

    return F.concat(*[tagged(*c) for c in CITATIONS])


def statutes_cited(text: Column, least_words: int = 3) -> Column:
    """Array of (kind, confidence, source): statute names of so many different words at least, each once, constitutions apart.

    A match that starts before the end of the one accepted last is another reading of it and is left out.
    """
    def named(group: int, pattern: str) -> Column:
        return F.transform(match_spans(text, pattern, "", ""), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.trim(m["raw"]).alias("source"), F.regexp_extract(m["raw"], pattern, group).alias("name")))

    found = F.concat(*[named(*s) for s in STATUTES])
    nothing = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, m: Column) -> Column:
        key = F.regexp_replace(F.lower(m["source"]), "^the ", "")
        # One word over and over ("The The The The") names nothing.
        words = F.size(F.array_distinct(F.filter(F.split(F.lower(m["name"]), r"\s+"), lambda w: w != "")))
        ok = (m["start"] >= done["end"]) & (words >= least_words) & ~F.array_contains(done["seen"], key)
        return F.when(ok, F.struct(m["end"].alias("end"), F.array_append(done["seen"], key).alias("seen"), F.array_append(done["out"], m["source"]).alias("out"))).otherwise(done)

    names = F.aggregate(found, nothing, step, lambda d: d["out"])
    constitution = lambda n: F.lower(n).contains("constitution")
    return F.transform(names, lambda n: F.struct(F.when(constitution(n), "constitution").otherwise("statutory").alias("kind"), F.when(constitution(n), 0.85).otherwise(0.80).alias("confidence"), n.alias("source")))


def is_amendment_prose(text: Column) -> Column:
    """Whether a text speaks of a change to a provision instead of stating one; null is not."""
    return F.coalesce(text.rlike(AMENDMENT), F.lit(False))


#: An ordered list, its start, and a list inside one.
_LIST, _START, _INNER = r"(?is)<ol\b([^>]*)>(.*?)</ol>", r"(?i)(start\s*=\s*[\"']?)(\d+)([\"']?)", r"(?i)<ol\b"


def renumbered_lists(html: Column) -> Column:
    """``<ol class="justify" start="N">`` lists continue the numbers of the one before; texts whose first list starts elsewhere than at 1 stay."""
    found = F.regexp_extract_all(html, F.lit(_LIST), F.lit(0))
    gaps = F.split(html, _LIST, -1)

    def step(done: Column, m: Column) -> Column:
        attrs, inner = F.regexp_extract(m, _LIST, 1), F.regexp_extract(m, _LIST, 2)
        items = F.size(F.regexp_extract_all(inner, F.lit(r"(?i)<li\b"), F.lit(0)))
        counts = ~inner.rlike(_INNER) & attrs.rlike("class=(\"justify\"|'justify')") & (items > 0)
        number = (done["last"] + 1).cast("string")
        renewed = F.concat(F.lit("<ol"), F.regexp_replace(attrs, F.lit(_START), F.concat(F.lit("$1"), number, F.lit("$3"))), F.lit(">"), inner, F.lit("</ol>"))
        started = attrs.rlike(_START)
        return (
            F.when(counts & started, F.struct((done["last"] + items).alias("last"), F.array_append(done["out"], renewed).alias("out")))
            .when(counts, F.struct(items.alias("last"), F.array_append(done["out"], m).alias("out")))
            .otherwise(F.struct(done["last"].alias("last"), F.array_append(done["out"], m).alias("out")))
        )

    lists = F.aggregate(found, F.struct(F.lit(0).alias("last"), F.array().cast("array<string>").alias("out")), step, lambda d: d["out"])
    whole = F.array_join(F.zip_with(gaps, lists, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    first = F.regexp_extract(F.regexp_extract(F.get(found, 0), _LIST, 1), _START, 2)
    return F.when(first.isin("", "1", "01"), whole).otherwise(html)
