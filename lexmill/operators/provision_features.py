"""What a provision is about, its role and type, from its text; and a re-ranking of a query's pool by these, as columns.

A vocabulary (commodities, words that make another product of one, words that do not) is a parameter. Columns of a pool: query, item, score, text, title, and
optionally ce (a second score), clause, section, parent, position; of a question: entity, intent, wanted (provision type), parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Wording of standards, measurements, table rows, clause numbers, and of the other roles in order.
STANDARD = r"(?i)\bshall\s+conform\b|\bconform\s+to\b|\brequirements?\b|\bshall\s+comply\b|\bshall\s+meet\b|\bstandards?\b|\bshall\s+not\s+exceed\b|\bnot\s+(?:more|less)\s+than\b|\bmaximum\b|\bminimum\b|\bper\s+cent(?:um)?\s+by\s+weight\b|\bpercent(?:age)?\s+by\s+weight\b"
MEASUREMENT = r"(?i)\b(?:not\s+more\s+than|not\s+less\s+than|maximum|minimum|per\s+cent|percent|mg/kg|ppm)\b"
TABLE_ROW = r"(?i)\((?:[ivx]+|\d+)\)\s+\w"
CLAUSE_LEAD = r"^\s*\d{1,2}\.\d{1,3}(?:\.\d{1,3})?\s*[:.]?\s*"
DEFINITION_HEAD = r"^\s*\d{1,2}\.\d{1,3}(?:\.\d{1,3})?\s*[:.]\s*"
MEANS = r"(?i)\bmeans\b"
ROLES = (
    ("sampling", r"(?i)\bsampl(?:e|es|ing)\b|sealed|divided into"),
    ("licensing", r"(?i)\blicen[cs]e\b|\bregistration\b"),
    ("penalty", r"(?i)\bpenalt(?:y|ies)\b|\bpunish\w*\b|\bfine\b|\bimprisonment\b"),
    ("prohibition", r"(?i)\bprohibit\w*\b|\bno\s+person\s+shall\b"),
    ("procedure", r"(?i)\bprocedure\b|\bmanner\s+of\b"),
    ("scope", r"(?i)\bapplies\s+to\b|\bextend\w*\s+to\b"),
)
# Which roles satisfy an intent, and the words of a provision.
INTENTS = {
    "food_standard": ("standard", "limit"), "requirement": ("standard", "requirement", "limit"), "parameter_specific_standard": ("standard", "limit"), "compliance": ("standard", "limit"),
    "definition": ("definition",), "prohibition": ("prohibition",), "licensing": ("licensing",), "sampling": ("sampling",), "procedure": ("procedure",), "penalty": ("penalty",), "scope": ("scope",), "general_information": ("general",),
}
STANDARD_INTENTS = ("food_standard", "requirement", "parameter_specific_standard", "compliance")
WEIGHTS = {"ce": 0.40, "dense": 0.15, "entity": 0.20, "intent": 0.25, "prov": 0.10, "legal": 0.05, "parent": 0.10, "lex": 0.15, "param": 0.20}
FOREIGN_CAP = 0.45


@dataclass(frozen=True)
class Vocabulary:
    """Commodities; words before or behind one that make it another product; words of its forms that do not. lexicon: words of a standard's text."""

    commodities: tuple[str, ...]
    products: tuple[str, ...] = ()
    modifiers: tuple[str, ...] = ()
    heads: tuple[str, ...] = ()
    forms: tuple[str, ...] = ()
    lexicon: tuple[str, ...] = field(default=("shall conform", "standard", "requirement", "not more than", "not less than", "maximum", "minimum"))


def commodity(text: Column, v: Vocabulary) -> Column:
    """The first commodity of a heading, the opening 160 characters: joined with a head before it or a product, modifier or commodity behind it, which make it a
    product of its own; else a commodity of several words; else null."""
    opening = F.substring(F.coalesce(text, F.lit("")), 1, 160)
    words = F.transform(F.regexp_extract_all(F.regexp_replace(opening, r"\([^)]*\)", " "), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    known = [c for c in v.commodities if " " not in c]

    def first(tokens: Column) -> Column:
        at = F.array_min(F.array_compact(F.transform(tokens, lambda w, i: F.when(w.isin(known), i))))
        own, before, after = F.get(tokens, at), F.get(tokens, at - 1), F.get(tokens, at + 1)
        joined = after.isin(*v.products, *v.modifiers, *known) & (after != own)
        return F.when(before.isin(list(v.heads)), F.concat_ws(" ", before, own)).when(joined, F.concat_ws(" ", own, after)).otherwise(own)

    several = [F.when(F.lower(opening).rlike(rf"\b{c}\b"), F.lit(c)) for c in v.commodities if " " in c]
    return F.coalesce(F.get(F.transform(F.array(words), first), 0), *several)


def role(text: Column) -> Column:
    """definition, standard, one of the other roles by its wording, or general."""
    means, rows, standard = text.rlike(MEANS), text.rlike(TABLE_ROW), text.rlike(STANDARD)
    out = F.when(means & ~standard & ~rows, "definition").when(standard | rows, "standard")
    for name, pattern in ROLES:
        out = out.when(text.rlike(pattern), name)
    return out.when(means, "definition").otherwise("general")


def provision_metadata(chunks: DataFrame, v: Vocabulary) -> DataFrame:
    """Adds commodity, document_role, provision_type, section_key, table, has_measurement, row_count to rows with text, clause and section; what is not known is ``unknown``."""
    text = F.coalesce("text", F.lit(""))
    kind = F.col("document_role")
    rows = F.size(F.regexp_extract_all(text, F.lit(TABLE_ROW), F.lit(0)))
    measured = text.rlike(MEASUREMENT)
    own = chunks.withColumn("commodity", F.coalesce(commodity(text, v), F.lit("unknown"))).withColumn("document_role", role(text)).withColumn("row_count", rows).withColumn("has_measurement", measured)
    typed = F.when(kind == "standard", F.when(F.col("clause").isNotNull(), "food_standard").otherwise("standard")).when(kind.isin("definition", "prohibition", "licensing", "penalty", "procedure", "sampling", "scope"), kind).otherwise("general")
    table = F.when((F.col("row_count") >= 2) | ((F.col("row_count") >= 1) & F.col("has_measurement")), F.concat(F.lit("requirements table ("), F.col("row_count").cast("string"), F.lit(" rows)"))).otherwise("unknown")
    return own.withColumn("provision_type", typed).withColumn("table", table).withColumn("section_key", F.coalesce(F.col("clause").cast("string"), F.col("section").cast("string"), F.lit("unknown")))


def agrees(derived: Column, entity: Column, v: Vocabulary) -> Column:
    """Whether two commodity names mean the same: equal, or one holds the other and no word that is left makes another product."""
    left = F.when(derived.contains(entity), F.replace(derived, entity, F.lit(" "))).when(entity.contains(derived), F.replace(entity, derived, F.lit(" ")))
    others = F.split(F.trim(left), r"\s+")
    telling = F.exists(others, lambda w: w.isin(*v.products, *v.modifiers, *v.heads, *v.commodities))
    return F.coalesce((derived == entity) | (left.isNotNull() & ~telling), F.lit(False))


def mentions(text: Column, entity: Column, v: Vocabulary) -> Column:
    """Whether a text names the commodity itself: not behind a head, not before a product, modifier or other commodity."""
    other = "|".join([*v.products, *v.modifiers, *[c for c in v.commodities if " " not in c]])
    behind = rf"(?!\s+(?!(?:{'|'.join(v.forms) or '-'})\b)(?:{other})\b)"
    before = rf"(?<!\b(?:{'|'.join(v.heads) or '-'})\s)"
    return F.coalesce(F.regexp_like(F.lower(text), F.concat(F.lit(before + r"\b"), F.regexp_replace(F.lower(entity), r"([^\w\s])", r"\\$1"), F.lit(r"\b" + behind))), F.lit(False))


def legal_features(pool: DataFrame, v: Vocabulary) -> DataFrame:
    """Adds the features to a pool with its metadata and its question's entity, intent, wanted and parameters (an array)."""
    text, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    entity, intent, wanted = F.lower(F.trim("entity")), F.col("intent"), F.col("wanted")
    asks_standard = intent.isin(*STANDARD_INTENTS)
    tabular = text.rlike(CLAUSE_LEAD) | text.rlike(TABLE_ROW) | F.col("has_measurement")
    compatible = (F.col("commodity") == "unknown") | agrees(F.col("commodity"), entity, v)
    named = compatible & (mentions(text, entity, v) | mentions(F.coalesce("title", F.lit("")), entity, v))
    clause = Window.partitionBy("query", "clause")
    # A clause's commodity is that of its heading; rows of its table inherit it.
    heading = F.min_by(F.when(F.col("commodity") != "unknown", F.col("commodity")), F.when(text.rlike(CLAUSE_LEAD) & (F.col("commodity") != "unknown"), F.col("position"))).over(clause)
    inherits = F.col("clause").isNotNull() & F.coalesce(agrees(heading, entity, v), F.lit(False)) & tabular
    rows = pool.withColumn("f_entity", F.when(entity.isNull() | (entity == ""), 0.0).when(named, 1.0).when(inherits, 0.9).otherwise(0.0))
    standard = text.rlike(STANDARD) | ((F.col("row_count") > 0) & F.col("has_measurement"))
    defines = text.rlike(MEANS) & ~F.col("has_measurement") & (F.col("row_count") == 0)
    head = text.rlike(DEFINITION_HEAD) & text.rlike(MEANS)
    # Another row than a heading carries the entity's standard.
    anchors = F.count_if(standard & (F.col("f_entity") > 0)).over(Window.partitionBy("query"))
    other_anchor = anchors - (standard & (F.col("f_entity") > 0)).cast("int") > 0
    satisfied = F.array_contains(F.coalesce(F.element_at(F.create_map(*[x for k, r in INTENTS.items() for x in (F.lit(k), F.array(*map(F.lit, r)))]), intent), F.array(F.lit("general"))), F.col("document_role"))
    first = F.coalesce(F.col("position") == 0, F.lit(False))
    fits = (
        F.when(asks_standard & head, F.when(other_anchor, 0.0).otherwise(0.9))
        .when(satisfied, F.when(standard & asks_standard, 1.0).when(intent == "definition", F.when(first, 1.0).otherwise(0.3)).otherwise(0.9))
        .when(asks_standard & defines, 0.0).when((intent == "definition") & standard, 0.1).otherwise(0.3)
    )
    kind = F.col("provision_type")
    prov = F.when((wanted == "general") | (kind == "general"), 0.5).when(kind == wanted, 1.0).when((wanted == "standard") & (kind == "food_standard"), 1.0).when((wanted == "standard") & kind.isin("licensing", "procedure", "sampling", "penalty"), 0.1).otherwise(0.4)
    legal = F.when(F.col("section_key") == "unknown", 0.0).when((intent == "parameter_specific_standard") & F.col("section_key").rlike(r"^\d{1,2}\.\d"), 1.0).otherwise(0.6)
    hits = sum((low.contains(w).cast("int") for w in v.lexicon), F.lit(0))
    lexical = F.when(~asks_standard | ((F.coalesce(entity, F.lit("")) != "") & (F.col("f_entity") == 0)), 0.0).otherwise(F.least(hits / 3, F.lit(1.0)))
    holds = F.exists(F.coalesce("parameters", F.array().cast("array<string>")), lambda p: low.contains(F.lower(p)))
    parameter = F.when(holds, F.when(F.col("has_measurement"), 1.0).otherwise(0.5)).otherwise(0.0)
    named = {"f_intent": fits, "f_prov": prov, "f_legal": legal, "f_parent": F.coalesce(F.col("parent_in_context").cast("double"), F.lit(0.0)), "f_lex": lexical, "f_param": parameter}
    return rows.withColumns(named)


def _spread(score: Column, by) -> Column:
    """Smallest to largest as 0 to 1; all alike are 0.5."""
    low, high = F.min(score).over(by), F.max(score).over(by)
    return F.when(high - low <= 1e-9, 0.5).otherwise((score - low) / (high - low))


def legal_rerank(pool: DataFrame, v: Vocabulary, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(query, item, rank, score) of a pool with features: their weighted sum with the spread scores. Where a row of the pool has the entity, rows that have nothing of it
    stay under FOREIGN_CAP; for a definition, later definitions of the entity stay at or below its leading one."""
    w, by = WEIGHTS | (weights or {}), Window.partitionBy("query")
    rows = legal_features(pool, v)
    ce = F.when(F.count("ce").over(by) == 0, 0.5).otherwise(_spread(F.coalesce("ce", F.lit(0.0)), by))
    dense = F.when(F.count("*").over(by) == 1, 1.0).otherwise(_spread(F.col("score"), by))
    total = w["ce"] * ce + w["dense"] * dense + sum((w[n] * F.col(f"f_{n}") for n in ("entity", "intent", "prov", "legal", "parent", "lex", "param")), F.lit(0.0))
    scored = rows.withColumn("_total", F.round(total, 9))
    lead = F.max(F.when((F.col("f_entity") > 0) & (F.col("position") == 0), F.col("_total"))).over(by)
    later = (F.col("intent") == "definition") & (F.col("f_entity") > 0) & ~F.coalesce(F.col("position") == 0, F.lit(False)) & (F.col("document_role") == "definition")
    capped = F.when(later & lead.isNotNull(), F.least(F.col("_total"), lead)).otherwise(F.col("_total"))
    any_match = F.max("f_entity").over(by) > 0
    foreign = (F.coalesce(F.trim("entity"), F.lit("")) != "") & any_match & (F.col("f_entity") == 0)
    final = scored.withColumn("_final", F.when(foreign, F.least(capped, F.lit(FOREIGN_CAP))).otherwise(capped))
    rank = F.row_number().over(by.orderBy(F.desc("_final"), F.asc_nulls_last("position"), "item"))
    return final.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "item", "rank", F.round("_final", 6).alias("score"))
