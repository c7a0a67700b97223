"""Identity of provisions, questions parsed once, semantic tags, edges from text, evidence bundles and task coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import identity as N
from lexmill.operators import evidence as E
from lexmill.operators import phrases as H
from lexmill.operators import provisions as P
from lexmill.plans._registering import register
from lexmill.plans.retrieval_queries import _tokens

#: Documents name no provisions, so each is read with some of its own behind its text.
NAMED = """coalesce(text, '') || CASE WHEN doc_id % 5 < 3 THEN ' Under Rule ' || (doc_id % 11) || '.2 and Schedule iv it is due' ELSE '' END
|| CASE WHEN doc_id % 7 < 3 THEN ', unless section ' || (1 + doc_id % 90) || '(3) or sections 12 so provide' ELSE '' END || CASE WHEN doc_id % 4 = 1 THEN '; Chapter II means the second' ELSE '' END"""
ACT = "CASE doc_id % 3 WHEN 0 THEN 'Act ' || lang WHEN 1 THEN 'FSA' END"
SECTION = "CASE doc_id % 6 WHEN 0 THEN 'Section ' || (1 + doc_id % 97) || '(2)(a)' WHEN 1 THEN CAST(1 + doc_id % 97 AS STRING) WHEN 2 THEN ' sec. 4 (1)' WHEN 3 THEN 'Annex' WHEN 4 THEN '7(2)(b)( iii )()' END"


@register("provision_identity", rf"""WITH d AS (SELECT doc_id, {ACT} AS act, regexp_replace({SECTION}, '(?i)^\s*sec(?:tion)?\.?\s*', '') AS bare, {NAMED} AS t FROM documents),
c AS (SELECT doc_id, act, t, CASE WHEN regexp_matches(bare, '^\s*\d') THEN [regexp_extract(bare, '^\s*(\d+)', 1)] || list_filter(list_transform(regexp_extract_all(bare, '\(([^()]*)\)', 1), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS c,
 nullif(regexp_extract(t, '(?i)\brule\s+(\d+(?:\.\d+)*)', 1), '') AS rule, nullif(regexp_extract(t, '(?i)\bschedule\s+([ivxlc]+|\d+)\b', 1), '') AS schedule, nullif(regexp_extract(t, '(?i)\bchapter\s+([ivxlc]+|\d+)\b', 1), '') AS chapter FROM d),
u AS (SELECT *, CASE WHEN len(c) > 0 THEN c[1] || coalesce(array_to_string(list_transform(c[2:], lambda x: '(' || x || ')'), ''), '') END AS whole, CASE WHEN len(c) > 1 THEN c[1] || coalesce(array_to_string(list_transform(c[2:-2], lambda x: '(' || x || ')'), ''), '') END AS above FROM c)
SELECT doc_id, act, c[1] AS section, c[2] AS subsection, c[3:] AS clause, rule, schedule, chapter,
coalesce(nullif(concat_ws('::', act, coalesce(whole, 'Rule ' || rule, 'Schedule ' || schedule, 'Chapter ' || chapter)), ''), 'UNKNOWN') AS canonical_id, CASE WHEN above IS NOT NULL THEN concat_ws('::', act, above) END AS parent_unit,
list_sort(list_distinct(regexp_extract_all(t, '(?i)\bsections?\s+(\d{{1,4}}(?:\([0-9a-z]+\))*)', 1) || list_transform(regexp_extract_all(t, '(?i)\brule\s+(\d+(?:\.\d+)*)', 1), lambda r: 'Rule ' || r) || list_transform(regexp_extract_all(t, '(?i)\bschedule\s+([ivxlc]+|\d+)\b', 1), lambda s: 'Schedule ' || s))) AS cross_references,
regexp_matches(t, '{N.DEFINITION}') AS has_definition, regexp_matches(t, '{N.EXCEPTION}') AS has_exception FROM u""", "documents")
def provision_identity(docs: DataFrame) -> DataFrame:
    parsed = docs.select("doc_id", F.expr(ACT).alias("act"), F.expr(SECTION).alias("section"), F.expr(NAMED).alias("t"))
    return parsed.select("doc_id", N.identity(F.col("act"), F.col("section"), F.col("t")).alias("i")).select("doc_id", "i.*")


ASKED = "coalesce(text, '') || CASE turn % 4 WHEN 0 THEN ' What is the penalty in Section ' || (1 + conv_id % 90) || '(2) of the Food Act, and not in Section 5?' WHEN 1 THEN ' How to apply for Form ' || (1 + conv_id % 9) || 'a?' WHEN 2 THEN ' compare the fine under the food act since 2011' ELSE '' END"
_NAMED = r"regexp_extract_all(t, '(?i)\bsections?\s+(\d{1,4}(?:\([0-9a-z]+\))*)', 1)"
_SECTIONS = f"list_filter({_NAMED}, lambda x, i: list_position({_NAMED}, x) = i)"


@register("understood_questions", rf"""WITH q AS (SELECT conv_id, turn, {ASKED} AS t FROM conversations),
p AS (SELECT *, {_SECTIONS} AS all_sections, CASE WHEN contains(lower(t), 'food act') THEN 'Food Act' END AS act, nullif(regexp_extract(t, '(?i)\bsection\s+(\d{{1,4}}(?:\([0-9a-z]+\))*)', 1), '') AS named FROM q)
SELECT conv_id, turn, CASE {' '.join(f"WHEN regexp_matches(t, '{pattern}') THEN '{kind}'" for kind, pattern in N.QUESTIONS)} ELSE 'general' END AS kind, act, regexp_extract(named, '^(\d+)', 1) AS section, nullif(regexp_extract(named, '\((\w+)\)', 1), '') AS subsection,
'form ' || upper(nullif(regexp_extract(t, '(?i)\bform\s+([A-Z]{{1,3}}|\d{{1,3}}[A-Z]?)\b', 1), '')) AS form, CASE WHEN act IS NOT NULL OR named IS NOT NULL THEN concat_ws(' section ', act, named) END AS identifier,
((len(regexp_split_to_array(t, '\s+')) > 12)::INT + (len(all_sections) > 1)::INT + regexp_matches(lower(t), '\band\b')::INT + regexp_matches(lower(t), '\b(compare|versus|difference)\b')::INT + regexp_matches(lower(t), '\b(before|after|since|until)\b')::INT + regexp_matches(lower(t), '\b(except|unless|exempt)')::INT + regexp_matches(lower(t), '\b(not|never|without)\b')::INT) AS difficulty,
CASE WHEN len(all_sections) >= 2 AND regexp_matches(lower(t), '\b(and|or|versus)\b|,') THEN list_transform(all_sections[1:4], lambda s: 'Section ' || s || ' provisions') ELSE [t] END AS subqueries FROM p""", "conversations")
def understood_questions(turns: DataFrame) -> DataFrame:
    asked = turns.select("conv_id", "turn", F.expr(ASKED).alias("t"))
    return asked.select("conv_id", "turn", N.understood(F.col("t"), {"Food Act": []}).alias("u")).select("conv_id", "turn", "u.*")


#: The middle of a text is repeated behind the words of the law, so evidence has text on both sides.
RULED = "coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' no person shall sell it' WHEN 1 THEN ' It Shall  Not be sold; the seller shall tell. ' WHEN 2 THEN ' is punishable with a fine and has the power to pay' WHEN 3 THEN ' the seller shall tell' WHEN 4 THEN ' he shall tell and shall not sell ' ELSE '' END || substr(coalesce(text, ''), 1, 100)"


def _tag_sql() -> str:
    first = "struct_pack(s := length(regexp_extract(t, '(?is)^(.*?){p}', 1)), n := length(regexp_extract(t, '(?i){p}', 0)))"
    by_concept: dict[tuple[str, str], str] = {}
    for relation, concept, confidence, pattern, out_of in N.TAGS:
        at = first.replace("{p}", pattern.removeprefix("(?i)").join(("(?:", ")")))
        hit = f"WHEN regexp_matches(t, '{pattern}') THEN struct_pack(c := {confidence}::DOUBLE, h := {at})"
        if out_of is None:
            by_concept[relation, concept] = by_concept.get((relation, concept), "") + " " + hit
    firsts = ", ".join(f"CASE {hits} END AS {relation}" for (relation, _), hits in by_concept.items())
    duty = r"""CASE WHEN prohibits IS NULL THEN CASE WHEN regexp_matches(t, '(?i)\bshall\b') THEN struct_pack(c := 0.75::DOUBLE, h := struct_pack(s := length(regexp_extract(t, '(?is)^(.*?)\bshall\b', 1)), n := 5)) END
WHEN regexp_matches(substr(t, 1, prohibits.h.s), '(?i)\bshall\b') THEN struct_pack(c := 0.75::DOUBLE, h := struct_pack(s := length(regexp_extract(t, '(?is)^(.*?)\bshall\b', 1)), n := 5))
WHEN regexp_matches(substr(t, prohibits.h.s + prohibits.h.n + 1), '(?i)\bshall\b') THEN struct_pack(c := 0.75::DOUBLE, h := struct_pack(s := prohibits.h.s + prohibits.h.n + length(regexp_extract(substr(t, prohibits.h.s + prohibits.h.n + 1), '(?is)^(.*?)\bshall\b', 1)), n := 5)) END AS obliges"""
    named = [*by_concept, ("obliges", "duty")]
    rows = " UNION ALL ".join(f"SELECT doc_id, t, '{relation}' AS relation, '{concept}' AS concept, {relation} AS x FROM g" for relation, concept in named)
    return rf"""WITH d AS (SELECT doc_id, {RULED} AS t FROM documents), f AS (SELECT doc_id, t, {firsts} FROM d), g AS (SELECT *, {duty} FROM f)
SELECT doc_id, relation, concept, x.c AS confidence, trim(regexp_replace(substr(t, greatest(x.h.s - 60, 0) + 1, x.h.s + x.h.n + 80 - greatest(x.h.s - 60, 0)), '\s+', ' ', 'g')) AS evidence FROM ({rows}) WHERE x IS NOT NULL AND length(trim(t)) >= 40"""


@register("semantic_tags", _tag_sql(), "documents")
def semantic_tags(docs: DataFrame) -> DataFrame:
    tagged = docs.select("doc_id", F.expr(RULED).alias("t")).select("doc_id", F.explode(N.semantic_tags(F.col("t"))).alias("x"))
    return tagged.select("doc_id", "x.*")


CITED = "coalesce(text, '') || ' as section ' || (1 + doc_id % 90) || '(2) says of the goods, and ' || substr(coalesce(text, ''), 1, 60) || ' by Rules ' || (doc_id % 9) || ' of this very time.'"
_EDGES = r"""SELECT doc_id, act, unnest(regexp_extract_all(t, '(?is).{0,10}\b{k}s?\s+\d{1,4}(?:\([0-9a-z]+\))*.{0,10}', 0)) AS evidence, '{k}' AS k FROM d"""


@register("edges_from_text", rf"""WITH d AS (SELECT doc_id, {ACT} AS act, {CITED} AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id AS source, concat_ws('::', act, regexp_extract(evidence, '(?i)\b' || k || 's?\s+(\d{{1,4}}(?:\([0-9a-z]+\))*)', 1)) AS target, 'refs' AS relation, evidence FROM ({_EDGES.replace('{k}', 'section')} UNION ALL {_EDGES.replace('{k}', 'rule')})""", "documents")
def edges_from_text(docs: DataFrame) -> DataFrame:
    return E.text_edges(docs.select("doc_id", "lang", F.expr(CITED).alias("t")), "doc_id", "t", F.expr(ACT))


@register("evidence_bundle", """WITH r AS (SELECT l_orderkey AS q, l_suppkey % 3 AS g, l_linenumber AS i, l_extendedprice AS s, l_returnflag <> 'N' AS good FROM lineitem),
b AS (SELECT q, g, max(s) AS best, bool_or(good) AS ok FROM r GROUP BY 1, 2), c AS (SELECT q, g AS chosen FROM b WHERE ok QUALIFY row_number() OVER (PARTITION BY q ORDER BY best DESC, g) = 1),
k AS (SELECT r.*, best, chosen FROM r JOIN b USING (q, g) LEFT JOIN c USING (q)),
o AS (SELECT *, row_number() OVER (PARTITION BY q, g ORDER BY s DESC, i) AS n FROM k WHERE g IS DISTINCT FROM chosen)
SELECT q AS l_orderkey, g AS shop, i AS l_linenumber, 'primary' AS part, row_number() OVER (PARTITION BY q ORDER BY s DESC, i)::INTEGER AS rank FROM k WHERE g = chosen AND good QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, i) <= 5
UNION ALL SELECT q, g, i, 'related', row_number() OVER (PARTITION BY q ORDER BY best DESC, g, n)::INTEGER FROM o WHERE n <= 2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY best DESC, g, n) <= 5""", "lineitem")
def evidence_bundle(lineitem: DataFrame) -> DataFrame:
    return E.bundle(lineitem.withColumn("shop", F.col("l_suppkey") % 3), "l_orderkey", "shop", "l_linenumber", "l_extendedprice", F.col("l_returnflag") != "N")


@register("task_coverage", f"""WITH t AS (SELECT conv_id % 10 AS plan, conv_id AS task, {_tokens('text')} AS x FROM conversations WHERE turn = 0),
h AS (SELECT plan, task, bool_or(len(x) > 0 AND coalesce(len(list_filter(x, lambda n: contains(lower(c.text), n))) >= 0.3 * len(x), false)) AS hit FROM t LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn > 0) c ON c.conv_id = task GROUP BY 1, 2)
SELECT plan, count(*) AS tasks, count(*) FILTER (hit) AS covered, round(count(*) FILTER (hit) / count(*), 4) AS coverage FROM h GROUP BY 1""", "conversations")
def task_coverage(turns: DataFrame) -> DataFrame:
    """Each first turn is a task, its plan the id's last digit; later turns of the conversation are its chunks."""
    tasks = turns.where("turn = 0").select((F.col("conv_id") % 10).alias("plan"), F.col("conv_id").alias("task"), F.col("text").alias("question"))
    return E.task_coverage(tasks, turns.where("turn > 0").select(F.col("conv_id").alias("task"), "text"), "plan", "task", 0.3)


@register("isolated_provisions", None, "documents")
def isolated_provisions(docs: DataFrame) -> DataFrame:
    """Provisions of three chunks a document: its own text, and stated ones whose first provision ends in the next chunk."""
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("document"), F.coalesce("text", F.lit("")).alias("own"), F.coalesce("source", F.lit("none")).alias("source"))
    parts = [F.col("own"), F.concat(F.lit("1. Short title.— These rules of "), F.col("source"), F.lit(" shall apply as Section 9 says.\n2. Duties.— Every seller must, provided that")), F.lit("nothing forbids it, keep records.\n1999. A year.\n4. Penalty.— Who does not is punishable.")]
    chunks = known.select("document", F.posexplode(F.array(*parts)).alias("chunk_index", "text")).withColumn("chunk_id", F.concat_ws("#", "document", "chunk_index")).withColumn("last_section", F.lit(20))
    found = P.isolated(chunks)
    return found.select("document", "number", "start", "end", F.array_join("chunk_ids", ",").alias("chunk_ids"), "modality", "is_proviso", "confidence", F.md5("text").alias("text_md5"))


# Wording of prohibitions, penalties, offences, powers, permissions, duties, procedures, definitions, exemptions and declarations.
EDGE_RULES = [
    H.TagRule("PROHIBITS", "Prohibition", 0.9, r"(?i)\bshall\s+not\b", "shall"), H.TagRule("PROHIBITS", "Prohibition", 0.85, r"(?i)\bno\s+person\s+shall\b", "person"), H.TagRule("PROHIBITS", "Prohibition", 0.85, r"(?i)\bprohibited\b", "prohibited"),
    H.TagRule("PROHIBITS", "Prohibition", 0.8, r"(?i)\bit\s+shall\s+be\s+unlawful\b", "unlawful"), H.TagRule("PROHIBITS", "Prohibition", 0.8, r"(?i)\bmust\s+not\b", "must"), H.TagRule("PROHIBITS", "Prohibition", 0.72, r"(?i)\bprohibition\s+(?:against|of|on)\b", "prohibition"),
    H.TagRule("PRESCRIBES_PENALTY", "Penalty", 0.95, r"(?i)(?:punishable|punished)\s*with\s*(?:imprisonment|fine|both)", "punish"), H.TagRule("PRESCRIBES_PENALTY", "Penalty", 0.9, r"(?i)imprisonment\s*(?:for|of|which\s*may\s*extend)", "imprisonment"),
    H.TagRule("PRESCRIBES_PENALTY", "Penalty", 0.85, r"(?i)fine\s*(?:which\s*may\s*extend|not\s*exceeding)", "fine"), H.TagRule("PRESCRIBES_PENALTY", "Penalty", 0.85, r"(?i)penalty\s*(?:of|for)", "penalty"),
    H.TagRule("PRESCRIBES_PENALTY", "Penalty", 0.72, r"(?i)\b(?:rupees|Rs\.?|/-)(?![A-Za-z])", None, None, r"(?i)\b(?:fees?|charges?\s+(?:for|payable|levied|collected)|tax(?:es)?|rent(?:al)?|refund(?:able)?|remuneration|honorarium|non-refundable|compounding)\b"),
    H.TagRule("CREATES_OFFENCE", "Offence", 0.9, r"(?i)shall\s*be\s*guilty\s*of\s*an\s*offence", "guilty"), H.TagRule("CREATES_OFFENCE", "Offence", 0.85, r"(?i)\bcommits?\s+an\s+offence\b", "offence"), H.TagRule("CREATES_OFFENCE", "Offence", 0.7, r"(?i)\boffence\b", "offence"),
    H.TagRule("GRANTS_POWER_TO", "Power", 0.8, r"(?i)\bpower\s+to\b", "power"), H.TagRule("GRANTS_POWER_TO", "Power", 0.8, r"(?i)\bempowered\b", "empowered"), H.TagRule("GRANTS_POWER_TO", "Power", 0.8, r"(?i)\bauthori[sz]ed\s+to\b", "authori"),
    H.TagRule("GRANTS_PERMISSION", "Permission", 0.8, r"(?i)\bmay\s+be\s+(?:granted|permitted|allowed)\b", "may"), H.TagRule("GRANTS_PERMISSION", "Permission", 0.7, r"(?i)\blicen[cs]e\b", "licen"),
    H.TagRule("IMPOSES_DUTY", "Obligation", 0.7, r"(?i)\bshall\b", "shall", "PROHIBITS"), H.TagRule("IMPOSES_DUTY", "Obligation", 0.8, r"(?i)\bduty\s+to\b", "duty"), H.TagRule("IMPOSES_DUTY", "Duty", 0.8, r"(?i)\bit\s+shall\s+be\s+the\s+duty\b", "duty"),
    H.TagRule("PRESCRIBES", "Procedure", 0.8, r"(?i)\bin\s+the\s+prescribed\s+manner\b", "prescribed"), H.TagRule("PRESCRIBES", "Procedure", 0.75, r"(?i)\bprocedure\b", "procedure"),
    H.TagRule("DEFINES", "Definition", 0.85, r"(?i)\bis\s+said\s+to\s+be\b", "said"), H.TagRule("DEFINES", "Definition", 0.85, r"(?i)\bmeans\b(?!\s+to\s+mean)", "means"), H.TagRule("DEFINES", "Definition", 0.8, r"(?i)\b(?:refers\s+to|includes)\b"),
    H.TagRule("EXEMPTS", "Exemption", 0.85, r"(?i)\bshall\s+not\s+apply\b", "apply"), H.TagRule("EXEMPTS", "Exemption", 0.8, r"(?i)\bshall\s+be\s+exempt\b", "exempt"), H.TagRule("EXEMPTS", "Exemption", 0.7, r"(?i)\bnotwithstanding\b", "notwithstanding"),
    H.TagRule("DECLARES", "DeclarativeRule", 0.8, r"(?i)\b(?:shall|is|are)\s+(?:be\s+)?deemed\s+(?:to\s+be|an?|that)\b", "deemed"), H.TagRule("DECLARES", "DeclarativeRule", 0.8, r"(?i)\bshall\s+be\s+(?:construed|interpreted)\b", "shall"),
]
_LAWS = "coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' No person shall sell it; it shall be kept clean.' WHEN 1 THEN ' Whoever does is punishable with fine of Rs. 500.' WHEN 2 THEN ' A processing fee of Rs. 1,000 is due.' WHEN 3 THEN ' Milk means the secretion, and the officer has power to inspect.' WHEN 4 THEN ' This shall not apply, notwithstanding the rest.' ELSE '' END"


@register("semantic_edges", None, "documents")
def semantic_edges(docs: DataFrame) -> DataFrame:
    """Edges by a table of thirty rules, with stated provisions behind each text."""
    return H.semantic_edges(docs.select("doc_id", F.expr(_LAWS).alias("text")), "doc_id", "text", EDGE_RULES).withColumn("evidence", F.md5("evidence"))
