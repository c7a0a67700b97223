"""Isolation of provisions: boundaries in a document's chunks, the numbering that fits best, and the spans that it cuts.

Chunks keep their ids and are never joined into one text: a running sum of lengths gives each its place in the document, where one line
break lies between two chunks. Candidates are found chunk by chunk. Each has a weight, positive if it looks like a heading and negative if it looks
like a mention, a year or a page number. Of all candidates of a document those are taken that ascend in number and weigh most together: a weighted
increasing chain, found in n log n steps over the candidates alone. A span reaches from one boundary to the next; what stands before the
first belongs to none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The heading patterns, in order of preference where two begin at one place.
PATTERNS = (
    ("engine_main", re.compile(r"(?m)^[ \t]*(\d{1,4})[ \t]*\.[ \t]*(?:\([ \t]*)?(?=[A-Z])")),
    ("engine_word", re.compile(r"\b(?:Section|Sec\.|§)[ \t]*(\d{1,4})", re.IGNORECASE)),
    ("dotted_clause", re.compile(r"(?m)^\s*(\d{1,3}(?:\.\d{1,2}){1,3})(?=(?:\s*:\s*|\s*)[A-Z])")),
    ("l4_header", re.compile(r"(?<![A-Za-z0-9])(\d{1,4})\s*\.\s*(?:\(\s*)?[A-Z]")),
)
# Weights of the features, and the probability from which a boundary counts.
WEIGHTS = {
    "is_line_start": 0.30, "in_act_range": 0.50, "engine_main": 1.00, "engine_word": 0.60, "dotted_clause": 0.60, "l4_header": 0.10,
    "title_score": 0.50, "has_emdash_title": 0.40, "page_number_only": -2.00, "is_year_like": -3.00, "crossref_density": -0.40,
    "out_of_range": -2.50, "word_midline": -0.50, "l4_midline": -0.20,
}
LEAST_PROBABILITY = 0.70
# Other numbered parts that a text around a mention names.
MENTION = re.compile(r"\b(?:section|sec\.|rule|regulation|schedule|chapter)\s+\d", re.IGNORECASE)
# Classes of a provision, the first that fits counts.
MODALITIES = (
    ("penalty", r"\b(?:liable to (?:a )?penalty|punishable|shall be punish|imprison|fine)\b"),
    ("prohibition", r"\b(?:no person shall|shall not|prohibit\w*)\b"),
    ("exemption", r"\b(?:provided that|exempt\w*|nothing .{0,40}shall apply)\b"),
    ("definition", r"\b(?:means and includes|means|definition)\b"),
    ("power", r"\bmay\b.{0,60}\b(?:seize|grant|issue|order|suspend|inspect)\b"),
    ("procedure", r"\b(?:procedure|shall be sent|application shall)\b"),
    ("obligation", r"\b(?:shall|must|required to)\b"),
)
YEARS = range(1800, 2101)


def boundaries(text: str, last: int | None) -> list[tuple[int, str, str, float]]:
    """(start, number, source, weight) of the candidates of a chunk; last is the highest section of the act, None if it is not known."""
    found: dict[int, tuple[str, str, float]] = {}
    for source, pattern in PATTERNS:
        for m in pattern.finditer(text):
            if m.start() not in found:
                found[m.start()] = (m.group(1), source, _weight(text, m, source, last))
    return [(start, *found[start]) for start in sorted(found)]


def _weight(text: str, m: re.Match, source: str, last: int | None) -> float:
    w, number = WEIGHTS, int(m.group(1).split(".")[0])
    line = text.rfind("\n", 0, m.start(1)) + 1
    end = text.find("\n", m.end(1))
    rest = text[m.end() : end if end >= 0 else len(text)][:200]
    begins = not text[line : m.start(1)].strip() or not text[line : m.start()].strip()
    words = rest.split("—", 1)[0].split()
    dash = 0 <= rest.find("—") < 120
    total = w[source]
    if source == "engine_word" and not begins:
        total = w["word_midline"]
    if source == "l4_header" and not begins and not dash:
        total += w["l4_midline"]
    total += w["is_line_start"] * begins + w["has_emdash_title"] * dash
    total += w["title_score"] * (sum(x[:1].isupper() for x in words) / len(words) if words else 0)
    # Without a known act the range says nothing.
    total += 0 if last is None else w["in_act_range"] if 1 <= number <= last else w["out_of_range"]
    total += w["is_year_like"] * (number in YEARS and "." not in m.group(1))
    total += w["page_number_only"] * (begins and not rest.strip(" .")) + w["crossref_density"] * min(len(MENTION.findall(rest)), 3)
    return round(total - math.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY)), 6)


def _numbers(raw: str) -> tuple[int, ...]:
    return tuple(map(int, raw.split(".")))


def heaviest_chain(candidates: list[tuple[str, float]]) -> list[int]:
    """Places of the candidates (number, weight), in order, whose numbers ascend and whose weights sum to most; of equal sums the one that
    was complete first. Candidates that weigh nothing or less are never taken, since a chain is better without them."""
    rank = {n: i for i, n in enumerate(sorted({_numbers(c[0]) for c in candidates}), 1)}
    # A prefix maximum over numbers: the best chain that ends in a lower number.
    best: list[tuple[float, int]] = [(0.0, -1)] * (len(rank) + 1)
    back, top = [-1] * len(candidates), (0.0, -1)
    for k, (number, weight) in enumerate(candidates):
        if weight <= 0:
            continue
        at = rank[_numbers(number)]
        found, i = (0.0, -1), at - 1
        while i > 0:
            if best[i][0] > found[0]:
                found = best[i]
            i -= i & -i
        total = (round(found[0] + weight, 6), k)
        back[k] = found[1]
        i = at
        while i < len(best):
            if total[0] > best[i][0]:
                best[i] = total
            i += i & -i
        if total[0] > top[0]:
            top = total
    chain, k = [], top[1]
    while k >= 0:
        chain.append(k)
        k = back[k]
    return chain[::-1]


def placed_chunks(chunks: DataFrame) -> DataFrame:
    """Adds ``begins``, the place of each chunk in its document: chunks in order of chunk_index, then id, a line break between two."""
    before = Window.partitionBy("document").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("begins", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))


def boundary_candidates(placed: DataFrame) -> DataFrame:
    """(document, place, number, source, weight) of rows (document, begins, text, last_section)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(document, begins + start, number, source, weight) for document, begins, text, last in zip(*(c.to_pylist() for c in batch.columns), strict=True) for start, number, source, weight in boundaries(text, last)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["document", "place", "number", "source", "weight"])

    kind = placed.schema["document"].dataType.simpleString()
    return placed.select("document", "begins", "text", "last_section").mapInArrow(find, f"document {kind}, place long, number string, source string, weight double")


def _chosen(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    return rows.iloc[heaviest_chain(list(zip(rows["number"], rows["weight"], strict=True)))]


def isolated(chunks: DataFrame) -> DataFrame:
    """(document, number, start, end, source, confidence, chunk_ids, text, modality, is_proviso) of every provision of rows
    (document, chunk_id, chunk_index, text, last_section). Null texts are empty; documents without a boundary give nothing."""
    placed = placed_chunks(chunks)
    candidates = boundary_candidates(placed).where("weight > 0")
    accepted = candidates.groupBy("document").applyInPandas(_chosen, candidates.schema)
    ends = placed.groupBy("document").agg(F.max(F.col("begins") + F.length("text")).alias("whole"))
    order = Window.partitionBy("document").orderBy("place")
    spans = accepted.join(ends, "document").withColumn("end", F.coalesce(F.lead("place").over(order), F.col("whole"))).select("document", "number", F.col("place").alias("start"), "end", "source", F.round(1 / (1 + F.exp(-F.col("weight") - math.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY)))), 6).alias("confidence"))
    held = placed.select("document", "chunk_id", "chunk_index", "begins", "text")
    over = (F.col("begins") < F.col("end")) & (F.col("begins") + F.length("text") > F.col("start"))
    first = F.greatest(F.col("start") - F.col("begins"), F.lit(0))
    piece = F.substring(F.col("text"), (first + 1).cast("int"), (F.least(F.length("text"), F.col("end") - F.col("begins")) - first).cast("int"))
    met = spans.join(held, "document").where(over).select(*spans.columns, F.struct("chunk_index", "chunk_id", piece.alias("piece")).alias("part"))
    whole = met.groupBy(*spans.columns).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    text = F.trim(F.array_join(F.transform("parts", lambda p: p["piece"]), "\n"))
    found = whole.select(*spans.columns, F.transform("parts", lambda p: p["chunk_id"]).alias("chunk_ids"), text.alias("text"))
    low = F.lower("text")
    modality = F.lit("unknown")
    for name, pattern in reversed(MODALITIES):
        modality = F.when(low.rlike(pattern), name).otherwise(modality)
    return found.withColumn("modality", modality).withColumn("is_proviso", low.contains("provided that"))
