"""Tokens, set similarities, fuzzy string similarity and highlighting."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from lexmill.functions.windows import best_scores, best_window, best_windows

# Words that carry no content.
STOPWORDS = ("the", "and", "for", "are", "was", "with", "that", "this", "from", "what", "which", "under", "any", "shall", "may", "not", "has", "have", "its", "who")


def words(c: Column) -> Column:
    """Lower-case word tokens of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), F.lit(0))


def content_tokens(c: Column, least: int = 3) -> Column:
    """Word tokens that are no stop words, of three characters or with a digit."""
    return F.filter(words(c), lambda t: ~t.isin(*STOPWORDS) & ((F.length(t) >= least) | t.rlike("[0-9]")))


def search_terms(c: Column, most: int = 12) -> Column:
    """The first distinct content tokens of three characters at least."""
    return F.slice(F.array_distinct(F.filter(words(c), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty ones are 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_share(a: Column, b: Column) -> Column:
    """Share of b's distinct members that a holds; 0 for an empty b."""
    n = F.size(F.array_distinct(b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def token_coverage(needles: Column, text: Column) -> Column:
    """Share of the needles, repeats included, that the lower-case text holds anywhere; 0 without needles or text."""
    low = F.coalesce(F.lower(text), F.lit(""))
    return F.when(F.size(needles) > 0, F.size(F.filter(needles, lambda t: low.contains(t))) / F.size(needles)).otherwise(0.0)


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether the words of the phrase occur in a row in the words of the text."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    return (F.size(words(phrase)) > 0) & padded(text).contains(padded(phrase))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean norm, 1 for the zero vector, so that its cosine is 0."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hash_vector(c: Column) -> Column:
    """A deterministic stand-in for an embedding: the 32 bytes of SHA-256 scaled to -1 to 1."""
    hexes = F.sha2(c, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)


def token_estimate(c: Column, per_word: float = 1.3) -> Column:
    return F.floor(F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")) * per_word).cast("int")


# Similarities that need a longest common subsequence have no built-in: they run in Arrow batches.


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel: one big-integer step for each character of b."""
    if not a or not b:
        return 0
    spots: dict[str, int] = {}
    for i, ch in enumerate(a):
        spots[ch] = spots.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & spots.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_set_ratio_of(a: str, b: str) -> float:
    """Best of the sorted common tokens against each side's; a subset scores 100, no tokens 0."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base = " ".join(both)
    one, two = " ".join([*both, *left]), " ".join([*both, *right])
    return max([ratio_of(one, two), *(ratio_of(base, s) for s in (one, two) if base)])


def _pairwise(score):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else round(score(x, y), 6) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def field_scores(query: str, texts: list[str]) -> np.ndarray:
    """The better of token-set ratio and most similar window, in lower case, for many texts at once."""
    low = query.lower()
    texts = [t.lower() for t in texts]
    return np.round(np.maximum(best_scores(low, texts), [token_set_ratio_of(low, t) for t in texts]), 6) if texts else np.zeros(0)


def _by_query(scores):
    """A function of a query and many texts, over columns: rows of equal queries are scored together."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        places: dict[str, list[int]] = {}
        for i in known.tolist():
            places.setdefault(a.iloc[i], []).append(i)
        for query, at in places.items():
            out[at] = np.round(scores(query, [b.iloc[i] for i in at]), 6)
        return pd.Series(out).where(pd.Series(~np.isnan(out)), None).astype("float64")

    return run


ratio = _pairwise(ratio_of)
partial_ratio = _by_query(best_scores)
token_set_ratio = _pairwise(token_set_ratio_of)
field_score = _by_query(field_scores)


#: Least ratio of a token with a text's most similar window for the token to count as present.
PRESENT = 75.0


@F.pandas_udf(DoubleType())
def fuzzy_coverage(needles: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the needles (an array) that the text holds, letter for letter or nearly; 0 without needles, all are missing from a null text."""
    texts = [(t or "").lower() for t in text]
    hits, places = np.zeros(len(texts)), {}
    for i, own in enumerate(needles):
        for needle in own if own is not None else ():
            if needle in texts[i]:
                hits[i] += 1
            else:
                places.setdefault(needle, []).append(i)
    for needle, at in places.items():
        np.add.at(hits, at, best_scores(needle, [texts[i] for i in at]) >= PRESENT)
    return pd.Series([h / len(own) if own is not None and len(own) else 0.0 for h, own in zip(hits.tolist(), needles, strict=True)])


@F.pandas_udf(StructType([StructField("score", DoubleType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
def partial_alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_window(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["score", "start", "end"])


@F.pandas_udf(StructType([*[StructField(n, DoubleType()) for n in ("ratio", "partial", "token_set", "field")], StructField("at", StructType([StructField("score", DoubleType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))]))
def all_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The four similarities and the alignment of each pair; all windows of a pair are compared once, and once more where case matters."""
    both = [(x or "", y or "") for x, y in zip(a, b, strict=True)]
    # Windows with case, then without it.
    low = [(x.lower(), y.lower()) for x, y in both]
    places = best_windows(both + low)
    rows = []
    for i, ((x, y), lower, at) in enumerate(zip(both, low, places, strict=False)):
        if a.iloc[i] is None or b.iloc[i] is None:
            rows.append((None, None, None, None, at))
            continue
        field = max(places[len(both) + i][0], token_set_ratio_of(*lower))
        rows.append((*(round(s, 6) for s in (ratio_of(x, y), at[0], token_set_ratio_of(x, y), field)), at))
    names = ["ratio", "partial", "token_set", "field"]
    out = pd.DataFrame([r[:4] for r in rows], columns=names, dtype="float64")
    return out.assign(at=pd.Series([dict(zip(("score", "start", "end"), r[4], strict=True)) for r in rows], dtype=object))


def match_spans(query: str, text: str, least: float = 60.0) -> list[tuple[int, int]]:
    """Where the query's terms stand, else each term's most similar word; grown to whole words and merged."""
    found, lower = [], text.lower()
    spots = [m.span() for m in re.finditer(r"\w+", text)]
    for term in re.findall(r"\w+", query.lower()):
        exact = [m.span() for m in re.finditer(re.escape(term), lower)]
        if not exact and spots:
            score, span = max((ratio_of(term, lower[s:e]), (s, e)) for s, e in spots)
            exact = [span] if score >= least else []
        found += exact
    merged: list[list[int]] = []
    for s, e in sorted(found):
        while s > 0 and text[s - 1].isalnum():
            s -= 1
        while e < len(text) and text[e].isalnum():
            e += 1
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [(s, e) for s, e in merged]


def marked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], "<mark>", text[s:e], "</mark>"]
        at = e
    return "".join([*out, text[at:]])


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def spans(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([[{"start": s, "end": e} for s, e in match_spans(q or "", t or "")] for q, t in zip(query, text, strict=True)])


@F.pandas_udf(StringType())
def highlighted(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else marked(t, match_spans(q or "", t)) for q, t in zip(query, text, strict=True)])


@F.pandas_udf(StringType())
def snippet(query: pd.Series, text: pd.Series) -> pd.Series:
    """Marked text from 80 characters before the first match to 80 after the last, cut at words."""

    def cut(q: str, t: str) -> str:
        found = match_spans(q, t)
        if not found:
            return t[:160]
        lo, hi = max(0, found[0][0] - 80), min(len(t), found[0][1] + 80)
        while lo > 0 and not t[lo - 1].isspace():
            lo -= 1
        while hi < len(t) and not t[hi].isspace():
            hi += 1
        inside = [(s - lo, e - lo) for s, e in found if lo <= s and e <= hi]
        return ("…" if lo else "") + marked(t[lo:hi], inside) + ("…" if hi < len(t) else "")

    return pd.Series([None if t is None else cut(q or "", t) for q, t in zip(query, text, strict=True)])


def highlight_exact(text: Column, term: str) -> Column:
    """Marks a literal term without leaving the JVM."""
    return F.regexp_replace(text, f"(?i){re.escape(term)}", "<mark>$0</mark>")
