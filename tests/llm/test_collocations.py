"""Phrase collocations against counts of all phrases."""

import random
import re
from collections import Counter

import pytest

from lexmill.llm import collocations
from tests.llm.test_operators import ODD

DOCS = "doc_id long, text string, lang string, phrase string, n long"


def slow(rows, least, top, covered=100):
    count, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    count[lang, tuple(w[i : i + m])] += 1
    often = {k: n for k, n in count.items() if n >= least}
    out = []
    for (lang, p), a in often.items():
        if len(p) > 1 and not any(100 * f >= covered * a for (g, q), f in often.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            score, k = min((1000 * a * words[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, often[lang, p[:k]], often[lang, p[k:]], words[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen = Counter()
    return [(r[0], seen.update([r[0]]) or seen[r[0]], *r[1:]) for r in out if seen[r[0]] < top]


def found(spark, rows, least, top=2000, covered=100, slots=1 << 16):
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], DOCS)
    trie = collocations.frequent_phrases(docs, least=least, slots=slots)
    got = collocations.collocations(trie, top, covered).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(map(tuple, got), key=lambda r: (r[0], r[1]))


def texts(rng, n):
    words = ["the", "The", "of", "a", "b", "x\x1cy", "é", "中", "go,on", "und", "\x01q"]
    rows = [(" ".join(rng.choice(words[: rng.choice([3, 6, 11])]) + rng.choice(["", "", "", ".", "\n", " \t"]) for _ in range(rng.randrange(40))), rng.choice([None, "en", "und", "de", ""])) for _ in range(n)]
    return rows + [(t, "en") for t in ODD] * 2 + [("new york city hall " * 400, "de")]


@pytest.mark.parametrize("least, top, covered, slots", [(3, 2000, 100, 1 << 16), (5, 10, 60, 1 << 16), (4, 2000, 100, 64)])
def test_collocations_equal_brute_force(spark, least, top, covered, slots):
    rows = texts(random.Random(least), 150)
    assert found(spark, rows, least, top, covered, slots) == slow(rows, least, top, covered)


def test_many_small_shards(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 50)
    rows = texts(random.Random(9), 60)
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], DOCS)
    texts_only = [(r.text or "", r.lang) for r in docs.collect()]
    assert found(spark, texts_only, 3) == slow(rows, 3, 2000)


def test_no_rows(spark):
    assert found(spark, [], 2) == []
    assert found(spark, [(None, "en"), ("", None), ("once only", "en")], 2) == []


def test_products_beyond_64_bits(spark):
    big = 10**15
    trie = spark.createDataFrame([("en", None, 0, big), ("en", "a", 1, 10**12 + 7), ("en", "b", 1, 10**12 + 9), ("en", "a b", 2, 10**12 + 1)], "lang string, phrase string, m int, f long")
    (row,) = collocations.collocations(trie).collect()
    assert row.score == 1000 * (10**12 + 1) * big // ((10**12 + 7) * (10**12 + 9))
