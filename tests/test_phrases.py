"""Occurrences of many phrases against each phrase tried by itself; metadata by rules."""

import random
import re

import pytest

from lexmill.operators import phrases as P
from lexmill.plans.metadata_queries import _FIELDS, FIELD_RULES

DOCS = "key long, body string, id string, phrase string"


def slow(docs, phrases, whole_words, around):
    out = []
    for k, text in docs:
        low = (text or "").lower()
        for i, phrase in phrases:
            p = (phrase or "").lower()
            spots = [m.start() for m in re.finditer(f"(?={re.escape(p)})", low)] if p else []
            if whole_words:
                word = lambda c: c.isalnum() or c == "_"
                spots = [s for s in spots if not (s and word(low[s - 1]) and word(low[s])) and not (s + len(p) < len(low) and word(low[s + len(p)]) and word(low[s + len(p) - 1]))]
            if spots:
                out.append((k, i, spots[0], len(spots), text[max(0, spots[0] - around[0]) : spots[0] + len(p) + around[1]]))
    return sorted(out)


@pytest.mark.parametrize("whole_words", [True, False])
@pytest.mark.parametrize("block", [1 << 20, 5])
def test_occurrences_equal_each_phrase_alone(spark, whole_words, block):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice(["ab", "a", " ", "Ab", "é", "_", "b."]) for _ in range(rng.randrange(30)))) for i in range(80)] + [(200, None), (201, ""), (0, "ab ab")]
    phrases = [(i, p) for i, p in enumerate(["ab", "a", "AB A", "abab", "", None, "ab", "b. a", "é", "zzz"])]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    found = P.occurrences(df, "key", "body", spark.createDataFrame(phrases, "id int, phrase string"), whole_words, block, (2, 3))
    assert sorted(map(tuple, found.collect())) == slow(docs, phrases, whole_words, (2, 3))


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_metadata_of_a_notice(spark, block):
    text = "THE GAZETTE, Extraordinary No. 12/2020\nThe Food Safety and Standards Act, 2006 as amended by the 3rd amendment. Notification No. F-17/2 dated the 5th August, 2020, Government of Kerala. It shall come into force on 2021-01-01."
    rows = {(r.k, r.field): r for r in P.metadata(spark.createDataFrame([(1, text), (2, "  "), (3, None), (None, text), (4, "No fact here. Factory acts.")], "k long, t string"), "k", "t", FIELD_RULES, _FIELDS, block).collect()}
    got = {f: rows[1, f].value for f in _FIELDS}
    assert got == {
        "title": "Food Safety and Standards Act, 2006", "version": "3rd", "date": "5th August, 2020", "authority": "", "gazette_number": "12/2020", "notification_number": "F-17/2", "language": "english",
        "jurisdiction": "Kerala", "state": "Kerala", "country": "India", "document_type": "Act", "amendment_status": "Amended", "effective_date": "2021-01-01",
    }
    assert {k for k, _ in rows} == {1, 2, 3, 4}
    assert rows[2, "title"].score == 0.0 and rows[3, "language"].score == 0.35
    assert rows[4, "document_type"].method == "default"
    # Two of two candidates agree for the amendment, so consensus adds 0.1 and a fitting length 0.05.
    assert rows[1, "amendment_status"].score == 1.0
    assert rows[1, "title"].score == pytest.approx(0.9, abs=1e-4)


def test_patterns_are_tried_only_where_they_can_match(spark, monkeypatch):
    rules = [P.Rule("x", "one", "pattern", r"a(\d)", 0.5, None, "a"), P.Rule("x", "two", "pattern", r"b(\d)", 0.9, None, "never there"), P.Rule("x", "three", "phrase", "C", 0.4)]
    df = spark.createDataFrame([(1, "a1 b2 c"), (2, "b3")], "k long, t string")
    found = {(r.k, r.value) for r in P.candidates(df, "k", "t", rules).collect()}
    assert found == {(1, "1"), (1, "c")}


def test_semantic_edges_follow_the_table(spark):
    """A rule bars with its own match only, so the second "shall" of the last text is free."""
    rules = [
        P.TagRule("prohibits", "prohibition", 0.9, r"(?i)\bshall\s+not\b", "shall"), P.TagRule("prohibits", "prohibition", 0.8, r"(?i)\bprohibited\b", "prohibited"),
        P.TagRule("penalises", "penalty", 0.72, r"(?i)\bRs\.?(?![A-Za-z])", "rs", None, r"(?i)\bfees?\b"), P.TagRule("obliges", "duty", 0.7, r"(?i)\bshall\b", "shall", "prohibits"), P.TagRule("weak", "x", 0.5, "a"),
    ]
    texts = {
        1: "No one shall not sell, though each   of them SHALL keep records of it.", 2: "It is prohibited. They shall pay a fee of Rs. 100 and nothing more here.", 3: "Whoever does that is liable to pay Rs. 500, as is said in the schedule to this.",
        4: "shall not", 5: None, 6: "They shall not, they shall not, and that is all that there is to be said.",
    }
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    got = {}
    for r in P.semantic_edges(df, "k", "t", rules).collect():
        got.setdefault(r.k, {})[r.relation] = (r.place, r.confidence)
        assert r.evidence in " ".join(texts[r.k].split())
    assert got == {1: {"prohibits": (7, 0.9), "obliges": (texts[1].index("SHALL"), 0.7)}, 2: {"prohibits": (6, 0.8), "obliges": (texts[2].index("shall"), 0.7)}, 3: {"penalises": (texts[3].index("Rs"), 0.72)}, 6: {"prohibits": (5, 0.9), "obliges": (texts[6].rindex("shall"), 0.7)}}
