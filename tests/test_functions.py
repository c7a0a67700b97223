"""Values worked out by hand."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import dates as D
from lexmill.functions import extract as X
from lexmill.functions import identity
from lexmill.functions import lexical as L
from lexmill.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.collapse_white, "  a\t\n b\xa0c ", "a b c"),
        (T.collapse_spaces, "a  b \n c", "a b \n c"),
        (T.limit_newlines, "a\n\n\n\nb", "a\n\nb"),
        (T.join_hyphens, "agree-\n  ment", "agreement"),
        (T.straight_quotes, "“a” ‘b’", "\"a\" 'b'"),
        (T.plain_bullets, "• a … ·", "* a ... -"),
        (T.strip_line_ends, "a  \nb\t", "a\nb"),
        (T.drop_page_numbers, "a\nPage 3\n- 4 -\nb", "a\nb"),
        (T.drop_watermarks, "a\nConfidential\nb", "a\nb"),
        (T.drop_repeated_lines, "a\na\nb\na", "a\nb\na"),
        (T.drop_running_titles, "FOOD ACT\nx\nFOOD ACT\ny\nONCE ONLY", "x\ny\nONCE ONLY"),
        (T.drop_blank_lines, "a\n \nb", "a\nb"),
        (T.act_form, "The Food Safety Act, 2006", "food safety act 2006"),
        (T.section_form, " 31(2)", "31"),
        (T.escape_formula, "=1+1", "'=1+1"),
        (T.html_to_text, "<p>a &amp; b</p><script>x</script><p>c</p>", "a & b\nc"),
        (T.collapse_white, None, None),
    ],
)
def test_text(spark, function, text, want):
    assert one(spark, function(F.col("t")), t=text) == want


def test_nfkc(spark):
    assert one(spark, T.nfkc("t"), t="ﬁ①") == "fi1"


@pytest.mark.parametrize(("a", "b", "want"), [("31", "31", "exact"), ("31", "31(2)", "parent"), ("31(2)(a)", "31(2)", "child"), ("31(2)", "31(3)", "sibling"), ("31(2)", "32(5)(a)", "adjacent"), ("31(2)(a)", "31(3)", "same_family"), ("31", "40", "none"), ("x", "31", "none")])
def test_relations(spark, a, b, want):
    assert one(spark, X.chain_relation(X.section_chain(F.col("a")), X.section_chain(F.col("b"))), a=a, b=b) == want


def test_references(spark):
    found = one(spark, X.references_in(F.col("t"), "MEDIUM"), t="see section 3(1) and Schedule II, subject to rule 4")
    assert [(r.kind, r.raw, r.start) for r in found] == [("section", "section 3(1)", 4), ("schedule", "Schedule II", 21), ("rule", "rule 4", 45)]


@pytest.mark.parametrize(("text", "want"), [("2024-05-06", "2024-05-06"), ("6/5/2024", None), ("06/05/2024", "2024-05-06"), ("6 May 2024", "2024-05-06"), ("soon", None), (None, None)])
def test_dates(spark, text, want):
    got = one(spark, D.parse_date(F.col("t")), t=text)
    assert (got and str(got)) == want


@pytest.mark.parametrize(("n", "want"), [(0, ""), (7, "Seven"), (42, "Forty Two"), (100, "One Hundred"), (1_25_000, "One Lakh Twenty Five Thousand"), (3_00_00_001, "Three Crore One")])
def test_number_words(n, want):
    assert D.number_words(n) == want


def test_similarities():
    assert L.ratio_of("", "") == 100.0
    assert L.ratio_of("abc", "") == 0.0
    assert L.ratio_of("abcd", "abxd") == pytest.approx(75.0)
    assert L.best_window("bcd", "abcde") == (100.0, 1, 4)
    assert L.token_set_ratio_of("food act", "act food 2006") == 100.0
    assert L.token_set_ratio_of("", "a") == 0.0
    assert L.marked("a food act", L.match_spans("food", "a food act")) == "a <mark>food</mark> act"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    assert L.lcs_length(a, b) == slow_lcs(a, b)
    assert L.ratio_of(a, b) == pytest.approx(L.ratio_of(b, a))


CITING = "The Food Safety and Standards Act, of the Act, (2020 SC 12/34) and (hc 5/2019), Section 3(1), clause (b), 01/02/2020 - 03/04/2021, 5 May 2019; A 1234/2021, constitution of India"


def test_citations_by_class(spark):
    found = [(c.kind, c.normalized) for c in one(spark, X.citations_by_class(F.col("t")), t=CITING)]
    assert found == [("supreme_court", "2020 SC 12/34"), ("high_court", "hc 5/2019"), ("section", "Section 3(1)"), ("section", "clause (b)"), ("date_reference", "01/02/2020 - 03/04/2021"), ("date_reference", "5 May 2019"), ("registry", "A 1234/2021")]
    assert one(spark, X.citations_by_class(F.col("t")), t=None) is None
    assert one(spark, X.citations_by_class(F.col("t")), t="") == []


@pytest.mark.parametrize(("text", "want"), [
    (CITING, [("statutory", "The Food Safety and Standards Act"), ("constitution", "constitution of India")]),
    ("of the Act and the Penal Code Act", []),
    ("Prevention of Food Adulteration Act, then Prevention of Food Adulteration Act", [("statutory", "Prevention of Food Adulteration Act")]),
    ("The Constitution of India. Prevention of Food Adulteration Act", [("constitution", "The Constitution of India"), ("statutory", "Prevention of Food Adulteration Act")]),
    ("The Constitution of India and Prevention of Food Adulteration Act", [("constitution", "The Constitution of India and Prevention of Food Adulteration Act")]),
    ("", []),
    (None, None),
])
def test_statutes_cited(spark, text, want):
    got = one(spark, X.statutes_cited(F.col("t")), t=text)
    assert (got and [(c.kind, c.source) for c in got]) == want


@pytest.mark.parametrize(("text", "want"), [("shall be substituted", True), ("In The Marginal Heading", True), ("shall stand", False), ("", False), (None, False)])
def test_amendment_prose(spark, text, want):
    assert one(spark, X.is_amendment_prose(F.col("t")), t=text) is want


J = '<ol class="justify"'


@pytest.mark.parametrize(("html", "want"), [
    (f'a{J}><li>x<li>y</ol>b{J} start="9"><li>z</ol>c', f'a{J}><li>x<li>y</ol>b{J} start="3"><li>z</ol>c'),
    (f'{J} start="1"><li>x</ol>{J} start="12"><li>y</ol>{J} start="1"><li>z</ol>', f'{J} start="1"><li>x</ol>{J} start="2"><li>y</ol>{J} start="3"><li>z</ol>'),
    (f'{J} start="4"><li>x</ol>{J} start="9"><li>y</ol>', f'{J} start="4"><li>x</ol>{J} start="9"><li>y</ol>'),
    ('<ol start="1"><li>x</ol>', '<ol start="1"><li>x</ol>'),
    ("none", "none"),
    (None, None),
])
def test_renumbered_lists(spark, html, want):
    assert one(spark, X.renumbered_lists(F.col("t")), t=html) == want


def test_tagged_json(spark):
    at = F.expr("timestamp '2024-05-06 07:08:09.5'")
    assert one(spark, T.tagged_json(at, "timestamp"), t="") == '{"__type__":"datetime","value":"2024-05-06T07:08:09.500000"}'
    assert one(spark, T.tagged_json(F.col("t")), t='a"b\nc') == '"a\\"b\\nc"'
    assert one(spark, T.tagged_json(F.lit(7)), t="") == "7"
    assert one(spark, T.tagged_json(F.col("t"), "date"), t=None) is None


def test_token_coverage(spark):
    assert one(spark, L.token_coverage(F.array(F.lit("food"), F.lit("act")), F.col("t")), t="Foods only") == 0.5
    assert one(spark, L.token_coverage(F.array().cast("array<string>"), F.col("t")), t="x") == 0.0
    assert one(spark, L.token_coverage(F.array(F.lit("a")), F.col("t")), t=None) == 0.0


def test_each_pattern_of_references_is_searched_once_a_text(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = df.select(X.references_in(F.col("t")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == plan.count("split(") == len(X.REFERENCES)
    t = "Rule 4 of section 3(1), sections 12 and rules 7(a)"
    assert [(r["start"], r["end"], r["raw"]) for r in one(spark, X.references_in(F.col("t")), t=t)] == [(0, 6, "Rule 4"), (10, 22, "section 3(1)"), (24, 35, "sections 12"), (40, 50, "rules 7(a)")]
    assert one(spark, X.references_in(F.col("t")), t=None) is None and one(spark, X.references_in(F.col("t")), t="none") == []


def test_identity_names_the_narrowest_unit_and_makes_nothing_up(spark):
    rows = [(1, "Act A", "Section 31(2)(a)", "it means x under rule 4.1"), (2, None, None, "Schedule IV, chapter II"), (3, "Act A", "Annex", None), (4, None, None, "")]
    df = spark.createDataFrame(rows, "id int, act string, section string, text string")
    got = {r["id"]: r["i"] for r in df.select("id", identity.identity(F.col("act"), F.col("section"), F.col("text")).alias("i")).collect()}
    assert (got[1]["canonical_id"], got[1]["parent_unit"], got[1]["clause"]) == ("Act A::31(2)(a)", "Act A::31(2)", ["a"])
    assert got[1]["cross_references"] == ["Rule 4.1"] and got[1]["has_definition"] and not got[1]["has_exception"]
    assert got[2]["canonical_id"] == "Schedule IV" and got[2]["parent_unit"] is None
    assert (got[3]["canonical_id"], got[3]["cross_references"], got[3]["has_definition"]) == ("Act A", [], False)
    assert got[4]["canonical_id"] == "UNKNOWN"


def test_a_duty_is_no_part_of_a_prohibition(spark):
    texts = ["x" * 40 + " the seller shall not sell", "x" * 40 + " he shall  not sell but shall tell", "he shall tell", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: [(t["relation"], t["evidence"]) for t in r["t"]] for r in df.select("id", identity.semantic_tags(F.col("text")).alias("t")).collect()}
    assert [r for r, _ in got[0]] == ["prohibits"]
    assert [r for r, _ in got[1]] == ["prohibits", "obliges"] and got[1][1][1].endswith("but shall tell")
    assert got[2] == got[3] == got[4] == []


def test_collapsing_leaves_single_spaces_alone(spark):
    import re

    for t in (" ", "", "a b", " a  b\n", "\n a\t\tb \n c", "a\u3000b \xa0 c", "\xa0", "a\u2003 b", "a \u2028b c d  "):
        assert one(spark, T.collapse_white(F.col("t")), t=t) == re.sub(f"{T.WHITE}+", " ", t).strip(" ")
    assert re.findall(T.UNEVEN_WHITE, "a b  c\nd e") == ["  ", "\n"]


def test_each_pattern_of_tags_is_looked_for_once_a_text(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = df.select(identity.semantic_tags(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_instr(") == len(identity.TAGS) - 1 and plan.count("regexp_extract_all(") == plan.count("split(") == 1


def test_a_question_is_parsed_once(spark):
    df = spark.createDataFrame([(1, "What is the penalty in section 5(2) of the Food Act?"), (2, None)], "id int, text string")
    got = {r["id"]: r["u"] for r in df.select("id", identity.understood(F.col("text"), {"Food Act": []}).alias("u")).collect()}
    assert got[1]["kind"] == "definition" and (got[1]["act"], got[1]["section"], got[1]["subsection"]) == ("Food Act", "5", "2")
    assert got[2]["kind"] == "general" and got[2]["act"] is None and got[2]["subqueries"] == [""]


def test_a_word_said_over_and_over_is_no_statute(spark):
    got = one(spark, X.statutes_cited(F.col("t")), t="The The The The The The; Food Food Food Act under Food Safety and En Act")
    assert [c.source for c in got] == ["Food Safety and En Act"]


def test_long_texts_are_cleaned_in_linear_time(spark):
    """A list that a lambda takes from outside is made once a text, not once a line."""
    body = [f"line {i} of the text" for i in range(4000)]
    text = "\n".join(x for i, line in enumerate(body) for x in (*["FOOD AUTHORITY"] * (i % 1000 == 0), line, line))
    start = time.monotonic()
    got = one(spark, T.drop_repeated_lines(T.drop_running_titles(F.col("t"))), t=text)
    assert got == "\n".join(body)
    assert time.monotonic() - start < 30
