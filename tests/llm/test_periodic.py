"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import pytest

from lexmill.llm import periodic
from tests.llm.test_operators import ODD, documents, prose

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def slow_runs(w, least, length):
    found = []
    for q in range(1, len(w) // least + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(length, least * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w, 4, 6)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("least, length", [(4, 6), (2, 2), (3, 5)])
def test_runs_equal_brute_force(least, length):
    rng = random.Random(least)
    for _ in range(600):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(50))]
        if rng.random() < 0.6:
            w = w[: rng.randrange(20)] + [rng.randrange(6) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 8) + w[:10]
        want = slow_runs(w, least, length)
        assert periodic.runs(w, least, length) == want
        words = [b"w%d" % x for x in w]
        for pieces in periodic.possible_pieces([b" ".join(words), b"x y z", b" ".join(words)], least, length)[::2]:
            assert periodic.text_runs(words, pieces, least, length) == want


def test_long_periods_and_long_texts():
    assert periodic.runs([0] * 100_000) == [(0, 100_000, 1)]
    assert periodic.runs(list(range(20_000)) * 5 + [-1]) == [(0, 100_000, 20_000)]


def test_table_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(120), rng.choice([2, 3, 50])) for _ in range(150)]
    texts += ["a b " * 30 + "c " * 12 + "a b " * 5, "x\x85y z " * 8, "one two three four five six", "a " * 6, "a " * 5, "a b\x1cc " * 9]
    ids = [None if i == 3 else 7 if i in (8, 9) else i * 13 - 60 for i in range(len(texts + ODD))]
    rows = periodic.run_table(documents(spark, texts + ODD, ids)).select(COLUMNS).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted((slow_row(i, t) for i, t in zip(ids, texts + ODD, strict=True)), key=key)


def test_operator_keeps_texts_and_runs(spark):
    row = periodic.find_runs(documents(spark, ["go on and " * 5 + "stop"])).first()
    assert (row.collapsed, row.n_words) == ("go on and stop", 16)
    assert [tuple(r) for r in row.runs] == [(0, 15, 3)]
    assert periodic.find_runs(documents(spark, [])).collect() == []
