"""Periodic runs of words: maximal stretches that repeat with a smallest period, found by a suffix automaton.

The end positions of the strings of an automaton's state form an ordered set. Sets travel from the longest states up the
suffix links, the smaller ones merged into the largest. Where two positions become neighbours for the first time, the state's
length is their longest common suffix; a distance d of at most that length is a square of period d, and d is the smallest
period, as a smaller one would put another end between the two. The run starts where that suffix starts. It ends at the later of the two
ends unless the words behind both are equal; then it is found again, whole, from its own last word, so such squares are passed over.

A run that repeats ``least`` times and more shows each of its triples of words several times. A text is therefore first cut where no run can
pass: at triples that occur too seldom in it (hashed, so equal ones always count together), again within each piece until
nothing changes. Only pieces that are left get an automaton, over exact word numbers; its memory is linear in the piece, about half a
kilobyte a word.

Null and empty texts have no words: no runs, four nulls, the digests of nothing. Equal rows give equal rows, each by itself. Rows without
an id are taken as they are, without the rewriting that the contract derives from the id. Ties go to the smaller start, then the
smaller period. An empty table gives an empty result. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._shared import U, mix64, rolling, span_hashes, word_spans

Run = tuple[int, int, int]
#: Repetitions and words of the least run.
LEAST, LENGTH = 4, 6
CHUNK_BYTES = 4 << 20
#: Sets of fewer positions are inserted one by one, others are merged by sorting.
FEW = 12
_GRAM = 3


class Automaton:
    """The suffix automaton of a sequence: of each state its length, suffix link and first end, -1 - end for copies."""

    def __init__(self, seq: Sequence[int]):
        self.length, self.link, self.end, last = [0], [-1], [-1], 0
        after: list[dict[int, int]] = [{}]
        length, link, end = self.length, self.link, self.end
        for i, c in enumerate(seq):
            new = len(length)
            length.append(i + 1)
            link.append(0)
            end.append(i)
            after.append({})
            p = last
            while p >= 0 and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p >= 0:
                q = after[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    end.append(-1)
                    after.append(after[q].copy())
                    link[q] = link[new] = copy
                    while p >= 0 and after[p].get(c) == q:
                        after[p][c] = copy
                        p = link[p]
            last = new


def runs(seq: Sequence[int], least: int = 2, length: int = 2) -> list[Run]:
    """(start, length, smallest period) of every run of at least ``least`` (2 or more) periods and ``length`` members, in order of start and period."""
    n = len(seq)
    if n < max(least, length):
        return []
    automaton = Automaton(seq)
    size, link = automaton.length, automaton.link
    waiting: dict[int, list[list[int]]] = {}
    found: set[Run] = set()
    # A seed of period d needs a suffix of (least - 1) d: shorter states, and all that they link to, have none.
    shortest = max(1, least - 1)
    sizes = np.array(size)
    at = np.flatnonzero(sizes >= shortest)
    for v in at[np.argsort(-sizes[at], kind="stable")].tolist():
        kids, own, suffix = waiting.pop(v, []), automaton.end[v], size[v]
        # Ends are kept negated and ascending: a state's own end is its first, so it goes to the back.
        if kids:
            most = max(range(len(kids)), key=lambda k: len(kids[k]))
            ends = kids.pop(most)
            new = {x: number for number, kid in enumerate(kids) for x in kid}
            if len(new) < FEW:
                for x in new:
                    insort(ends, x)
            else:
                ends += new
                ends.sort()
            if own >= 0:
                ends.append(-own)
                new[-own] = -1
            for x, number in new.items():
                i = bisect_left(ends, x)
                for j in (i - 1, i):
                    if 0 <= j and j + 1 < len(ends):
                        late, early = -ends[j], -ends[j + 1]
                        d = late - early
                        # Two ends of one smaller set were neighbours in it.
                        if d * shortest <= suffix and d + suffix >= length and (late + 1 == n or seq[early + 1] != seq[late + 1]) and new.get(ends[j + 1] if ends[j] == x else ends[j]) != number:
                            found.add((early - suffix + 1, suffix + d, d))
        else:
            ends = [-own]
        if size[link[v]] >= shortest:
            waiting.setdefault(link[v], []).append(ends)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _seldom(least: int, length: int) -> int:
    """How often at least every triple of a run occurs: of period 1 in all its places, of a longer period d in (least d - 2) // d."""
    return min(least - 1, max(least, length) - _GRAM + 1)


def _stretches(often: np.ndarray) -> list[tuple[int, int]]:
    """First and past-the-last word of the stretches whose triples are all marked."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], often.astype(np.int8), [0]))))
    return [(a, b + _GRAM - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _settled(grams: np.ndarray, low: int, high: int, times: int, length: int) -> Iterator[tuple[int, int]]:
    """What is left of words low to high once their triples are counted among themselves, again and again."""
    todo = [(low, high)]
    while todo:
        a, b = todo.pop()
        if b - a < length:
            continue
        _, which, counts = np.unique(grams[a : b - _GRAM + 1], return_inverse=True, return_counts=True)
        often = counts[which] >= times
        if often.all():
            yield a, b
        else:
            todo += [(a + x, a + y) for x, y in _stretches(often)]


def possible_pieces(texts: list[bytes], least: int = LEAST, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each text the stretches of words (first, past the last) that no run reaches across."""
    times = _seldom(least, length)
    data, start, end, counts = word_spans(texts)
    if times <= 1 or length < _GRAM:
        return [[(0, n)] if n else [] for n in counts.tolist()]
    words = span_hashes(data, start, end)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(words) < _GRAM:
        return out
    grams = rolling(words, _GRAM, 7)
    text = np.repeat(np.arange(len(texts)), counts)
    first, last = text[: len(grams)], text[_GRAM - 1 :]
    _, which, seen = np.unique(mix64(grams ^ (first.astype(U) * U(0x9E3779B97F4A7C15))), return_inverse=True, return_counts=True)
    begins = np.concatenate(([0], np.cumsum(counts)))
    # A triple that reaches into the next text belongs to none, so no stretch does.
    for a, b in _stretches((seen[which] >= times) & (first == last)):
        owner = int(text[a])
        base = int(begins[owner])
        out[owner] += [(x - base, y - base) for x, y in _settled(grams, a, b, times, length)]
    return out


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of all ids: from a place on the words repeat with a period, both derived from the id."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def text_runs(words: list[bytes], pieces: list[tuple[int, int]], least: int = LEAST, length: int = LENGTH) -> list[Run]:
    """The runs of a text, in order of start and period, from the pieces that can hold any."""
    found = []
    for a, b in pieces:
        number: dict[bytes, int] = {}
        found += [(a + s, n, d) for s, n, d in runs([number.setdefault(w, len(number)) for w in words[a:b]], least, length)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that stay when each run keeps its first period only."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, d in found:
        gone[s + d] += 1
        gone[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def strongest(found: list[Run]) -> Run | None:
    """The run of the greatest length / period, compared exactly; then the smallest start, then period."""
    best = None
    for s, n, d in found:
        if best is None or n * best[2] > best[1] * d:
            best = (s, n, d)
    return best


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Keys and words, a few megabytes at a time."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            keys.append(key)
            texts.append(raw.split())  # at space and bytes 9 to 13
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, length: int = LENGTH, rewrite: bool = False) -> DataFrame:
    """id, runs (start, length, period), n_words and collapsed text of every row. One narrow pass; a row is never split between tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _texts(batches):
            if rewrite:
                texts = [rewritten(w, k) for w, k in zip(texts, keys, strict=True)]
            pieces = possible_pieces([b" ".join(w) for w in texts], least, length)
            every = [text_runs(w, p, least, length) for w, p in zip(texts, pieces, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            found = pa.array([[{"start": s, "length": n, "period": d} for s, n, d in own] for own in every], kind)
            left = [b" ".join(collapsed(w, own)).decode() for w, own in zip(texts, every, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), found, pa.array([len(w) for w in texts], pa.int64()), pa.array(left, pa.string())], [id_column, "runs", "n_words", "collapsed"])

    chosen = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).cast("string").alias("_text"))
    return chosen.mapInArrow(scan, f"`{id_column}` long, runs array<struct<start:long,length:long,period:long>>, n_words long, collapsed string")


def run_table(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``find_runs`` over rewritten documents."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found, left in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                own = [(r["start"], r["length"], r["period"]) for r in found]
                best = strongest(own)
                listed = "".join(f"{s},{n},{d}\n" for s, n, d in own)
                rows.append((len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.as_py().encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return find_runs(docs, rewrite=True).mapInArrow(digest, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
