"""Byte-level BPE encoding and decoding.

Two tiers resolve a pre-token. A minimal perfect hash over the vocabulary maps a pre-token that is
itself a token straight to its rank. Every other pre-token is merged from its bytes with a heap of
candidate merges over a linked list. Splitting, hashing and lookup run over packs of texts as numpy
arrays; the decoded bytes of each pack are compared with its input, which proves every lookup.

Null texts encode as the empty text. Repeated rows give repeated results, an empty table gives an
empty result, and only the two named columns are read, so further columns may have any name. A very
long text is cut where white space begins, which no pre-token crosses, and is encoded piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._shared import U, mix64, span_hashes

PACK_CHARS = 400_000
#: Merged pre-tokens that a worker keeps in each of two generations; about 200 bytes each.
MEMO_ENTRIES = 1 << 17
OTHER, LETTER, NUMBER, SPACE = range(4)
#: The code points of the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_BREAK = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n\t\r]")
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        _classes[list(WHITE_SPACE)] = SPACE
    return _classes


class PerfectHash:
    """Minimal perfect hash of n distinct 64-bit keys: a displacement for each bucket of about four keys.

    Large buckets are placed first; a bucket of one key names its slot outright, which fills the table.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        self.order = np.zeros(n, np.int64)  # slot -> index of the key
        home = (keys % U(self.buckets)).astype(np.int64)
        by_home = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[by_home], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        sizes = np.diff(edges)
        for b in np.argsort(-sizes, kind="stable"):
            own = by_home[edges[b] : edges[b + 1]]
            if len(own) < 2:
                break
            at = 1
            while True:
                tries = np.arange(at, at + 128, dtype=np.uint64)
                slots = self._slots(keys[own][None, :], tries[:, None])
                good = free[slots].all(1)
                for t in np.flatnonzero(good):
                    if len(set(slots[t].tolist())) == len(own):
                        break
                else:
                    at += 128
                    continue
                self.shift[b] = at + t
                free[slots[t]] = False
                self.order[slots[t]] = own
                break
        left = iter(np.flatnonzero(free))
        for b in np.flatnonzero(sizes == 1):
            slot = next(left)
            self.shift[b] = -1 - slot
            self.order[slot] = by_home[edges[b]]

    def _slots(self, keys, shift):
        return (mix64(keys + shift * U(0x9E3779B97F4A7C15)) % U(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index that a key has if it is one of the n; for others some index, to be verified."""
        shift = self.shift[(keys % U(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(keys, np.maximum(shift, 0).astype(U)))
        return self.order[slots]


class Vocabulary:
    """Token bytes by rank, with the perfect hash over them."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.hashes = span_hashes(self.data, self.start, self.start + self.length)
        self.find = PerfectHash(self.hashes)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as file:
            ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in file if line.strip())}
        return cls([ranks[i] for i in range(len(ranks))])


class Merger:
    """Merges the bytes of a word: a heap of candidate merges over a doubly linked list of parts."""

    def __init__(self, tokens: list[bytes]):
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.pair = [-1] * 65536
        for t, i in self.ranks.items():
            if len(t) == 2:
                self.pair[t[0] << 8 | t[1]] = i

    def __call__(self, word: bytes) -> list[int]:
        """Ranks of the word after all merges: always the lowest rank first, the leftmost of equals.

        A heap entry is rank * (length + 1) + start of the left part; an entry whose parts have
        meanwhile changed no longer gives its rank and is passed over.
        """
        n, pair, find = len(word), self.pair, self.ranks.get
        unit = n + 1
        after, before, ids = list(range(1, n + 2)), list(range(-1, n)), [self.single[c] for c in word]
        heap = [r * unit + i for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if (r := pair[a << 8 | b]) >= 0]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), unit)
            if ids[i] < 0 or (j := after[i]) >= n or find(word[i : (end := after[j])]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, end
            if end < n:
                before[end] = i
                if (r := find(word[i : after[end]])) is not None:
                    heappush(heap, r * unit + i)
            if i and (r := find(word[before[i] : end])) is not None:
                heappush(heap, r * unit + before[i])
        return [x for x in ids if x >= 0]


def pre_tokens(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens in code points; first marks where a text begins."""
    kind = char_classes()[points]
    cut = first.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    # White space before anything else keeps its last character back; a plain space joins what follows.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
    cut[after - 1] = True
    cut[after[points[after - 1] == 32]] = False
    # An apostrophe that starts a pre-token takes its contraction along.
    quote = np.flatnonzero((points == 39) & cut)
    n = len(points)
    at = lambda k: np.where((quote + k < n) & ~first[np.minimum(quote + k, n - 1)], points[np.minimum(quote + k, n - 1)], 0)
    one, two = at(1), at(2)
    short = np.isin(one, [ord(c) for c in "sdmt"])
    long = ((one == ord("l")) & (two == ord("l"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("r")) & (two == ord("e")))
    cut[quote[short | long] + 1] = False
    rest = np.concatenate((quote[short] + 2, quote[long] + 3))
    cut[rest[rest < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes packs of texts; keeps merged pre-tokens for the packs that follow."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.merge = Merger(vocabulary.tokens)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed as unsigned 32-bit integers.

        When the memo is full it becomes the older generation, whose words move back when they are met
        again, so frequent words stay and memory is bounded.
        """
        memo, older, out = self.memo, self.older, []
        for word in words:
            if (got := memo.get(word)) is None:
                if (got := older.get(word)) is None:
                    got = array("I", self.merge(word)).tobytes()
                if len(word) <= 64:
                    if len(memo) >= MEMO_ENTRIES:
                        memo, older = {}, memo
                    memo[word] = got
            out.append(got)
        self.memo, self.older = memo, older
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and where each id's bytes end."""
        length = self.v.length[ids]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        at = np.arange(total) + np.repeat(self.v.start[ids] - (end - length), length)
        return self.v.data[at], end

    def encode(self, texts: list[str], trust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and decoded bytes of texts, none empty, end to end, and where each text's ids and bytes end."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        data = np.frombuffer(joined.encode(), np.uint8)
        chars = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(points), bool)
        first[0] = True
        first[chars[:-1]] = True
        start = pre_tokens(points, first)
        text_at = np.append(np.searchsorted(start, chars[:-1]), len(start))
        if len(data) != len(points):
            width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            start = np.concatenate(([0], np.cumsum(width)))[start]
        end = np.append(start[1:], len(data))
        key = span_hashes(data, start, end)
        rank = self.v.find(key)
        hit = (self.v.hashes[rank] == key) & (self.v.length[rank] == end - start)
        if not trust:
            hit &= np.fromiter((self.v.tokens[r] == data[s:e].tobytes() for r, s, e in zip(rank, start, end, strict=True)), bool, len(rank))
        miss = np.flatnonzero(~hit)
        count = np.ones(len(start), np.int64)
        if len(miss):
            if trust:
                _, one, which = np.unique(key[miss], return_index=True, return_inverse=True)
            else:
                one = which = np.arange(len(miss))
            plain = joined.encode()
            words = self.merged([plain[s:e] for s, e in zip(start[miss[one]].tolist(), end[miss[one]].tolist(), strict=True)])
            sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
            pool, pool_at = np.frombuffer(b"".join(words), np.uint32), np.cumsum(sizes) - sizes
            count[miss] = sizes[which]
        id_end = np.cumsum(count)
        ids = np.empty(int(id_end[-1]), np.uint32)
        ids[(id_end - 1)[hit]] = rank[hit]
        if len(miss):
            n = count[miss]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids[step + np.repeat((id_end - count)[miss], n)] = pool[step + np.repeat(pool_at[which], n)]
        back, byte_end = self.decode(ids)
        if trust and not np.array_equal(back, data):
            return self.encode(texts, trust=False)  # two strings share a 64-bit hash: settle it byte by byte
        text_ids = id_end[text_at - 1]
        return ids, back, text_ids, byte_end[text_ids - 1]


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PACK_CHARS and (cut := _BREAK.search(text, at + PACK_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_encoders: dict[int, Encoder] = {}


def encode_table(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the bytes that they
    decode to. The vocabulary file is read on the driver; its tables (about 2 MB for 50,000 tokens,
    whatever the corpus) are broadcast. One narrow pass over the input, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path))
    key = hash((vocabulary_path, id(shared)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        encoder = _encoders[key]
        for batch in batches:
            n = batch.num_rows
            counts, ids_sha, text_sha = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            kept: list[list[np.ndarray]] = [[] for _ in range(n)] if with_ids else []
            rows: list[int] = []
            texts: list[str] = []
            size = 0

            def flush():
                nonlocal size
                if not rows:
                    return
                ids, back, id_ends, byte_ends = encoder.encode(texts)
                raw, plain = ids.astype("<u4").tobytes(), back.tobytes()
                i = b = 0
                for row, ie, be in zip(rows, id_ends.tolist(), byte_ends.tolist(), strict=True):
                    counts[row] += ie - i
                    ids_sha[row].update(raw[4 * i : 4 * ie])
                    text_sha[row].update(plain[b:be])
                    if with_ids:
                        kept[row].append(ids[i:ie])
                    i, b = ie, be
                rows.clear()
                texts.clear()
                size = 0

            for row, text in enumerate(batch.column(1)):
                for piece in _pieces(text.as_py() or ""):
                    if piece:
                        rows.append(row)
                        texts.append(piece)
                        size += len(piece)
                        if size >= PACK_CHARS:
                            flush()
            flush()
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in ids_sha]), pa.array([h.hexdigest() for h in text_sha])]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array([np.concatenate(k).astype(np.int32) if k else [] for k in kept], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    chosen = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"))
    schema = f"`{id_column}` {chosen.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return chosen.mapInArrow(encode, schema)


def decode_ids(table: DataFrame, vocabulary_path: str, ids_column: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of an array of ids; null ids give null. Unknown ids raise."""
    shared = table.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path).tokens)

    @F.pandas_udf("binary")
    def decoded(ids):
        tokens = shared.value
        return ids.map(lambda x: None if x is None else b"".join(tokens[i] for i in x))

    return table.withColumn("decoded", decoded(F.col(ids_column)))
