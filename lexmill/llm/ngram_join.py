"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and the groups that it links.

Documents with equal sets are one node. Nodes meet in groups under a key:

* Small sets enumerate fixed-size subsets. Two sets of n and m shingles that link share at least
  c = ceil(t (n + m) / (1 + t)) of them, hence a subset of c; a small set emits a key for each of its
  subsets of every such size.
* Large sets are scanned by inverted lists, whose keys are pairs of shingles that are neighbours when a set is
  sorted: rare shingles by hash, then common ones (of a share of the sets that is at least ``COMMON``) by hash. Between
  sets that link, every shingle that only one of them has spoils one pair of common neighbours at most, so, whatever the
  order, an unspoilt one stands among the first 2 (n - c) + (m - c) + 2 shingles of the set of n. Passages that many
  documents share stand last and seldom come into reach, and chance neighbours are few, so lists stay short.

The boundary between the two is the one whose measured cost (keys against list rows and the pairs
that the lists would hold) is least; sets near it take part in both ways.

A group is not expanded into its pairs at once. First each member meets the group's most central member, by
the majority of the parity maps, and its neighbour by size; what links is joined into components. Then only members of different
components meet, in those groups that have such. With count_links all members meet in a further pass, so every link is found; its
rows are as many as the pairs that may link. Set sizes and parity maps, whose difference never exceeds that of
the sets, rule pairs out exactly: 256 bits beside every row, and some bits per shingle where members of different components
meet and for the pairs that are left. What remains is verified on the whole texts.

A null or empty text and one without words has no shingles, size 0, and is linked with nothing, not
even with its like. A document of fewer words than a shingle is one shingle. Repeated rows of a doc_id are in
one component, whatever their texts, unless join_ids is off. A null doc_id has a null component unless its set
occurs with an id. Only the two named columns are read. Shingles, sets and texts are identified by 64-bit digests: words
by a hash that no pattern of letters cancels out, of which shingles and sets are scrambled sums. Two texts are taken for one
only if all of that collides by chance. A set's text is fetched by id and text digest, as an id can have several texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm._shared import U, components, mix64, rolling, saved, span_hashes, word_spans

SHINGLE, PERCENT = 4, 85
#: Upper ends of the size classes between which the boundary is chosen; subsets of more would be too many.
BOUNDARIES = (6, 13, 19)
#: So many ids at most are broadcast to fetch texts; beyond, texts are shuffled.
FETCHED = 1 << 19
CHUNK_BYTES = 1 << 21
#: So many shingles at most are counted together when the common ones are sought.
SPELL_SHINGLES = 1 << 21
#: Share of the sets from which a shingle counts as common; at most the average size of a set over this are common.
COMMON = 1 / 500
SLAB = 4096
#: Groups of more rows meet slab by slab, so many pairs at once.
LARGE_GROUP, GRID = 256, 1 << 18
#: So many pairs of a task are held at once.
HELD_PAIRS = 1 << 20
_SUBSET = 0x9E6C63D0876A9A47


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit shingle hashes of each text, A-Z taken as a-z."""
    data, start, end, counts = word_spans(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    words = span_hashes(data, start, end)
    grams = rolling(words, k, k)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= k:
            sets.append(np.unique(grams[at : at + n - k + 1]))
        else:
            sets.append(rolling(words[at : at + n], n, 1000 + n) if n else np.zeros(0, U))
        at += n
    return sets


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(id, text key) and text of rows (id, text, text key), a few megabytes at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            ids.append(key)
            texts.append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def overlap(n, m, percent: int = PERCENT):
    """How many shingles sets of n and m share at least if they link."""
    return -(-percent * (n + m) // (100 + percent))


def reach(n, m, percent: int = PERCENT):
    """How far into a set of n the first unspoilt pair of neighbours shared with a set of m can end."""
    c = overlap(n, m, percent)
    return 2 * (n - c) + (m - c) + 2


@lru_cache(maxsize=1 << 16)
def longest_reach(n: int, percent: int = PERCENT) -> int:
    """The reach towards partners of any size; the smallest partners need most, up to rounding."""
    low = (percent * n + 99) // 100
    return min(n, max(reach(n, m, percent) for m in range(low, low + 4)))


def list_keys(members: np.ndarray, percent: int = PERCENT, common: np.ndarray | None = None) -> np.ndarray:
    """Key i stands for the neighbours i and i + 1, of members in order of hash, those among the sorted ``common`` last."""
    if common is not None and len(common):
        last = common[np.minimum(np.searchsorted(common, members), len(common) - 1)] == members
        members = np.concatenate((members[~last], members[last]))
    own = members[: longest_reach(len(members), percent)]
    return mix64(own[:-1] * U(0x9FB21C651E98DF25) + own[1:])


def subset_sizes(n: int, most: int, percent: int = PERCENT) -> list[int]:
    """Every overlap that a set of n must reach with some set of at most ``most``."""
    low, high = (percent * n + 99) // 100, min(most, 100 * n // percent)
    return sorted({overlap(n, m, percent) for m in range(low, high + 1)})


def _set_key(members: np.ndarray) -> int:
    return int(mix64(mix64(members ^ U(_SUBSET)).sum(dtype=U)[None] + U(len(members)))[0])


def _parity(members: np.ndarray, size: int = 256) -> bytes:
    """For each of size places (a power of two) whether an odd number of members falls there."""
    spots = (mix64(members ^ U(0xC2B2AE3D27D4EB4F)) & U(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(spots, minlength=size) & 1).astype(np.uint8)).tobytes()


def _fine_parity(members: np.ndarray) -> bytes:
    return _parity(members, max(256, 1 << int(2 * len(members) - 1).bit_length()))


def _parity_gaps(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """In how many places the maps of each pair differ, the longer one folded to the shorter."""
    gaps = np.empty(len(one), np.int64)
    lengths = np.array([(len(a), len(b)) for a, b in zip(one, two, strict=True)], np.int64).reshape(-1, 2)
    for la, lb in np.unique(lengths, axis=0).tolist():
        every = np.flatnonzero((lengths == (la, lb)).all(1))
        short, step = min(la, lb), max(1, (1 << 23) // max(la, lb))
        for at in range(0, len(every), step):
            own = every[at : at + step].tolist()
            fold = lambda maps, n: np.bitwise_xor.reduce(np.frombuffer(b"".join([maps[i] for i in own]), np.uint64).reshape(len(own), n // short, short // 8), axis=1)  # noqa: B023, E731
            gaps[own] = np.bitwise_count(fold(one, la) ^ fold(two, lb)).sum(1)
    return gaps


def _subset_count(n: int, most: int, percent: int) -> int:
    total = 0
    for c in subset_sizes(n, most, percent):
        ways = 1
        for i in range(n - c):
            ways = ways * (n - i) // (i + 1)
        total += ways
    return total


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _digest(percent: int, k: int):
    """kind 0: (id, text key, set key, size, parity maps); 1: (class, 0 to 2, list rows, pairs per mille of the documents, subset keys);
    2: (shingle, sets that hold it) of shingles that many sets of a window hold."""

    def spell(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        low = 0
        for number, high in enumerate(BOUNDARIES):
            own = [s for s in sets if low < len(s) <= high]
            if own:
                tokens = np.concatenate([list_keys(s, percent) for s in own])
                together = np.unique(tokens, return_counts=True)[1].astype(np.int64)
                pairs = int((together * (together - 1)).sum()) * 500 // len(sets)
                keys = sum(_subset_count(len(s), high, percent) for s in own)
                yield out(1, [number] * 3, [None] * 3, [0, 1, 2], [len(tokens), pairs, keys], [None] * 3, [None] * 3)
            low = high
        shingle, holders = np.unique(np.concatenate(sets), return_counts=True)
        many = holders >= max(4, COMMON * len(sets) / 2)
        none = [None] * int(many.sum())
        yield out(2, shingle[many].view(np.int64), none, none, holders[many], none, none)

    def out(kind: int, ids, texts, keys, sizes, bits, fine) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(sizes), kind, np.int32)), pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(fine, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "id", "text_key", "key", "n", "bits", "fine"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        count = 0
        for ids, texts in _chunks(batches):
            sets = shingle_sets(texts, k)
            keys = np.array([_set_key(s) for s in sets], U).view(np.int64)
            yield out(0, *zip(*ids, strict=True), keys, [len(s) for s in sets], [_parity(s) for s in sets], [_fine_parity(s) for s in sets])
            for key, own in zip(keys.tolist(), sets, strict=True):
                if len(own) and key not in held:
                    held[key] = own
                    count += len(own)
            if count >= SPELL_SHINGLES:
                yield from spell(list(held.values()))
                held, count = {}, 0
        if held:
            yield from spell(list(held.values()))

    return digest


def _emitter(boundary: int, percent: int, k: int, common):
    """(key, node, n, place): subset keys at place 0, list keys at that of their second shingle, from 1. common: broadcast."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches):
            keys, nodes, sizes, places, seen = [], [], [], [], set()
            for members in shingle_sets(texts, k):
                n = len(members)
                if not n or (node := _set_key(members)) in seen:
                    continue
                seen.add(node)
                own = []
                if n <= boundary:
                    mixed = mix64(members ^ U(_SUBSET))
                    total = int(mixed.sum(dtype=U))
                    values = mixed.tolist()
                    own += [np.array([(total - sum(gone) + c * _SUBSET) & 0xFFFFFFFFFFFFFFFF for gone in combinations(values, n - c)], U) for c in subset_sizes(n, boundary, percent)]
                    own = [mix64(x) for x in own]
                    places += [np.zeros(len(x), np.int32) for x in own]
                if 100 * n > percent * boundary:
                    own.append(list_keys(members, percent, common.value))
                    places.append(np.arange(2, len(own[-1]) + 2, dtype=np.int32))
                if own:
                    keys += own
                    count = sum(map(len, own))
                    nodes.append(np.full(count, node, U))
                    sizes.append(np.full(count, n, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), _signed(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["key", "node", "n", "place"])

    return emit


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, n and node: those whose key has another node, each once."""
    last = None
    shown = False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if last is not None:
            columns = [np.concatenate(([x], c)) for x, c in zip(last, columns, strict=True)]
        key, node = columns[:2]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        columns = [c[keep] for c in columns]
        key = columns[0]
        same = key[1:] == key[:-1]
        show = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if last is not None and shown:
            show[0] = False
        if show.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[show]) for c in columns], ["key", "node", "n", "place"])
        shown = bool(show[-1]) or (len(key) == 1 and last is not None and shown)
        last = tuple(c[-1] for c in columns)


class _Group:
    """Rows of whole keys, sorted by key and n, as arrays."""

    def __init__(self, batch: pa.RecordBatch, percent: int):
        self.key, self.node, self.n, self.place, self.component = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5))
        bits = batch.column(4).to_pylist()
        self.bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), 4)
        self.fine = batch.column(6).to_pylist() if batch.num_columns > 6 else None
        self.percent = percent

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes, places and parity maps leave the pair possible; n[a] <= n[b]."""
        n, m = self.n[a].astype(np.int64), self.n[b].astype(np.int64)
        least = overlap(n, m, self.percent)
        apart = n + m - 2 * np.minimum(least, n)
        ok = (least <= n) & (self.place[a] <= reach(n, m, self.percent)) & (self.place[b] <= reach(m, n, self.percent)) & (self.node[a] != self.node[b])
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(self.bits[a[at]] ^ self.bits[b[at]]).sum(1) <= apart[at]
        return ok

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each member with the group's most central one, and with the one before it."""
        new = np.concatenate(([True], self.key[1:] != self.key[:-1]))
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        every = np.arange(len(self.key))
        centre = np.empty(len(start), np.int64)
        for at in range(0, len(start), SLAB):
            lo, hi = start[at], start[at + SLAB] if at + SLAB < len(start) else len(self.key)
            votes = np.add.reduceat(np.unpackbits(self.bits[lo:hi].view(np.uint8), axis=1).astype(np.int32), start[at : at + SLAB] - lo, axis=0)
            most = np.packbits(2 * votes > np.diff(np.append(start[at : at + SLAB], hi))[:, None], axis=1).view(np.uint64)
            gap = np.bitwise_count(self.bits[lo:hi] ^ most[group[lo:hi] - at]).sum(1)
            order = np.lexsort((every[lo:hi], gap, group[lo:hi]))
            centre[at : at + SLAB] = order[start[at : at + SLAB] - lo] + lo
        mid = centre[group]
        for a, b in ((np.minimum(mid, every), np.maximum(mid, every)), (every[~new] - 1, every[~new])):
            ok = self.fits(a, b)
            yield a[ok], b[ok]

    def across(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members of different components."""
        return self._meet(lambda a, b: self.component[a] != self.component[b])

    def every(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All members."""
        return self._meet(lambda a, b: np.ones(len(a), bool))

    def _meet(self, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each row with the later rows of its group; sizes ascend, so those too large for a row end its search."""
        new = np.concatenate(([True], self.key[1:] != self.key[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(self.key)))
        a = np.flatnonzero(np.repeat(size <= LARGE_GROUP, size))
        step = 1
        while len(a):
            a = a[a + step < len(self.key)]
            a = a[(self.key[a + step] == self.key[a]) & (100 * self.n[a].astype(np.int64) >= self.percent * self.n[a + step].astype(np.int64))]
            other = a[wanted(a, a + step)]
            ok = self.fits(other, other + step)
            yield other[ok], other[ok] + step
            step += 1
        for low, count in zip(start[size > LARGE_GROUP].tolist(), size[size > LARGE_GROUP].tolist(), strict=True):
            yield from self._grid(np.arange(low, low + count), wanted)

    def _grid(self, rows: np.ndarray, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One large group, slabs of rows against all later ones that are not too large. Rows of the component that has most
        rows here have only others to meet, and are met by them."""
        _, which, counts = np.unique(self.component[rows], return_inverse=True, return_counts=True)
        lead = rows if wanted(rows[:1], rows[:1]).all() else rows[which != counts.argmax()]
        n = self.n[rows].astype(np.int64)
        led = np.isin(rows, lead, assume_unique=True)
        step = max(1, GRID // len(rows))
        for at in range(0, len(lead), step):
            own = lead[at : at + step]
            sizes = self.n[own].astype(np.int64)
            lo = np.searchsorted(100 * n, self.percent * sizes.min())
            hi = np.searchsorted(self.percent * n, 100 * sizes.max(), "right")
            x, y = np.repeat(own, hi - lo), np.tile(rows[lo:hi], len(own))
            # of two leading rows the earlier one leads
            keep = wanted(x, y) & ((x < y) | ~np.tile(led[lo:hi], len(own)))
            x, y = x[keep], y[keep]
            x, y = np.minimum(x, y), np.maximum(x, y)
            ok = self.fits(x, y)
            yield x[ok], y[ok]


def _pairs(way: str, percent: int):
    """(a, b) of rows (key, node, n, place, bits, component) sorted by key, n and node, with fine maps in a seventh column if they are to be used."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # all of one key but for the first, which ends with it
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(key, key[-1]))
            if held and (cut or key[0] != held[-1].column(0)[-1].as_py()):
                yield from found([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield from found([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from found(held)

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(pa.concat_batches(parts) if len(parts) > 1 else parts[0], percent)
        got, held = [], 0
        for a, b in getattr(group, way)():
            if len(a):
                got.append(np.stack((a, b), 1))
                held += len(a)
            if held >= HELD_PAIRS:
                yield from distinct(group, got)
                got, held = [], 0
        if got:
            yield from distinct(group, got)

    def distinct(group: _Group, got: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = np.concatenate(got)
        ends = np.sort(group.node[at], axis=1)
        _, first = np.unique(ends, axis=0, return_index=True)
        if group.fine is not None:
            n = group.n[at[first]].astype(np.int64)
            apart = n.sum(1) - 2 * overlap(n[:, 0], n[:, 1], percent)
            first = first[_parity_gaps(*([group.fine[i] for i in at[first, side].tolist()] for side in (0, 1))) <= apart]
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[first, side])) for side in (0, 1)], ["a", "b"])

    return pair


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [press.compress((t.as_py() or "").encode()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["node", "packed"])


def _finer(percent: int):
    """Pairs whose fine parity maps leave them possible."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            apart = n + m - 2 * overlap(n, m, percent)
            ok = _parity_gaps(batch.column(4).to_pylist(), batch.column(5).to_pylist()) <= apart
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return sift


def _verify(percent: int, k: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        kept: tuple = (None, None)
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                left, right = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if kept[0] != left:
                    kept = (left, shingle_sets([unpress.decompress(batch.column(2)[i].as_py())], k)[0])
                one, two = kept[1], shingle_sets([unpress.decompress(batch.column(3)[i].as_py())], k)[0]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    a.append(left)
                    b.append(right)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verify


def text_key(text: Column) -> Column:
    """What tells the texts of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, k: int = SHINGLE, join_ids: bool = True, count_links: bool = False) -> DataFrame:
    """id, text_key, n_shingles, component_id, and kept: whether the row's id and text are the first of its component.

    With count_links also n_links: with how many different sets the document's own is linked directly. Only sets that occur with an id count.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), text_key(F.col(text_column)).alias("text_key"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digest = saved(texts.mapInArrow(_digest(percent, k), "kind int, id long, text_key long, key long, n long, bits binary, fine binary"))
    rows = digest.where("kind = 0").select("id", "text_key", F.col("key").alias("node"), "n")
    nodes = saved(digest.where("kind = 0 AND n > 0").groupBy(F.col("key").alias("node")).agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "text_key"))).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fine").alias("fine")))
    total = rows.count()
    costs = {(r[0], r[1]): r[2] for r in digest.where("kind = 1").groupBy("id", "key").agg(F.sum("n")).collect()}
    boundary, cost, best = 0, 0.0, 0.0
    for number, high in enumerate(BOUNDARIES):
        lists = costs.get((number, 0), 0) + costs.get((number, 1), 0) * total / 1000
        cost += costs.get((number, 2), 0) - lists
        if cost < best:
            boundary, best = high, cost

    # At most the average size of a set over COMMON: a few megabytes.
    often = digest.where("kind = 2").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON * total).select("id").collect()
    common = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often], np.int64).view(U)))
    emitted = texts.mapInArrow(_emitter(boundary, percent, k, common), "key long, node long, n int, place int")
    lists = saved(emitted.repartition(parts, "key").sortWithinPartitions("key", "n", "node").mapInArrow(_shared_keys, "key long, node long, n int, place int"))
    mapped = lists.join(nodes.select("node", "bits"), "node").withColumn("component", F.col("node"))
    whole_key = ["key", "node", "n", "place", "bits", "component"]

    def candidates(way: str, met: DataFrame) -> DataFrame:
        ordered = met.repartition(parts, "key").sortWithinPartitions("key", "n", "node")
        return ordered.mapInArrow(_pairs(way, percent), "a long, b long").distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("fine").alias(f"f_{end}"))
        mapped_pairs = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "f_a", "f_b")
        left = saved(mapped_pairs.mapInArrow(_finer(percent), "a long, b long"))
        wanted = saved(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().join(nodes.select("node", "rep.id", "rep.text_key"), "node"))
        keys = F.broadcast(wanted) if wanted.count() <= FETCHED else wanted
        packed = texts.where("id is not null").join(keys, ["id", "text_key"]).select("node", "text").dropDuplicates(["node"])
        kept = saved(packed.mapInArrow(_packed, "node long, packed binary"))
        second = left.join(kept.select(F.col("node").alias("b"), F.col("packed").alias("p_b")), "b")
        both = second.join(kept.select(F.col("node").alias("a"), F.col("packed").alias("p_a")), "a").select("a", "b", "p_a", "p_b")
        return saved(both.mapInArrow(_verify(percent, k), "a long, b long"))

    near = saved(candidates("near", mapped.select(*whole_key)))
    links = linked(near)
    labels = components(links)
    labelled = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    fine = nodes.select("node", "bits", "fine")
    far = saved(candidates("across", saved(labelled.join(mixed, "key", "left_semi")).join(fine, "node").select(*whole_key, "fine")).join(near, ["a", "b"], "left_anti"))
    links = links.union(linked(far))
    if count_links:
        met = near.union(far)
        every = lists.withColumn("component", F.col("node")).join(fine, "node").select(*whole_key, "fine")
        links = links.union(linked(saved(candidates("every", every).join(met, ["a", "b"], "left_anti"))))
    # Ids with different sets, the empty one included; first is one of the others.
    several = rows.where("id is not null").groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.when(F.col("n") > 0, F.col("node"))).alias("first"))
    several = saved(several.where("low <> high").select("id", "first")) if join_ids else None
    joined = several is not None and not several.isEmpty()
    same_id = several.join(rows.where("n > 0"), "id").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct() if joined else None
    labels = components(links.union(same_id) if joined else links)
    by_node = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    lowest = by_node.groupBy("component").agg(F.min("rep").alias("lowest"))
    final = by_node.join(lowest, "component").select("node", "lowest")
    if count_links:
        degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
        final = final.join(degree, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    kept = (F.col("id") == F.col("lowest.id")) & (F.col("text_key") == F.col("lowest.text_key"))
    out = rows.where("n > 0").join(final, "node").select("id", "text_key", F.col("n").alias("n_shingles"), F.col("lowest.id").alias("component_id"), kept.alias("kept"), *["n_links"] * count_links)
    none = rows.where("n = 0").select("id", "text_key", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"), *[F.lit(0).cast("long").alias("n_links")] * count_links)
    if joined:
        known = several.join(final.select(F.col("node").alias("first"), F.col("lowest.id").alias("known")), "first").select("id", "known")
        none = none.join(known, "id", "left").withColumn("component_id", F.coalesce("known", "component_id")).withColumn("kept", F.col("known").isNull()).select(*out.columns)
    return out.unionByName(none).withColumnRenamed("id", id_column)


#: The contract over sf0.01: all pairs that share a shingle, then reachability.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, hash(t) AS t, t AS g FROM (SELECT doc_id, unnest(s) AS t FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.t = b.t AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = n.doc_id), n.doc_id)) AS component_id FROM n"""
