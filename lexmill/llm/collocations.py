"""Phrase collocation mining: count tries of bounded depth per shard, merged by prefix range, and scored by their weakest cut.

A shard is the texts of a task. Its trie has a node for every phrase of at most ``DEPTH`` words, per language: level by level, a
node is a node of the level above and a word. Tries are cut into prefix ranges (by a hash of the first two words), serialised with the phrases
of each in order, and the segments that all shards have of a range are merged by one task, segment by segment. In the merged trie the walk from the root to a phrase passes
its left parts, and k suffix links lead to the right part behind the first k words; both are lookups by path.

Most phrases are far too rare to matter. Two passes over the texts therefore count phrases in ``SLOTS`` counters for each length, by hash: first
words and pairs, then longer phrases of pairs that may be frequent. A counter never shows less than the true count, and a part occurs at least as often
as its phrase. So a shard's trie leaves out every phrase whose counter, or that of one of its parts, stays under the least count: nothing frequent
is lost, at any size, and where the counters are too few for a corpus only more rows are merged. All counts of what is kept are exact.

Null texts are empty; a null language is ``und``. A text is read whole; phrases never cross a piece. Repeated rows count as often as they
occur. Equal scores go to the greater count, then to the phrase first in UTF-8 byte order. An empty table, and one without frequent phrases,
give no rows. Only the two named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm._shared import U, forget, mix64, saved, span_hashes

DEPTH, LEAST, TOP = 5, 100, 2000
#: A phrase goes if a longer one has at least so many percent of its occurrences.
COVERED = 100
UNDETERMINED = "und"
#: Counters of one phrase length, a power of two; 4 bytes each in a task, one bit each in the broadcast.
SLOTS = 1 << 23
PART = 1 << 16
CHUNK_BYTES = 8 << 20
#: Nodes at which a task writes its trie and begins another, and at which segments are summed.
NODES = 1 << 19
#: Prefix ranges of the tries for each shuffle partition.
RANGES = 4
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_NO_WORD = _BREAK.copy()
_NO_WORD[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = U(0x9FB21C651E98DF25)


class Shard:
    """The words of some texts: exact numbers into a dictionary, and for each place the language, the piece and path hashes."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        gap = _NO_WORD[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        self.piece = np.cumsum(_BREAK[data], dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
        offsets = np.concatenate(([0], np.cumsum(end - start)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~gap])]).dictionary_encode()
        self.names: list[bytes] = words.dictionary.to_pylist()
        self.word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = sorted(set(langs))
        self.langs = own
        number = {x: i for i, x in enumerate(own)}
        text_end = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(text_end, start, "right")
        self.lang = np.array([number[x] for x in langs], np.int64)[owner] if len(start) else np.zeros(0, np.int64)
        self.name_hash, self.lang_hash = _hashes(self.names), _hashes([x.encode() for x in own])

    def path_hashes(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length, the hash of the phrase from every place on and whether it stays within a piece."""
        n, word = len(self.word), self.name_hash[self.word] if len(self.word) else np.zeros(0, U)
        path = self.lang_hash[self.lang] if n else np.zeros(0, U)
        for m in range(1, min(depth, n) + 1):
            path = mix64(path[: n - m + 1] * _STEP + word[m - 1 :])
            yield path, self.piece[: n - m + 1] == self.piece[m - 1 :]


def _hashes(names: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(names), np.uint8)
    end = np.cumsum([len(x) for x in names], dtype=np.int64)
    return span_hashes(data, np.concatenate(([0], end[:-1])).astype(np.int64), end, 13) if names else np.zeros(0, U)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        texts, langs, size = [], [], 0
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            texts.append(raw)
            langs.append(lang)
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield Shard(texts, langs)
                texts, langs, size = [], [], 0
        if texts:
            yield Shard(texts, langs)


def _slot(path: np.ndarray, slots: int) -> np.ndarray:
    return (path >> U(64 - (slots.bit_length() - 1))).astype(np.int64)


def _possible(shard: Shard, depth: int, slots: int, reached: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, path hashes, places) of the phrases that stay within a piece and whose parts, and they themselves where their length has been
    counted, all have counters that reach the least count."""
    alive = np.ones(len(shard.word) + 1, bool)
    for m, (path, whole) in enumerate(shard.path_hashes(depth), 1):
        alive = alive[:-1] & alive[1:] & whole if m > 1 else whole
        if m <= len(reached):
            alive = alive & reached[m - 1][_slot(path, slots)]
        yield m, path, np.flatnonzero(alive)


def _bits(shared, slots: int) -> list[np.ndarray]:
    return list(np.unpackbits(np.frombuffer(b"".join(shared.value), np.uint8)).reshape(-1, slots).astype(bool))


def _counters(first: int, last: int, slots: int, shared):
    """(part, counts) of one task's counters for the lengths from first to last, parts numbered through all lengths; bytes of equal weight lie
    together, so that they pack well."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros((last - first + 1, slots), np.int32), False
        reached = _bits(shared, slots)
        for shard in _shards(batches):
            for m, path, at in _possible(shard, last, slots, reached):
                if m >= first:
                    np.add.at(counts[m - first], _slot(path[at], slots), 1)
                    some = True
        if some:
            part, press = min(PART, slots), zstandard.ZstdCompressor(level=1)
            packed = [press.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()) for x in counts.reshape(-1, part)]
            for at in range(0, len(packed), 64):
                own = packed[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(own)), pa.int32()), pa.array(own, pa.binary())], ["part", "counts"])

    return count


def _reached(least: int):
    """(part, bits): which counters of all tasks together reach the least count. Rows of a part are added up as they come."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        part, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_py()
                counts = np.ascontiguousarray(np.frombuffer(press.decompress(batch.column(1)[i].as_py()), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
                if own != part:
                    if part is not None:
                        yield done()
                    part, total = own, np.zeros(len(counts), np.int64)
                total += counts
        if part is not None:
            yield done()

    return reach


def prefix_range(lang: str, phrase: str, ranges: int) -> int:
    """Phrases that begin with the same two words (or are one word) share a range, whatever follows."""
    return zlib.crc32(f"{lang} {' '.join(phrase.split(' ', 2)[:2])}".encode()) % ranges


def _tries(depth: int, slots: int, shared, ranges: int):
    """Of each task's trie, cut where it has ``NODES`` nodes, a row (lang, range, words, phrases, counts) for each prefix range, its phrases sorted, one a line;
    and with range -1 the number of all words of a language."""

    def rows(trie: dict[tuple, int], words: dict[str, int]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        parts: dict[tuple, list[str]] = {}
        for lang, phrase in trie:
            parts.setdefault((lang, prefix_range(lang, phrase, ranges)), []).append(phrase)
        out = [(lang, -1, n, None, None) for lang, n in words.items()]
        for (lang, number), phrases in parts.items():
            phrases.sort()
            out.append((lang, number, 0, press.compress("\n".join(phrases).encode()), np.array([trie[lang, x] for x in phrases], np.int64).tobytes()))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for at in range(0, len(out), 1024):
            columns = zip(*out[at : at + 1024], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "range", "words", "phrases", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, trie, words = _bits(shared, slots), {}, {}
        for shard in _shards(batches):
            for lang, n in zip(shard.langs, np.bincount(shard.lang, minlength=len(shard.langs)).tolist(), strict=True):
                words[lang] = words.get(lang, 0) + n
            for key, f in grown(shard, reached):
                trie[key] = trie.get(key, 0) + f
            if len(trie) >= NODES:
                yield from rows(trie, words)
                trie, words = {}, {}
        yield from rows(trie, words)

    def grown(shard: Shard, reached: list[np.ndarray]) -> Iterator[tuple[tuple, int]]:
        """The nodes of one shard, level by level."""
        node, paths, size = shard.lang, [(lang, "") for lang in shard.langs], len(shard.names)
        for m, path, at in _possible(shard, depth, slots, reached):
            if not len(at):
                break
            key, which, counts = np.unique(node[at] * size + shard.word[at + m - 1], return_inverse=True, return_counts=True)
            node = np.zeros(len(path), np.int64)
            node[at] = which
            above, names = [paths[k] for k in (key // size).tolist()], [shard.names[k].decode() for k in (key % size).tolist()]
            paths = [(lang, f"{up} {name}" if m > 1 else name) for (lang, up), name in zip(above, names, strict=True)]
            yield from zip(paths, counts.tolist(), strict=True)

    return build


def _merged(least: int):
    """(lang, phrase, m, f): the sums of rows (lang, range, phrases, counts) that come in order of language and range; phrases under the least count go.

    The segments of a range come one by one; whenever they have more rows than ``NODES`` beside the sums so far, they are summed."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        last, held, more = None, [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("phrase").aggregate([("f", "sum")]).select(["phrase", "f_sum"]).rename_columns(["phrase", "f"])

        def done() -> pa.RecordBatch:
            rows = summed()
            rows = rows.filter(pc.greater_equal(rows["f"], least)).sort_by("phrase").combine_chunks()
            phrase, f = (rows[c].combine_chunks() if rows.num_rows else pa.array([], rows[c].type) for c in ("phrase", "f"))
            m = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([last[0]] * len(phrase), pa.string()), phrase.cast(pa.string()), m, f], ["lang", "phrase", "m", "f"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key != last:
                    if held:
                        yield done()
                    last, held, more = key, [], 0
                phrases = press.decompress(batch.column(2)[i].as_py()).decode().split("\n")
                held.append(pa.table({"phrase": pa.array(phrases, pa.large_string()), "f": pa.array(np.frombuffer(batch.column(3)[i].as_py(), np.int64))}))
                more += len(phrases)
                if more >= NODES:
                    held, more = [summed()], 0
        if held:
            yield done()

    return merge


_ROWS = "lang string, phrase string, m int, f long"


def frequent_phrases(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", depth: int = DEPTH, least: int = LEAST, slots: int = SLOTS) -> DataFrame:
    """The merged trie: lang, phrase, m words, f occurrences of every phrase of at most depth words and at least ``least`` occurrences;
    and for each language a row of m 0, without a phrase, with the number of all its words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_column).cast("string"), F.lit(UNDETERMINED)).alias("lang"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits: list[bytes] = []
    for first, last in ((1, min(2, depth)), (3, depth)):
        if first <= last:
            known = spark.sparkContext.broadcast(bits)
            counters = texts.mapInArrow(_counters(first, last, slots, known), "part int, counts binary")
            # One bit a counter: depth * slots / 8 bytes in all, whatever the corpus.
            found = counters.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_reached(least), "part int, bits binary").collect()
            reached = {r.part: bytes(r.bits) for r in found}
            part = min(PART, slots)
            bits = bits + [reached.get(i, bytes(part // 8)) for i in range((last - first + 1) * slots // part)]
    shared = spark.sparkContext.broadcast(bits)
    ranges = RANGES * parts
    tries = saved(texts.mapInArrow(_tries(depth, slots, shared, ranges), "lang string, range int, words long, phrases binary, counts binary"))
    segments = tries.where("range >= 0").select("lang", "range", "phrases", "counts").repartition(parts, "lang", "range").sortWithinPartitions("lang", "range")
    words = tries.where("range < 0").groupBy("lang").agg(F.sum("words").alias("f")).where("f > 0").select("lang", F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("m"), "f")
    merged = saved(segments.mapInArrow(_merged(least), _ROWS).union(words))
    forget(tries)
    return merged


def _part(phrase: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def scored(trie: DataFrame) -> DataFrame:
    """lang, phrase, m, a, k, l, r, n, score of every phrase of two words or more, by its lowest cut."""
    nodes = trie.where("m > 0")
    words = trie.where("m = 0").select("lang", F.col("f").alias("n"))
    cuts = nodes.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumn("left", _part(F.col("phrase"), F.lit(1), F.col("k"))).withColumn("right", _part(F.col("phrase"), F.col("k") + 1, F.col("m") - F.col("k")))
    walked = cuts.join(nodes.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    linked = walked.join(nodes.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(words, "lang")
    # Up to 10^15 words and counts: both products fit 38 digits, and so does 1000 times a count fit 19.
    score = F.expr("CAST(1000 * a AS decimal(19,0)) * CAST(n AS decimal(19,0)) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    cut = linked.select("lang", "phrase", "m", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    return cut.groupBy("lang", "phrase").agg(F.first("m").alias("m"), F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut")).select("lang", "phrase", "m", "a", "n", "cut.*")


def collocations(trie: DataFrame, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, k: the best phrases of each language that no longer one covers.

    Of the longer phrases only those of one word more need a look: each longer one contains such a phrase, which is at least as frequent.
    """
    more = trie.where("m > 2")
    longer = more.select("lang", _part(F.col("phrase"), F.lit(1), F.col("m") - 1).alias("phrase"), "f").union(more.select("lang", _part(F.col("phrase"), F.lit(2), F.col("m") - 1), "f")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = scored(trie).join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * covered))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")


def collocation_table(docs: DataFrame, top: int = TOP) -> DataFrame:
    return collocations(saved(frequent_phrases(docs)), top).drop("k")


def oracle_sql() -> str:
    """All phrases spelled out and counted."""
    depth = range(1, DEPTH + 1)
    grams = "\n  UNION ALL ".join(f"SELECT lang, w[i:i + {m - 1}] AS p, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM w WHERE len(w) >= {m}) GROUP BY 1, 2 HAVING count(*) >= {LEAST}" for m in depth)
    return rf"""
WITH t AS (SELECT coalesce(lang, '{UNDETERMINED}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS ({grams}),
c AS (SELECT a.lang, a.p, a.f AS a, l.f AS l, r.f AS r, n.n, ((1000 * a.f)::HUGEINT * n.n) // (l.f::HUGEINT * r.f) AS score, k FROM (SELECT *, unnest(range(1, len(p))) AS k FROM g WHERE len(p) > 1) a
  JOIN g l ON l.lang = a.lang AND l.p = a.p[:k] JOIN g r ON r.lang = a.lang AND r.p = a.p[k + 1:] JOIN n ON n.lang = a.lang
  QUALIFY row_number() OVER (PARTITION BY a.lang, a.p ORDER BY score, k) = 1),
d AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, p[:len(p) - 1] AS p, f FROM g WHERE len(p) > 2 UNION ALL SELECT lang, p[2:], f FROM g WHERE len(p) > 2) GROUP BY 1, 2)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(array_to_string(c.p, ' ')))::INTEGER AS rank, array_to_string(c.p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM c LEFT JOIN d ON d.lang = c.lang AND d.p = c.p WHERE d.f IS NULL OR 100 * d.f < {COVERED} * a
QUALIFY row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(array_to_string(c.p, ' '))) <= {TOP}"""
