"""Substring dedup on a log-structured fingerprint index.

A window is ``window`` consecutive words. Of the hashes of its runs of ``ANCHOR`` words the least is its
fingerprint, so equal windows have equal fingerprints at equal places, and neighbouring windows mostly share
one. The index holds (fingerprint, document) in immutable runs, each bucketed and sorted by fingerprint, and the
packed texts of every batch. It consists of named tables of the warehouse, so it can be opened again and outlives a call.

Adding a batch is one cycle. Its fingerprints become a run, which is merge-joined with the runs before it (bucket by bucket,
without a shuffle of history) for the fingerprints that two documents hold. These only nominate: verification reads the
texts of their holders. First the whole stretch of words that the windows of one fingerprint cover is compared, so that
most windows are settled together; where one fingerprint stands in different stretches, each window of one holder per
stretch is compared. Either compares two unrelated 64-bit hashes of every word, by which texts are taken for equal. The
batch's documents are then judged for good; results of earlier batches are never computed again. Runs are compacted by size: the newest
are merged as long as the run before them has at most ``RATIO`` times their rows. So runs shrink by that ratio from the oldest on, there are as
many as the logarithm of the history, and a row is rewritten as often at most, not once for every batch. A compaction shuffles the rows that it merges.

A document is judged against its own and earlier batches, so ids must not descend from batch to batch; an id that is
smaller than one of an earlier batch does not change what that batch lost.

Null texts have no words. Documents with a null id are never compared: nothing is removed from them. Rows of equal id are
judged each for itself, never against one another. Texts of any length are whole. An empty table gives
an empty result. Only the two named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._shared import Powers, U, forget, mix64, rolling, saved, span_hashes, word_spans

WINDOW, ANCHOR = 13, 4
RATIO = 2.0
#: Shares of the documents, by id, at which the query's batches end.
BATCH_ENDS = (0.25, 0.5, 1.0)
CHUNK_BYTES = 1 << 21
_powers = Powers(0xA0761D6478BD642F)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's number of words."""
    data, start, end, counts = word_spans(texts)
    return span_hashes(data, start, end), counts


def _both_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _word_hashes, with unrelated hashes of the words between the two."""
    data, start, end, counts = word_spans(texts)
    return span_hashes(data, start, end), span_hashes(data, start, end, seed=1), counts


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every place the place of the least of the next ``width`` values, the leftmost of equals; by doubling."""
    least, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        lower = least[step:] < least[:-step]
        least, place, have = np.where(lower, least[step:], least[:-step]), np.where(lower, place[step:], place[:-step]), have + step
    return place


def anchors(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end the fingerprints in order: text, hash, place, and the first and last window start that each stands for,
    all places counted from the first word of all."""
    ends = np.cumsum(counts)
    grams = rolling(words, ANCHOR, 17)
    width = window - ANCHOR + 1
    if len(grams) < width:
        return (np.zeros(0, np.int64), np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)
    place = _leftmost_least(grams, width)
    text = np.repeat(np.arange(len(counts)), counts)[: len(place)]
    # Windows that reach into the next text are none.
    start = np.flatnonzero(np.arange(len(place)) + window <= ends[text])
    place, text = place[start], text[start]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))[: len(place)]
    last = start[np.append(new[1:], len(start)) - 1] if len(start) else start
    return text[new], grams[place[new]], place[new], start[new], last


def _stretch_hash(words: np.ndarray, print_place: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words that windows first to last cover, and of where in it the fingerprint stands."""
    up, down = _powers.upto(len(words) + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(mix64(words ^ U(0xE7037ED1A0B428DB)) * up[: len(words)], out=total[1:])
    end = last + window
    raw = (total[end] - total[first]) * down[first]
    return mix64(raw ^ (end - first).astype(U) * U(0x8EBC6AF09C88C6E3) ^ (print_place - first).astype(U) * U(0x589965CC75374CC3))


def _unpacked(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows and their texts, a few megabytes at a time."""
    tool = zstandard.ZstdDecompressor()
    at, size, texts = 0, 0, []
    for i, packed in enumerate(batch.column(column)):
        texts.append(tool.decompress(packed.as_py()))
        size += len(texts[-1])
        if size >= CHUNK_BYTES or i == batch.num_rows - 1:
            yield at, i + 1, texts
            at, size, texts = i + 1, 0, []


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [tool.compress((t.as_py() or "").encode()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["row", "id", "packed"])


def _fingerprints(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, texts in _unpacked(batch, 1):
                words, counts = _word_hashes(texts)
                text, h, *_ = anchors(words, counts, window)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                once = np.concatenate(([True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])))[: len(h)]
                if len(h):
                    yield pa.RecordBatch.from_arrays([_long(h[once]), pa.array(rows[lo:hi][text[once]])], ["h", "row"])

    return emit


def _stretches(window: int):
    """Of each document's shared fingerprints: (h, g, id, row, first, last) with g the hash of the stretch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, texts in _unpacked(batch, 2):
                words, others, counts = _both_hashes(texts)
                text, h, place, first, last = anchors(words, counts, window)
                lists = batch.column(3).slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
                # A fingerprint of one text that another text of the chunk shares must not count: the text goes into the hash.
                of = lambda x, t: mix64(x ^ (t.astype(U) * U(0x9E3779B97F4A7C15)))
                use = np.isin(of(h, text), of(lists.flatten().to_numpy(zero_copy_only=False).view(U), owner))
                if use.any():
                    text, h, place, first, last = (x[use] for x in (text, h, place, first, last))
                    g = _stretch_hash(others, place, first, last, window)
                    begins = (np.cumsum(counts) - counts)[text]
                    yield pa.RecordBatch.from_arrays([_long(h), _long(g), pa.array(keys[lo:hi][text]), pa.array(rows[lo:hi][text]), pa.array((first - begins).astype(np.int32)), pa.array((last - begins).astype(np.int32))], ["h", "g", "id", "row", "first", "last"])

    return emit


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, g and id: kind 0, stretches that a smaller id holds; kind 1, the holders of the smallest id
    of each stretch whose fingerprint also stands in another stretch. Holds back one document's rows at most."""
    held: tuple | None = None
    many = False  # whether the held fingerprint is known to stand in several stretches; then its held row is spent
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        spent = np.zeros(batch.num_rows, bool)
        if held is not None:
            columns = [np.concatenate((a, b)) for a, b in zip(held, columns, strict=True)]
            spent = np.concatenate((np.full(len(held[0]), many), spent))
        h, g, key, row, first, last = columns
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new = new_h | np.concatenate(([True], g[1:] != g[:-1]))
        least = key[np.flatnonzero(new)[np.cumsum(new) - 1]]
        of_h = np.cumsum(new_h) - 1
        stretches = np.bincount(of_h, weights=new)
        several = stretches > 1
        if held is not None and many and h[0] == held[0][0]:
            several[0] = True
        taken = key > least
        lead = ~taken & ~spent
        tail = of_h == of_h[-1]
        show = lead & several[of_h]
        for kind, at in ((0, np.flatnonzero(taken)), (1, np.flatnonzero(show))):
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(row[at]), pa.array(first[at]), pa.array(last[at])], ["kind", "row", "first", "last"])
        many = bool(several[-1])
        if many:
            keep = np.flatnonzero(new)[-1:]
        else:
            keep = np.flatnonzero(tail & ~taken)
        held = tuple(c[keep] for c in columns)


def _single_windows(window: int):
    """(w1, w2, id, row, start) of every window of the asked stretches."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, texts in _unpacked(batch, 2):
                words, others, counts = _both_hashes(texts)
                begins = np.cumsum(counts) - counts
                lists = batch.column(3).slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
                parts = lists.flatten()
                edge = np.zeros(len(words) + 1, np.int64)
                for name, step, more in (("first", 1, 0), ("last", -1, 1)):
                    np.add.at(edge, begins[owner] + parts.field(name).to_numpy(zero_copy_only=False) + more, step)
                start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if len(start):
                    text = np.searchsorted(begins + counts, start, "right")
                    one, two = (rolling(x, window, seed)[start] for x, seed in ((words, 29), (others, 31)))
                    yield pa.RecordBatch.from_arrays([_long(one), _long(two), pa.array(keys[lo:hi][text]), pa.array(rows[lo:hi][text]), pa.array((start - begins[text]).astype(np.int32))], ["w1", "w2", "id", "row", "start"])

    return emit


def _kept_words(window: int, with_text: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            totals, removed, digests, kept_texts = [], [], [], []
            for i in range(batch.num_rows):
                words = tool.decompress(batch.column(2)[i].as_py()).split()  # at space and bytes 9 to 13
                ranges = batch.column(3)[i].as_py()
                gone = 0
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [r["first"] for r in ranges], 1)
                    np.add.at(edge, [r["last"] + window for r in ranges], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    kept = [w for w, ok in zip(words, stays.tolist(), strict=True) if ok]
                else:
                    kept = words
                text = b" ".join(kept)
                totals.append(len(words))
                removed.append(gone)
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept_texts.append(text.decode())
            columns = [batch.column(1), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_texts, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return emit


class FingerprintIndex:
    """Tables ``{name}_text_{batch}`` of (row, id, packed), bucketed by row, and ``{name}_run_{first}_{last}`` of (h, row), bucketed
    and sorted by h, for the batches first to last. Without a name a new one is made up; an index of a known name goes on
    where it ended. A batch whose add failed leaves its own tables behind, which the next add writes over."""

    def __init__(self, spark: SparkSession, name: str | None = None, window: int = WINDOW, ratio: float = RATIO):
        self.spark, self.window, self.ratio = spark, window, ratio
        self.name = name or f"lexmill_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spans = sorted((tuple(map(int, t.split("_")[-2:])) for t in self._tables("run")), key=lambda r: (r[0], -r[1]))
        self.runs: list[tuple[int, int]] = []
        for first, last in spans:  # a run that was compacted lies inside the one that replaced it
            if not self.runs or first > self.runs[-1][1]:
                self.runs.append((first, last))
        self.batches = self.runs[-1][1] + 1 if self.runs else 0

    def _tables(self, kind: str = "") -> list[str]:
        return [r.tableName for r in self.spark.sql(f"SHOW TABLES LIKE '{self.name}_{kind}*'").collect()]

    def _run(self, run: tuple[int, int]) -> str:
        return f"{self.name}_run_{run[0]}_{run[1]}"

    def _text(self, batch: int) -> DataFrame:
        return self.spark.table(f"{self.name}_text_{batch}")

    def _write(self, name: str, rows: DataFrame, by: str) -> DataFrame:
        rows.repartition(self.buckets, by).write.mode("overwrite").bucketBy(self.buckets, by).sortBy(by).format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def _shared(self, new: DataFrame) -> DataFrame:
        """(h, row), new and historical, of fingerprints that the new run shares with history or holds in two rows."""
        twice = new.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        found = new.join(twice, "h", "left_semi")
        for run in self.runs:
            old = self.spark.table(self._run(run))
            found = found.union(new.join(old.select("h"), "h", "left_semi")).union(old.join(new.select("h"), "h", "left_semi"))
        return found

    def _holders(self, wanted: DataFrame, *columns: str) -> DataFrame:
        """The wanted rows (row, and more) with their texts, each batch that has any joined by its buckets."""
        # At most one number a batch.
        held = sorted(r[0] for r in wanted.select(F.shiftright("row", 52)).distinct().collect()) or [self.batches]
        parts = [self._text(b).join(wanted.where(F.col("row").between(b << 52, ((b + 1) << 52) - 1)), "row").select(*columns) for b in held]
        return reduce(DataFrame.union, parts)

    def add(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, compact: bool = True) -> DataFrame:
        """Adds a batch; id, n_words, n_removed, kept_sha256 (and kept) of its documents."""
        window, start = self.window, self.batches << 52
        numbered = docs.select((F.monotonically_increasing_id() + F.lit(start)).alias("row"), F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
        texts = self._write(f"{self.name}_text_{self.batches}", numbered.mapInArrow(_pack, "row long, id long, packed binary"), "row")
        run = (self.batches, self.batches)
        new = self._write(self._run(run), texts.where("id is not null").select("row", "packed").mapInArrow(_fingerprints(window), "h long, row long"), "h")
        wanted = saved(self._shared(new).groupBy("row").agg(F.collect_set("h").alias("shared")))
        stretches = self._holders(wanted, "row", "id", "packed", "shared").mapInArrow(_stretches(window), "h long, g long, id long, row long, first int, last int")
        ordered = stretches.repartition(self.buckets, "h").sortWithinPartitions("h", "g", "id")
        settled = saved(ordered.mapInArrow(_settle, "kind int, row long, first int, last int").where((F.col("kind") == 1) | (F.col("row") >= start)))
        open_ranges = saved(settled.where("kind = 1").groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("parts")))
        windows = saved(self._holders(open_ranges, "row", "id", "packed", "parts").mapInArrow(_single_windows(window), "w1 long, w2 long, id long, row long, start int"))
        least = windows.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
        taken = windows.where(F.col("row") >= start).join(least, ["w1", "w2"]).where("id > least").select("row", F.col("start").alias("first"), F.col("start").alias("last"))
        ranges = settled.where("kind = 0").select("row", "first", "last").union(taken).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
        final = texts.join(ranges, "row", "left").select("row", "id", "packed", "ranges")
        result = saved(final.mapInArrow(_kept_words(window, with_text), "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text))
        for rows in (wanted, settled, open_ranges, windows):
            forget(rows)
        self.runs.append(run)
        self.batches += 1
        if compact:
            self.compact()
        return result.withColumnRenamed("id", id_column)

    def compact(self) -> None:
        """Merges the newest runs while the one before them is not much larger."""
        sizes = [self.spark.table(self._run(r)).count() for r in self.runs]  # from the files' footers
        first, total = len(self.runs) - 1, sizes[-1] if sizes else 0
        while first > 0 and sizes[first - 1] <= self.ratio * total:
            first -= 1
            total += sizes[first]
        old = self.runs[first:]
        if len(old) < 2:
            return
        merged = (old[0][0], old[-1][1])
        self._write(self._run(merged), reduce(DataFrame.union, [self.spark.table(self._run(r)) for r in old]), "h")
        for run in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._run(run)}")
        self.runs = [*self.runs[:first], merged]

    def drop(self) -> None:
        for name in self._tables():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs, self.batches = [], 0


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, batch_ends: tuple[float, ...] = BATCH_ENDS, with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (and kept): each document without the words of windows that a smaller id holds.

    The documents are added to a new index in batches of ascending id, as they would arrive over time; the index is dropped at the end.
    """
    key = F.col(id_column).cast("long")
    ends = docs.agg(F.percentile_approx(key, list(batch_ends[:-1]), 1000)).first()[0] or []
    bounds = [None, *sorted(set(ends)), None]
    index, results = FingerprintIndex(docs.sparkSession, window=window), []
    try:
        for low, high in zip(bounds, bounds[1:], strict=False):
            batch = docs if low is None else docs.where(key > low)
            if high is not None:
                batch = batch.where((key <= high) | key.isNull() if low is None else key <= high)
            results.append(index.add(batch, id_column, text_column, with_text, compact=high is not None))
    finally:
        index.drop()
    return reduce(DataFrame.union, results)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
m AS (SELECT v, min(doc_id) AS lo FROM v GROUP BY v),
g AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM (SELECT doc_id, i, unnest(range(13)) AS k FROM v JOIN m USING (v) WHERE lo < doc_id) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1), list_transform(range(1, len(w) + 1), lambda x: list_contains(gone, x))), lambda z: NOT z[3]), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)"""
