"""Full-text search over a written positional index: terms, phrases, prefixes, OR and NOT, ranked by BM25.

The index is four Parquet tables in one folder:

* ``postings`` (term, w, items, tfs, positions), in folders by ``range`` and in order of term inside: a term's items in a range, as places in its list of
  items, how often each holds the term and, one after the other, where. A range holds items of like length, about ``RANGE_ITEMS`` of them and
  ``RANGE_WORDS`` words; w is the term's greatest BM25 weight there, without its idf.
* ``blocks`` (term, range, n, top, df): how many items of a range hold a term, the greatest w, and how many items of all ranges hold it.
* ``ranges`` (range, items): items and their lengths.
* ``totals``: items and their mean length.

A search first reads the blocks of its terms: for each query and range the most that an item there could score.
The best range of each query is read; the k-th best score found is a bar that all other ranges must be able
to reach. Only those are read then, the rest not even opened. As items of a range are of like length, bounds are close.

The terms that a prefix begins may be most of the vocabulary. They are never listed: in a range they lie side by side, and their idf comes with the range.

Scores: a term gives idf * w; a prefix gives that of every term it begins; a phrase gives the sum of its terms' idf, weighted by how often the
phrase occurs. Each part of a query counts once, parts of any alternative count for every match. Negated parts only exclude.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.stemming import stem
from lexmill.operators.retrieval import top_per
from lexmill.sources.shared import saved

K1, B = 1.2, 0.75
RANGE_ITEMS = 1 << 16
RANGE_WORDS = 1 << 21
#: Classes of length.
CLASSES = 64
#: Distinct terms up to which a scan gets them as a filter.
PUSHED = 1000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PART = regex.compile(r'(NOT\s+|-)?(?:"([^"]*)"|(\S+))')


def analysed(text: str | None, stemmed: bool) -> list[str]:
    """Runs of letters and digits, in lower case and without accents, stemmed on request."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        for mark in filter(unicodedata.combining, set(text)):
            text = text.replace(mark, "")
    words = _WORD.findall(text)
    if stemmed:
        stems = {w: stem(w) for w in set(words)}
        words = [stems[w] for w in words]
    return words


def alternatives(expression: str | None, stemmed: bool) -> list[list[tuple[bool, str, list[str]]]]:
    """The alternatives (between OR) of an expression, each a list of parts (negated, kind, terms): word, "a phrase", prefix*, NOT part.

    A word that the analyser splits is a phrase; prefixes are not stemmed. Alternatives without a positive part match nothing and are left out.
    """
    out = []
    for one in regex.split(r"\s+OR\s+", expression or ""):
        parts = []
        for no, phrase, word in _PART.findall(one):
            prefix = word.endswith("*")
            terms = analysed(phrase or word, stemmed and not prefix)
            if prefix and len(terms) == 1:
                parts.append((bool(no), "prefix", terms))
            elif terms:
                parts.append((bool(no), "term" if len(terms) == 1 else "phrase", terms))
        if any(not no for no, _, _ in parts):
            out.append(parts)
    return out


def _words(stemmed: bool):
    """(item, len, words) of rows (item, text): how many words, and these joined by spaces."""

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [analysed(text.as_py(), stemmed) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, every), pa.int32()), pa.array(map(" ".join, every), pa.string())], ["item", "len", "words"])

    return analyse


def weight(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _postings(mean: float):
    """The postings of the rows (item, len, words) of a range."""

    def listed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("item", "ascending"), ("len", "ascending")])
        length = rows.column("len").to_numpy()
        coded = pc.list_flatten(pc.split_pattern(rows.column("words").combine_chunks(), " ")).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        word = rank[coded.indices.to_numpy()]
        by = np.argsort(word, kind="stable")
        word, place = word[by], np.repeat(np.arange(len(length), dtype=np.int32), length)[by]
        spot = (np.arange(len(by)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)[by]
        # First words of every posting, first postings of every term.
        new = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
        first = np.flatnonzero(np.diff(word[new], prepend=-1) != 0)
        tf, place = np.diff(np.append(new, len(by))).astype(np.int32), place[new]
        ends, spots = np.append(first, len(new)).astype(np.int32), np.append(new[first], len(by)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(at, of) for at, of in ((ends, place), (ends, tf), (spots, spot))]
        number = pa.array(np.full(len(first), key[0].as_py(), np.int32))
        return pa.table([number, coded.dictionary.take(order), np.maximum.reduceat(weight(tf, length[place], mean), first), *lists], ["range", "term", "w", "items", "tfs", "positions"])

    return listed


def build_index(docs: DataFrame, path: str, key: str, text: Column, stemmed: bool = True, range_items: int = RANGE_ITEMS, classes: int = CLASSES) -> TextIndex:
    """Writes the index of the texts; rows without an id or without a word are not in it. Ids are expected to be unique."""
    rows = docs.select(F.col(key).alias("item"), text.cast("string").alias("text")).where("item IS NOT NULL")
    kind = rows.schema["item"].dataType.simpleString()
    items = saved(rows.mapInArrow(_words(stemmed), f"item {kind}, len int, words string").where("len > 0"))
    total, mean, cuts = items.agg(F.count("*"), F.avg("len"), F.percentile_approx("len", [i / classes for i in range(1, classes)], 10_000)).first()
    mean = float(mean or 1)
    place = F.lit(0)
    for cut in sorted(set(cuts or [])):
        place = place + (F.col("len") > cut).cast("int")
    # Equal lengths are one class, however many; a class has as many ranges as its items and words need.
    counts = sorted(map(tuple, items.groupBy(place.alias("c")).agg(F.count("*"), F.sum("len")).collect()))
    first, parts, at = {}, {}, 0
    for number, count, words in counts:
        first[number], parts[number] = at, max(math.ceil(count / range_items), math.ceil(words / RANGE_WORDS))
        at += parts[number]
    known = lambda of: F.element_at(F.create_map(*[F.lit(x) for pair in (of or {0: 1}).items() for x in pair]), place)
    numbered = items.withColumn("range", known(first) + F.pmod(F.xxhash64("item"), known(parts)).cast("int"))
    # Items are dealt out whole and taken apart where their range is written.
    made = numbered.groupBy("range").applyInArrow(_postings(mean), "range int, term string, w double, items array<int>, tfs array<int>, positions array<int>")
    made.write.partitionBy("range").parquet(f"{path}/postings")
    numbered.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("item", "len"))).alias("items")).write.parquet(f"{path}/ranges")
    index = TextIndex(docs.sparkSession, path, stemmed, kind)
    if at:
        held = index.postings().select("term", "range", F.size("items").cast("long").alias("n"), F.col("w").alias("top"))
        held.withColumn("df", F.sum("n").over(Window.partitionBy("term"))).write.parquet(f"{path}/blocks")
    else:
        docs.sparkSession.createDataFrame([], "term string, range int, n long, top double, df long").write.parquet(f"{path}/blocks")
    docs.sparkSession.createDataFrame([(total, mean)], "items long, mean double").write.parquet(f"{path}/totals")
    return index


class TextIndex:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool, item_kind: str):
        self.spark, self.path, self.stemmed, self.item_kind = spark, path, stemmed, item_kind

    def postings(self) -> DataFrame:
        return self.spark.read.schema("term string, w double, items array<int>, tfs array<int>, positions array<int>, range int").parquet(f"{self.path}/postings")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("term string, range int, n long, top double, df long").parquet(f"{self.path}/blocks")

    def ranges(self) -> DataFrame:
        return self.spark.read.schema(f"range int, items array<struct<item:{self.item_kind},len:int>>").parquet(f"{self.path}/ranges")

    def totals(self) -> DataFrame:
        return self.spark.read.schema("items long, mean double").parquet(f"{self.path}/totals")


def query_parts(queries: DataFrame, stemmed: bool) -> DataFrame:
    """(query, alternative, negated, part, kind, terms) of rows (query, expression); equal parts of a query have equal names."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query, expression in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number, parts in enumerate(alternatives(expression, stemmed)):
                    rows += [(query, number, no, f"{kind} {' '.join(terms)}", kind, terms) for no, kind, terms in parts]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query", "alternative", "negated", "part", "kind", "terms"])

    kind = queries.schema["query"].dataType.simpleString()
    return queries.select("query", "expression").mapInArrow(split, f"query {kind}, alternative int, negated boolean, part string, kind string, terms array<string>")


def _needs(parts: DataFrame) -> DataFrame:
    """(part, kind, size, offset, length, key): the terms of a part, at their offsets, of length 0; or the letters that its terms begin with, and how many."""
    once = parts.select("part", "kind", "terms").distinct()
    plain = once.where("kind <> 'prefix'").select("part", "kind", F.size("terms").alias("size"), F.lit(0).alias("length"), F.posexplode("terms").alias("offset", "key"))
    begins = once.where("kind = 'prefix'").select("part", "kind", F.lit(1).alias("size"), F.get("terms", F.lit(0)).alias("key"))
    return plain.unionByName(begins.withColumn("length", F.length("key")).withColumn("offset", F.lit(0)))


def _key(length: int) -> Column:
    return F.substring("term", 1, length) if length else F.col("term")


def _wanted(rows: DataFrame, needs: DataFrame, lengths: list[int]) -> DataFrame:
    """The rows whose term is needed. The needs are those of the stated queries, and broadcast."""
    wanted = F.lit(False)
    for length in lengths:
        own = needs.where(F.col("length") == length).select(F.col("key").alias(f"_{length}")).distinct()
        rows = rows.join(F.broadcast(own), _key(length) == F.col(f"_{length}"), "left")
        wanted = wanted | F.col(f"_{length}").isNotNull()
    return rows.where(wanted).drop(*[f"_{length}" for length in lengths])


def _bounds(parts: DataFrame, needs: DataFrame, lengths: list[int], blocks: DataFrame) -> DataFrame:
    """(query, range, bound): the most that an item of the range could score, for ranges that hold all positive parts of some alternative."""
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), _key(n).alias("key")) for n in lengths]))
    here = blocks.select("range", "top", "idf", keys.alias("k")).select("range", "top", "idf", "k.*").join(F.broadcast(needs), ["length", "key"])
    best = here.groupBy("part", "range").agg(
        F.first("kind").alias("kind"), F.first("size").alias("size"), F.count("*").alias("found"),
        F.sum(F.col("idf") * F.col("top")).alias("each"), F.sum("idf").alias("idf"), F.min("top").alias("least"),
    )
    there = saved(best.where("kind <> 'phrase' OR found = size").select("part", "range", F.when(F.col("kind") == "phrase", F.col("idf") * F.col("least")).otherwise(F.col("each")).alias("most")))
    positive = parts.where("NOT negated").select("query", "alternative", "part").distinct()
    asked = positive.groupBy("query", "alternative").agg(F.count("*").alias("asked"))
    possible = positive.join(there, "part").groupBy("query", "alternative", "range").agg(F.count("*").alias("got")).join(asked, ["query", "alternative"]).where("got = asked").select("query", "range").distinct()
    return positive.select("query", "part").distinct().join(there, "part").join(possible, ["query", "range"]).groupBy("query", "range").agg(F.sum("most").alias("bound"))


def _scored(index: TextIndex, parts: DataFrame, needs: DataFrame, lengths: list[int], blocks: DataFrame, cells: DataFrame, mean: float, k: int, digits: int) -> DataFrame:
    """(query, item, score) of the k best items of each range that match, in the cells (query, range).

    The postings of a range meet its queries in one task: every posting is moved once, however many queries want it. A range has about RANGE_ITEMS items
    and RANGE_WORDS words.
    """
    # Numbers of ranges: a few bytes each, one for RANGE_ITEMS items.
    ranges = [r[0] for r in cells.select("range").distinct().collect()]
    # The stated queries: what each alternative asks for, and the terms of each part.
    asked = defaultdict(lambda: defaultdict(list))
    for r in parts.select("query", "alternative", "negated", "part").distinct().collect():
        asked[r.query][r.alternative].append((r.negated, r.part))
    own = defaultdict(list)
    for r in needs.orderBy("part", "offset").collect():
        own[r.part].append((r.kind, r.key))
    plan = index.spark.sparkContext.broadcast(({q: dict(a) for q, a in asked.items()}, dict(own)))
    read = index.postings().where(F.col("range").isin(ranges))
    names = {key for every in own.values() for _, key in every}
    read = read.where(F.col("term").isin(list(names))) if lengths == [0] and len(names) <= PUSHED else _wanted(read, needs, lengths)
    # Only phrases need the positions. What a row lacks is an empty list: Spark's writer of Arrow batches goes over a run of null lists again at each row.
    none = F.array()
    placed = needs.where("kind = 'phrase'").select(F.col("key").alias("term"), F.lit(True).alias("placed")).distinct()
    read = read.join(F.broadcast(placed), "term", "left").select("range", "term", "items", "tfs", F.when(F.col("placed"), F.col("positions")).otherwise(none.cast("array<int>")).alias("positions"))
    here = index.ranges().join(cells.groupBy("range").agg(F.collect_set("query").alias("queries")), "range")
    kinds = here.schema
    idf = _wanted(blocks.where(F.col("range").isin(ranges)), needs, lengths).select("range", "term", "idf", *[none.cast(kinds[c].dataType).alias(c) for c in ("items", "queries")])
    here = here.unionByName(idf, allowMissingColumns=True)
    query_kind = cells.schema["query"].dataType

    def meet(key: tuple, postings: pa.Table, own: pa.Table) -> pa.Table:
        range_ = own.filter(pc.is_null(own.column("term"))).combine_chunks()
        found: list = [[], pa.array([], own.schema.field("items").type.value_type.field("item").type), []]
        if range_.num_rows and postings.num_rows:
            found = _best_of_range(postings, own.filter(pc.is_valid(own.column("term"))), range_, *plan.value, mean, k, digits)
        return pa.table([pa.array(found[0], own.schema.field("queries").type.value_type), found[1], pa.array(found[2], pa.float64())], ["query", "item", "score"])

    both = read.groupBy("range").cogroup(here.groupBy("range"))
    scored = both.applyInArrow(meet, f"query {query_kind.simpleString()}, item {index.item_kind}, score double")
    return scored.withColumn("score", F.round("score", digits))


def _best_of_range(postings: pa.Table, weights: pa.Table, range_: pa.Table, asked: dict, needs: dict, mean: float, k: int, digits: int) -> list:
    """Queries, items and scores of the k best matches of each query among the postings of one range."""
    items = range_.column("items").chunk(0).flatten()
    count, length = len(items), items.field("len").to_numpy()
    postings = postings.sort_by("term").combine_chunks()
    names = postings.column("term").to_pylist()
    idf = weights.column("idf").to_numpy()[pc.index_in(postings.column("term"), weights.column("term").combine_chunks()).to_numpy()]
    lists = postings.column("items").chunk(0)
    ends, place, tfs = lists.offsets.to_numpy(), lists.values.to_numpy(), postings.column("tfs").chunk(0).values.to_numpy()
    each = weight(tfs, length[place], mean) * np.repeat(idf, np.diff(ends))
    # Places in the range: item and position in one number.
    stride = int(length.max()) + 1

    def of(begin: str, end: str) -> tuple[int, int]:
        return bisect_left(names, begin), bisect_left(names, end)

    def spots(at: int, offset: int) -> np.ndarray:
        span = slice(ends[at], ends[at + 1])
        where = postings.column("positions")[at].values.to_numpy().astype(np.int64) - offset
        return (np.repeat(place[span].astype(np.int64), tfs[span]) * stride + where)[where >= 0]

    def score(part: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all items, and which of them hold the part."""
        total, held, own = np.zeros(count), np.zeros(count, bool), needs[part]
        if own[0][0] == "phrase":
            at = [of(key, f"{key}\0") for _, key in own]
            if all(b < e for b, e in at):
                starts = None
                for offset, (b, _) in enumerate(at):
                    here = spots(b, offset)
                    starts = here if starts is None else np.intersect1d(starts, here, assume_unique=True)
                tf = np.bincount(starts // stride, minlength=count)
                held = tf > 0
                total = np.where(held, sum(idf[b] for b, _ in at) * weight(tf, length, mean), 0.0)
        else:
            (kind, key) = own[0]
            b, e = of(key, f"{key}\U0010ffff" if kind == "prefix" else f"{key}\0")
            span = slice(ends[b], ends[e])
            total = np.bincount(place[span], weights=each[span], minlength=count)
            held[place[span]] = True
        return total, held

    queries: list = []
    chosen: list = []
    scores: list = []
    for query in range_.column("queries")[0].as_py():
        found = {part: score(part) for part in sorted({p for own in asked[query].values() for _, p in own})}
        match, total = np.zeros(count, bool), np.zeros(count)
        for own in asked[query].values():
            yes, no = [p for negated, p in own if not negated], [p for negated, p in own if negated]
            match |= np.logical_and.reduce([found[p][1] for p in yes]) & ~np.logical_or.reduce([np.zeros(count, bool), *[found[p][1] for p in no]])
        if not match.any():
            continue
        for part in sorted({p for own in asked[query].values() for negated, p in own if not negated}):
            total += found[part][0]
        hits = np.flatnonzero(match)
        # Items stand in their order, so a stable sort leaves ties to the smaller one.
        best = hits[np.argsort(-np.round(total[hits], digits), kind="stable")[:k]]
        queries.extend([query] * len(best))
        chosen.extend(best.tolist())
        scores.extend(total[best].tolist())
    return [queries, items.field("item").take(pa.array(chosen, pa.int64())), scores]


def search(index: TextIndex, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query, item, rank, score): the k best matches of every row (query, expression) by rounded score; equal ones in order of item. Six digits at least."""
    items, mean = index.totals().first()
    parts = saved(query_parts(queries, index.stemmed))
    needs = saved(_needs(parts))
    # How many letters prefixes have: a few numbers.
    lengths = sorted(r[0] for r in needs.select("length").distinct().collect()) or [0]
    blocks = index.blocks().withColumn("idf", F.log1p((F.lit(items) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    cells = saved(_bounds(parts, needs, lengths, blocks))
    scored = lambda of: _scored(index, parts, needs, lengths, blocks, of, mean, k, digits)
    order = [F.desc("score"), F.asc("item")]
    first = saved(top_per(cells, ["query"], [F.desc("bound"), F.asc("range")], 1).select("query", "range"))
    found = saved(top_per(scored(first), ["query"], order, k))
    # Bars and bounds are rounded apart: what could only tie is read.
    bars = found.where(F.col("rank") == k).select("query", (F.col("score") - 1e-6).alias("bar"))
    more = saved(cells.join(first, ["query", "range"], "left_anti").join(bars, "query", "left").where("bar IS NULL OR bound >= bar").select("query", "range"))
    return top_per(found.select("query", "item", "score").union(scored(more).select("query", "item", "score")), ["query"], order, k).select("query", "item", "rank", "score")
