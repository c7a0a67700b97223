"""Language ID by compression: the language whose dictionary makes a text smallest.

Each language has a zstandard raw-content dictionary: letters and single spaces, in lower case, of a
bounded sample of different labelled texts, from pieces spread evenly over each. A text is brought to the same form and compressed in chunks,
whole, with every dictionary; the chunk sizes add up. The narrower the margin between the smallest
and the next, the lower the score; a margin under ``MIN_MARGIN`` rejects.

Null texts and texts without a letter are ``und`` with score 0 and are rejected. Rows without a label
are predicted but not learned from. Rows without an id are not held out. With no labelled row at all every text is ``und``. Equal texts
have equal predictions; of equally small languages the first by name is taken (margin 0). Only the
named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm._shared import forget, saved

#: The sample that dictionaries are made of: most languages, different texts of each, pieces of a text, characters of a piece.
LANGUAGES, SAMPLE_DOCS, PIECES, PIECE_CHARS = 256, 256, 8, 128
CHUNK = 4096
LEVEL = 6
MIN_MARGIN = 0.002
UNDETERMINED = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def plain_form(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text).strip().lower()


def held_out(id_column: str = "doc_id"):
    """True for the quarter of documents that nothing may be learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spread(text: Column, pieces: int, chars: int) -> Column:
    """The whole text if it is no longer than the pieces together; else pieces at even distances, the first and the last included."""
    piece = lambda i: F.substring(text, (i * (F.length(text) - chars) / (pieces - 1)).cast("int") + 1, F.lit(chars))
    return F.when(F.length(text) <= pieces * chars, text).otherwise(F.concat_ws(" ", *[piece(F.lit(i)) for i in range(pieces)]))


def learn_dictionaries(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_docs: int = SAMPLE_DOCS, pieces: int = PIECES, piece_chars: int = PIECE_CHARS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Raw dictionary content by language, from the ``sample_docs`` different texts of each whose hashes are least.

    Texts are told apart by a 64-bit hash, so copies count once however many there are. Of more than ``languages`` languages those with most
    different texts are learned (then the first by name). What reaches the driver is at most so many languages times texts times
    ``pieces`` times ``piece_chars`` characters.
    """
    known = labelled.where(F.col(lang_column).isNotNull() & (F.length(F.trim(F.col(text_column))) > 0)).select(F.col(lang_column).cast("string").alias("lang"), F.xxhash64(text_column).alias("spot"), _spread(F.col(text_column).cast("string"), pieces, piece_chars).alias("part"))
    texts = saved(known.select("lang", "spot").distinct())
    learned = [r[0] for r in texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    if not learned:
        forget(texts)
        return {}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("spot"))
    chosen = texts.where(F.col("lang").isin(learned)).withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("lang", "spot")
    # At most languages * sample_docs rows of two values.
    rows = known.join(F.broadcast(chosen), ["lang", "spot"]).groupBy("lang", "spot").agg(F.min("part").alias("part")).collect()
    forget(texts)
    found: dict[str, list[str]] = {}
    for lang, _, text in sorted(map(tuple, rows)):
        found.setdefault(lang, []).append(plain_form(text))
    return {lang: " ".join(x for x in texts if x).encode() for lang, texts in found.items() if any(texts)}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.packers = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, and margin relative to the next smallest."""
        plain = plain_form(text or "")
        if not self.langs or not _LETTER.search(plain):
            return UNDETERMINED, 0.0, 0.0
        raw = plain.encode()
        chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        sizes = [sum(len(p.compress(c)) for c in chunks) - 9 * len(chunks) for p in self.packers]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else 2 * sizes[order[0]] + 1
        margin = (second - best) / max(second, 1)
        return self.langs[order[0]], min(1.0, 0.5 + 5 * margin), margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), min_margin: float = MIN_MARGIN) -> DataFrame:
    """id, the columns of ``keep``, lang_pred, score, margin and rejected. One narrow pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            found = [classifier(t.as_py()) for t in batch.column(1)]
            lang, score, margin = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            rejected = [x == UNDETERMINED or m < min_margin for x, m in zip(lang, margin, strict=True)]
            columns = [batch.column(0), *batch.columns[2:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [id_column, *keep, "lang_pred", "score", "margin", "rejected"])

    chosen = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"), *keep)
    fields = [f"`{id_column}` {chosen.schema[0].dataType.simpleString()}", *(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keep)]
    return chosen.mapInArrow(classify, ", ".join([*fields, "lang_pred string, score double, margin double, rejected boolean"]))
