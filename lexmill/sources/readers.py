"""Sources: files of texts, archives of points, typed CSV, loose JSON, databases."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lexmill.sources.sinks import digest

ENCODINGS = ("utf-8-sig", "utf-16", "cp1252", "latin-1")
FORMS = ("ISO date", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def decode_bytes(raw: bytes | None) -> str | None:
    """UTF-8, else UTF-16 with a mark, else a single-byte encoding; the last never fails."""
    if raw is None:
        return None
    for name in ENCODINGS:
        if name == "utf-16" and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(decode_bytes)


def text_files(spark: SparkSession, path: str, page_chars: int = 4000, glob: str = "*.{txt,md}") -> DataFrame:
    """(path, page, text, error): whole files, decoded, in pages at form feeds or after so many characters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return paged(files.select("path", decoded("content").alias("text")), page_chars)


def paged(texts: DataFrame, page_chars: int = 4000) -> DataFrame:
    """(path, sheet, part, text, error) of rows (path, text)."""
    pages = texts.select("path", F.posexplode(F.split("text", "\f")).alias("sheet", "text"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / page_chars)).cast("int")), lambda i: i)
    cut = pages.select("path", "sheet", F.explode(pieces).alias("part"), "text").withColumn("text", F.expr(f"substring(text, part * {page_chars} + 1, {page_chars})"))
    return cut.select("path", "sheet", "part", "text", F.when(F.trim("text") == "", "empty page").alias("error"))


def point_archive(spark: SparkSession, path: str) -> DataFrame:
    """Points of an archive that save_archive wrote; raises if count or digest do not hold."""
    said = spark.read.schema("count long, sha256 string, schema string").json(f"{path}/manifest").first()
    points = spark.read.schema(StructType.fromJson(json.loads(said["schema"]))).json(f"{path}/points")
    found = digest(points).first()
    if (said["count"], said["sha256"]) != (found["count"], found["sha256"]):
        raise ValueError(f"the archive states {said['count']} points and holds {found['count']}, or its digest differs")
    return points


def typed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV by declared types: '' and 'None' are null, flags are true for true, 1, yes; what does not parse is null."""
    raw = spark.read.option("header", True).csv(path)

    def cell(field):
        c = F.when(~F.trim(F.col(field.name)).isin("", "None"), F.trim(F.col(field.name)))
        kind = field.dataType.simpleString()
        if kind == "boolean":
            return F.when(c.isNotNull(), F.lower(c).isin("true", "1", "yes")).alias(field.name)
        if kind in ("timestamp", "date"):
            return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMS[1:]]).cast(kind).alias(field.name)
        return c.try_cast(kind).alias(field.name)

    return raw.select(*[cell(f) for f in schema.fields])


def loose_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """JSON whose keys may lack quotes; with lines, one value a line, so large files are read in parts."""
    reader = spark.read.option("multiLine", not lines).option("allowUnquotedFieldNames", True).option("allowSingleQuotes", True)
    return (reader.schema(schema) if schema else reader).json(path)


def database_table(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table over JDBC, split by a numeric key into so many reads."""
    options = {"url": url, "dbtable": table}
    if key:
        options |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()
