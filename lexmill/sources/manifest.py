"""Small text files that are replaced as a whole, on any file system that Spark writes to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Readers see the old text or the new one: it is written beside and moved over."""
    jvm, beside = spark._jvm, f"{path}.{uuid.uuid4().hex}.tmp"
    out = _files(spark, path).create(_path(spark, beside), True)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_files(spark, path).getUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, beside), _path(spark, path), kinds)


def text_of(spark: SparkSession, path: str) -> str | None:
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return None
    stream = files.open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    files = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(_path(spark, path))) if files.exists(_path(spark, path)) else []


def remove(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)
