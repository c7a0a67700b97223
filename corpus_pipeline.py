"""A corpus pipeline: language ID, near duplicates, secrets, mixing, token ids.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``documents``.
Null texts are rejected by language ID. Documents with a null id are never each other's duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, langid, mixing, ngram_join, secret_scan
from lexmill.llm._shared import saved
from lexmill.sources.tables import read_table

#: Words of a shingle and least Jaccard percentage of near duplicates; op7_ngram_join keeps its own contract.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language cannot be told: no letters, or a margin that is too narrow."""
    dictionaries = langid.learn_dictionaries(docs.where(~langid.held_out()))
    kept = docs.select("doc_id", "text", F.struct("*").alias("_all"))
    return langid.predict(kept, dictionaries, keep=("_all",)).where(~F.col("rejected")).select("_all.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of the smallest id stays, once; different texts of one id are documents of their own."""
    groups = ngram_join.similar_groups(docs, percent=NEAR_PERCENT, k=NEAR_SHINGLE, join_ids=False)
    stay = groups.where("kept").select("doc_id", "text_key").distinct()
    packed = docs.select("doc_id", ngram_join.text_key(F.col("text")).alias("text_key"), F.struct("*").alias("_all"))
    # Of rows equal in id and text the first by language and source.
    order = F.struct("_all.lang", "_all.source", "_all.n_chars")
    known = packed.join(stay, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.min_by("_all", order).alias("_all"))
    return known.select("_all").union(packed.where("doc_id is null").select("_all")).select("_all.*")


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by [SECRET], widely copied examples by [EXAMPLE]."""
    return secret_scan.redacted(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the rates fitted to the target domain weights say."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left."""
    return bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", remove_secrets),
    ("mixing to target weights", mix_domains),
    ("byte-level BPE encoding", encode),
]
#: Compression, logistic regression and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
