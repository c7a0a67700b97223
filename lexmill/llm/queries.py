"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, collocations, langid, media, mixing, near_vectors, ngram_join, periodic, secret_scan, sharding, substring_dedup, topk, urls
from lexmill.sources.tables import read_table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(read_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_table(read_table(spark, sf_dir, "embeddings"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_table(read_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(read_table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    dictionaries = langid.learn_dictionaries(docs.where(~langid.held_out()))
    return langid.predict(docs.withColumn("held_out", langid.held_out()), dictionaries, keep=("held_out",))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_table(read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocation_table(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_secrets": op6_secrets,
    "op7_ngram_join": op7_ngram_join,
    "op8_media": op8_media,
    "op9_langid": op9_langid,
    "op10_urls": op10_urls,
    "op11_near_vectors": op11_near_vectors,
    "op12_periodic": op12_periodic,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op3_sharding": sharding.oracle_sql(),
    "op5_topk": topk.ORACLE_SQL,
    "op6_secrets": secret_scan.oracle_sql(),
    "op7_ngram_join": ngram_join.ORACLE_SQL,
    "op10_urls": urls.oracle_sql(),
    "op13_collocations": collocations.oracle_sql(),
}
