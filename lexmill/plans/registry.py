"""All registered queries, and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import citation_queries, evaluation_queries, evidence_queries, extract_queries, graph_queries, identity_queries, metadata_queries, record_queries, retrieval_queries, review_queries, search_queries, source_queries, state_queries, text_queries  # noqa: F401
from lexmill.plans._registering import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_retrieval"](spark, sf_dir)
