"""Queries of the document-intelligence operators and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import document_queries, state_queries, text_queries

MODULES = (text_queries, document_queries, state_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["lexical_retrieval"](spark, sf_dir)
