"""Queries on sentences of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinolex.llm.sentences import sentences
from kinolex.sources import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all sentences of the documents."""
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p9_found": p9_found}
