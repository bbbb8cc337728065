"""Queries on the mixture of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolex.llm.mixing import mix
from kinolex.sources import table


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their repeats, and their source's target and actual share."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share, tokens, documents and most repeats of each source."""
    by = p8_mix(spark, sf_dir).groupBy("source", "target_share", "actual_share")
    return by.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
