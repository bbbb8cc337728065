"""Queries on titles that look the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolex.llm.lookalike import same_look_classes, same_look_pairs, with_form
from kinolex.sources import table


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    movies = table(spark, sf_dir, "movies").select(F.lit("movies").alias("tbl"), "id", "title")
    tv = table(spark, sf_dir, "tv_corpus").select(F.lit("tv_corpus").alias("tbl"), F.col("tmdb_id").alias("id"), F.col("name").alias("title"))
    return movies.unionByName(tv)


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparable form of every title."""
    return with_form(_titles(spark, sf_dir), "title").select("tbl", "id", "title", "form").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different ids of one table whose titles look the same but are spelled differently."""
    return same_look_pairs(_titles(spark, sf_dir), "tbl", "id", "title").select("tbl", "id_a", "id_b")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title's class of equal look, and how many titles of it are spelled differently: the linear form of p5_found."""
    return same_look_classes(_titles(spark, sf_dir), "tbl", "id", "title")


QUERIES = {"p5_found": p5_found, "p5_forms": p5_forms, "p5_classes": p5_classes}
