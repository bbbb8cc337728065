"""Queries on packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolex.operators.packed import split_packed
from kinolex.sources import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of movies.genres, tv_corpus.created_by and tv_corpus.networks with their positions."""

    def field(df: DataFrame, tbl: str, key: str, name: str, persons: bool) -> DataFrame:
        return df.select(
            F.lit(tbl).alias("tbl"), F.col(key).alias("item_id"), F.lit(name).alias("field"), F.lit(persons).alias("persons"), F.col(name).alias("raw")
        )

    movies, tv = table(spark, sf_dir, "movies"), table(spark, sf_dir, "tv_corpus")
    packed = (
        field(movies, "movies", "id", "genres", False)
        .unionByName(field(tv, "tv_corpus", "tmdb_id", "created_by", True))
        .unionByName(field(tv, "tv_corpus", "tmdb_id", "networks", False))
    )
    return split_packed(packed)


QUERIES = {"p6_found": p6_found}
