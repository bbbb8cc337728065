"""Access to the catalogue tables and the adapter views built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a directory) of the data set at ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items with a popularity: one row per part, counted over line items."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("cnt"))
    part = table(spark, sf_dir, "part")
    return part.join(sold, part.p_partkey == sold.l_partkey, "left").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("maker"),
        F.col("p_type").alias("genre"),
        (F.lit(1970) + F.col("p_size")).cast("int").alias("year"),
        F.coalesce("cnt", F.lit(0)).cast("bigint").alias("popularity"),
        F.col("p_retailprice").alias("quality"),
    )


def vec_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding", F.col("label").alias("genre")
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event per (user, k) as a rating; max_by keeps the aggregation map-side."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    stars = (
        F.when(F.col("event_type") == "purchase", 5.0)
        .when(F.col("event_type") == "click", 4.0)
        .when(F.col("event_type") == "view", 3.5)
        .when(F.col("event_type") == "signup", 3.0)
        .otherwise(1.0)
    )
    return (
        e.groupBy(F.col("user_id").alias("profile_id"), F.col("k").alias("item_id"))
        .agg(F.max_by(stars, F.struct("ts", "event_id")).cast("double").alias("rating"))
    )


def tags_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse tags: vector components of at least 0.15."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return t.where(F.col("x").cast("double") >= 0.15).select(
        F.col("vec_id").alias("item_id"),
        F.concat(F.lit("d"), F.col("pos").cast("string")).alias("tag"),
        F.round(F.col("x").cast("double"), 4).alias("score"),
    )


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("film_id"), F.col("l_linenumber").alias("ordering"), F.col("l_suppkey").alias("person_id")
    )
