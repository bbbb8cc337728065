"""Filters, duplicates, merges and per-group tops with explicit order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiers(df: DataFrame, votes: Column, major: Column, floors: tuple[int, int, int, int], text: Column, least: int, extra: Column, rich: int) -> DataFrame:
    """Adds tier: 'clean' from the upper floor on, 'probation' from the lower one on if the record is complete.

    floors: (clean, probation) for the major language, then for the others. Shorter texts than ``least`` drop out.
    """
    v = F.coalesce(votes, F.lit(0))
    high, low = F.when(major, floors[0]).otherwise(floors[2]), F.when(major, floors[1]).otherwise(floors[3])
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    tier = F.when(v >= high, "clean").when((v >= low) & (n >= rich) & extra, "probation")
    return df.where(n >= least).withColumn("tier", tier).where(F.col("tier").isNotNull())


def top_per_group(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rk") -> DataFrame:
    """First n rows of each group with their rank; the window is limited before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def keep_one(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row per key, the first in a total order."""
    return top_per_group(df, by, order, 1, "_rk").drop("_rk")


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert by group: all old rows of the keys that come anew are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by row: the new row wins. Doing it again changes nothing."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    rest = [F.max_by(c, "_seq").alias(c) for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(*rest)


def argmax_edition(df: DataFrame, work: str, popularity: str, tie: str) -> DataFrame:
    """Most popular record of each work; records without a work all stay."""
    named = F.length(F.trim(F.coalesce(F.col(work), F.lit("")))) > 0
    return keep_one(df.where(named), [work], [F.desc(popularity), tie]).unionByName(df.where(~named))


def in_range(df: DataFrame, **bounds) -> DataFrame:
    """Optional bounds (low, high) by column; a null value fails a bound that is given."""
    conds = []
    for c, (low, high) in bounds.items():
        if low is not None:
            conds.append(F.col(c) >= low)
        if high is not None:
            conds.append(F.col(c) <= high)
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def percent_rank_average(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """Average rank of equal values over the number of rows, from counts by value: no window over all rows.

    Running counts are taken over distinct values within ranges of values, and over the ranges' totals.
    """
    spark = df.sparkSession
    by_value = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = by_value.repartitionByRange(parts, value).withColumn("_p", F.spark_partition_id())
    total = ranged.groupBy("_p").agg(F.sum("_n").alias("_t"))  # at most one row per partition
    before = total.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy()).alias("_all"))
    run = ranged.withColumn("_run", F.sum("_n").over(Window.partitionBy("_p").orderBy(value)))
    run = run.join(F.broadcast(before), "_p")
    pct = (F.col("_before") + F.col("_run") - (F.col("_n") - 1) / 2.0) / F.col("_all")
    return df.join(run.select(value, pct.alias(out)), value)
