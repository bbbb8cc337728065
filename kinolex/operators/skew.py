"""Joins on keys of which one may hold a large share of all rows.

One row in SAMPLE is counted by key. Keys that are clearly larger than a block, and larger than an even share of
1 / MOST_HOT of all rows, are hot; so there are never more than MOST_HOT of them, and their list may be broadcast. The
sample only decides how a key is spread over tasks, never which rows take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 16
MOST_HOT = 100_000


def hot_keys(rows: DataFrame, keys: list[str], by: list[str], block: int) -> DataFrame | None:
    """The hot keys with _w, the number of blocks each is worth; None without any. ``by``: columns that tell rows apart."""
    counted = rows.where(F.pmod(F.xxhash64(*by, F.lit(SAMPLE)), F.lit(SAMPLE)) == 0).groupBy(*keys).agg(F.count("*").alias("_n"))
    large = counted.where(F.col("_n") * SAMPLE > 2 * max(block, SAMPLE))
    found = large.agg(F.count("*").alias("k")).first().k
    if not found:
        return None
    if found > MOST_HOT:
        total = counted.agg(F.sum("_n").alias("n")).first().n
        large = large.where(F.col("_n") > total / MOST_HOT)
    return large.select(*keys, F.ceil(F.col("_n") * SAMPLE / F.lit(float(block))).cast("int").alias("_w"))


def pairs_in_groups(
    df: DataFrame, key: str, member: str, payload: list[str] | None = None, block: int = 2000, on: Column | None = None
) -> DataFrame:
    """All pairs (member_a < member_b) of rows that share ``key``, whatever the groups' sizes.

    A hot group is laid out as a triangle of block pairs, each a join key of its own, so that it is spread over many
    tasks; all others are one block. Null keys and null members pair with nothing; rows that are repeated give their
    pairs as often, so pass distinct ones.

    Returns key, {member}_a, {member}_b and the payload columns with the same suffixes; a pair comes once per key.
    ``on`` may restrict pairs: an expression over columns of aliases ``l`` and ``r``, symmetric in both.
    """
    payload = payload or []
    rows = df.select(key, member, *payload).where(F.col(key).isNotNull() & F.col(member).isNotNull())
    hot = hot_keys(rows, [key], [member], block)
    ordered = F.col(f"l.{member}") < F.col(f"r.{member}")
    cond = F.col(f"l.{key}") == F.col(f"r.{key}")
    left = right = rows
    if hot is not None:
        laid = rows.join(F.broadcast(hot), key, "left").withColumn("_w", F.coalesce("_w", F.lit(1)))
        home = F.pmod(F.xxhash64(member), F.col("_w")).cast("int")
        left = laid.withColumn("_i", home).withColumn("_j", F.explode(F.sequence("_i", F.col("_w") - 1)))
        right = laid.withColumn("_j", home).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j"))))
        cond = cond & (F.col("l._i") == F.col("r._i")) & (F.col("l._j") == F.col("r._j"))
        # members of different blocks meet once, in either order
        ordered = (F.col(f"l.{member}") != F.col(f"r.{member}")) & ((F.col("l._i") < F.col("l._j")) | ordered)
    cond = cond & ordered
    if on is not None:
        cond = cond & on
    j = left.alias("l").join(right.alias("r"), cond)
    flip = F.col(f"l.{member}") > F.col(f"r.{member}")
    out = [F.col(f"l.{key}").alias(key)]
    for c in [member, *payload]:
        out.append(F.when(flip, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(f"{c}_a"))
        out.append(F.when(flip, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(f"{c}_b"))
    return j.select(*out)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], other: list[str] | None = None, how: str = "inner", block: int = 200_000) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, where single keys may hold a large share of the rows.

    Rows of ``left`` with a hot key are spread over blocks by their columns ``by``, and the key's rows of ``right`` are
    repeated for each block. With ``other``, columns that tell the rows of ``right`` apart, hot keys of ``right`` are
    spread, too, so that every key becomes a grid of blocks. Null keys join nothing; ``how`` is inner, left or, without
    ``other``, left_semi.
    """
    hot_l = hot_keys(left, keys, by, block)
    hot_r = hot_keys(right, keys, other, block) if other else None
    grid = list(keys)
    for hot, fixed, place in ((hot_l, by, "_i"), (hot_r, other, "_j")):
        if hot is None:
            continue
        hot, wide = hot.withColumnRenamed("_w", "_v"), F.coalesce("_v", F.lit(1))
        at, every = F.pmod(F.xxhash64(*fixed), wide).cast("int"), F.explode(F.sequence(F.lit(0), wide - 1))
        mine, theirs = (left, right) if place == "_i" else (right, left)
        mine = mine.join(F.broadcast(hot), keys, "left").withColumn(place, at).drop("_v")
        theirs = theirs.join(F.broadcast(hot), keys, "left").withColumn(place, every).drop("_v")
        left, right = (mine, theirs) if place == "_i" else (theirs, mine)
        grid.append(place)
    if how == "left" and hot_r is not None:
        raise ValueError("a left join can't spread the rows of its right side")
    return left.join(right, grid, how).drop("_i", "_j")
