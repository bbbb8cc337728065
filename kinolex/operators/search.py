"""Searches over titles and names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolex.functions import text as X
from kinolex.operators.relational import top_per_group


def contains(column, query: str):
    """Literal containment in lower case."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(query.lower()))


def popular(df: DataFrame, cond, n: int, popularity: str, key: str) -> DataFrame:
    """The n most popular rows that satisfy a condition, ties to the smaller key."""
    return df.where(cond).orderBy(F.desc(popularity), key).limit(n)


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    at: dict[str, int] = {}
    for k, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << k
    every = (1 << len(a)) - 1
    free = every
    for ch in b:
        met = free & at.get(ch, 0)
        free = (free + met | free - met) & every
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of letters in order in common, 0 to 1; two empty strings are equal."""
    return 2 * common_letters(a, b) / (len(a) + len(b)) if a or b else 1.0


def best_part(a: str, b: str) -> float:
    """Best ratio of the shorter string with a part of the longer one of at most its length."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0
    n = len(a)
    return max(ratio(a, b[max(0, k) : k + n]) for k in range(1 - n, len(b)))


def weighted_ratio(a: str, b: str) -> float:
    """0 to 1: the best of comparing as written, with words sorted, and by sets of words; parts count where lengths differ much."""
    if not a or not b:
        return 0.0
    x, y = a.split(), b.split()
    both = sorted(set(x) & set(y))
    own = [" ".join([*both, *sorted(set(w) - set(both))]) for w in (x, y)]
    core = " ".join(both)
    pairs = [(core, own[0]), (core, own[1]), (own[0], own[1])] if both else [(own[0], own[1])]
    in_order, span = (" ".join(sorted(x)), " ".join(sorted(y))), max(len(a), len(b)) / min(len(a), len(b))
    if span < 1.5:
        return max(ratio(a, b), 0.95 * ratio(*in_order), 0.95 * max(ratio(*p) for p in pairs))
    scale = 0.9 if span < 8 else 0.6
    words = 1.0 if both else best_part(*pairs[0])
    return max(ratio(a, b), scale * best_part(a, b), 0.95 * scale * max(best_part(*in_order), words))


def ratios(pairs: DataFrame, a: str, b: str, out: str = "score", by=ratio) -> DataFrame:
    """Adds a similarity of two string columns, by Arrow batches; equal pairs of strings are scored once per batch."""
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + f", {out} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = {k: by(k[0] or "", k[1] or "") for k in set(zip(pdf[a], pdf[b]))}
            yield pdf.assign(**{out: [done[k] for k in zip(pdf[a], pdf[b])]})

    return pairs.mapInPandas(run, schema)


MOST_QUERIES = 10_000


def few(queries: DataFrame) -> DataFrame:
    """A table that a user's queries may be broadcast from: more than MOST_QUERIES are refused."""
    n = queries.limit(MOST_QUERIES + 1).count()
    if n > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries at a time")
    return F.broadcast(queries)


def tiered(catalogue: DataFrame, queries: DataFrame, key: str, title: str, popularity: str, n: int, fuzzy: bool = False, least: float = 0.7) -> DataFrame:
    """(query, tier, key, rk): tier 1 titles that contain the query, 2 titles with all its words, 3 similar titles.

    Only the first tier with results counts. queries: query string, at most MOST_QUERIES rows; shorter ones than two
    characters find nothing. Case, accents and hyphens make no difference. Tier 3 (``fuzzy``) compares the queries
    without a result with every distinct title of the catalogue.
    """
    q = few(queries.select("query", X.search_form(F.col("query")).alias("q")).where(F.length("q") >= 2).distinct())
    c = catalogue.select(F.col(key).alias("key"), X.search_form(F.coalesce(F.col(title), F.lit(""))).alias("t"), F.col(popularity).alias("pop"))
    words = F.split("q", " ")
    tier = F.when(F.contains("t", F.col("q")), 1).when(F.forall(words, lambda w: F.contains(F.col("t"), w)), 2)
    hits = c.join(q).withColumn("tier", tier).where("tier is not null").select("query", "tier", "key", (-F.col("pop").cast("double")).alias("order"))
    if fuzzy:
        left = few(q.join(hits.select("query").distinct(), "query", "left_anti"))
        near = ratios(c.select("t").distinct().join(left).select("query", "q", "t"), "q", "t").where(F.col("score") >= least)
        near = c.join(near, "t").select("query", F.lit(3).alias("tier"), "key", (-F.round("score", 9)).alias("order"))
        hits = hits.unionByName(near)
    first = hits.groupBy("query").agg(F.min("tier").alias("tier"))
    return top_per_group(hits.join(first, ["query", "tier"]), ["query"], ["order", "key"], n).select("query", "tier", F.col("key").alias(key), "rk")


def matched(wanted: DataFrame, catalogue: DataFrame, key: str, title: str, author: str, least_title: float = 0.8, least_author: float = 0.7) -> DataFrame:
    """(query, by, key, title_score, author_score): the record most like each wanted title and author.

    wanted: query, by (author or null), at most MOST_QUERIES rows, compared with every distinct title and author. The
    title must reach least_title, the author, where one is wanted, least_author. Ties: better author, then smaller key.
    """
    form = lambda c: X.search_form(F.coalesce(F.col(c), F.lit("")))
    w = few(wanted.select("query", "by", form("query").alias("q"), form("by").alias("b")).distinct())
    c = catalogue.where(F.col(key).isNotNull()).groupBy(form(title).alias("t"), form(author).alias("a")).agg(F.min(key).alias("key")).where("t <> ''")
    near = ratios(c.join(w), "q", "t", "title_score", weighted_ratio).where(F.col("title_score") >= least_title)
    near = ratios(near, "b", "a", "author_score", weighted_ratio).where((F.col("b") == "") | (F.col("author_score") >= least_author))
    best = top_per_group(near, ["query", "by"], [F.desc("title_score"), F.desc("author_score"), "key"], 1)
    return best.select("query", "by", F.col("key").alias(key), F.round("title_score", 6).alias("title_score"), F.round("author_score", 6).alias("author_score"))
