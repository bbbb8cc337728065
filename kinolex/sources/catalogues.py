"""Films, series and books in one form, with their vectors and their ratings.

A catalogue has item_id (text), title, makers (director, creators or author), people, studio, genres, work, year, lang,
popularity; of several deliveries of an item the most popular, then the latest counts. Missing texts are empty, missing
lists empty, a book without a work number has no work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolex.functions import text as X
from kinolex.sources.tables import ratings, table

DIM = 128
MEDIA = ("film", "series", "book")


def _words(c: Column) -> Column:
    """Distinct small-letter elements of a packed list: brackets and quotes dropped, divided at , ; and |."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]'\"]", ""), "[,;|]")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.lower(F.trim(x))), lambda x: ~x.isin("", "nan")))


def _one(c: Column) -> Column:
    t = F.lower(X.cleaned(c))
    return F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def catalogue(s: SparkSession, d: str, medium: str) -> DataFrame:
    none, empty = F.array().cast("array<string>"), F.lit("")
    if medium == "film":
        t = table(s, d, "movies").select(
            F.col("id").cast("string").alias("item_id"), F.coalesce("vote_count", F.lit(0)).cast("bigint").alias("popularity"), "loaded_at", F.coalesce("title", empty).alias("title"),
            _one(F.col("director")).alias("makers"), F.coalesce("cast_names", none).alias("people"), F.coalesce("studio", empty).alias("studio"), _words(F.col("genres")).alias("genres"),
            F.lit(None).cast("string").alias("work"), F.col("release_year").alias("year"), F.lower("original_language").alias("lang"),
        )
    elif medium == "series":
        t = table(s, d, "tv_corpus").select(
            F.col("tmdb_id").cast("string").alias("item_id"), F.coalesce("vote_count", F.lit(0)).cast("bigint").alias("popularity"), "loaded_at", F.coalesce("name", empty).alias("title"),
            _words(F.col("created_by")).alias("makers"), none.alias("people"), F.coalesce("networks", empty).alias("studio"), _words(F.col("genres")).alias("genres"),
            F.lit(None).cast("string").alias("work"), F.col("start_year").alias("year"), F.lower("original_language").alias("lang"),
        )
    elif medium == "book":
        genres = F.array_distinct(F.filter(F.transform(F.coalesce("genres", none), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
        work = F.regexp_extract(F.trim(F.coalesce("work_id", empty)), r"^0*([1-9][0-9]*)(?:\.0*)?$", 1)
        t = table(s, d, "books_v1").select(
            F.col("book_id").alias("item_id"), F.greatest(F.coalesce("ratings_count", F.lit(0)), F.lit(0)).cast("bigint").alias("popularity"), "loaded_at", F.coalesce("title", empty).alias("title"),
            _one(F.col("primary_author")).alias("makers"), none.alias("people"), empty.alias("studio"), genres.alias("genres"),
            F.when(work != "", work).alias("work"), F.col("publication_year").alias("year"), F.lower(F.substring("language_code", 1, 2)).alias("lang"),
        )
    else:
        raise ValueError(f"medium is one of {MEDIA}")
    rest = [c for c in t.columns if c not in ("item_id", "popularity", "loaded_at", "title")]
    best = F.max(F.struct("popularity", "loaded_at", "title", *rest)).alias("b")
    return t.where("item_id is not null").groupBy("item_id").agg(best).select("item_id", "b.title", "b.popularity", *[F.col(f"b.{c}") for c in rest])


def unit_vectors(s: SparkSession, d: str, medium: str) -> DataFrame:
    """(item_id, vec_id, v): a vector of unit length of each item that has a valid one; of several the smallest vec_id's."""
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = (F.size(e) == DIM) & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0)
    t = table(s, d, "item_vectors").where((F.col("medium") == medium) & F.col("vec_id").isNotNull() & F.col("item_key").isNotNull() & e.isNotNull()).where(ok)
    t = t.groupBy(F.col("item_key").alias("item_id")).agg(F.min(F.struct("vec_id", "embedding")).alias("b")).select("item_id", "b.vec_id", F.transform("b.embedding", lambda x: x.cast("double")).alias("w"))
    t = t.withColumn("n", F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x)))
    return t.select("item_id", "vec_id", F.transform("w", lambda x: x / F.col("n")).alias("v"))


def rated(s: SparkSession, d: str, medium: str, some: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
    """(profile_id, item_id, rating): the latest rating of each profile and item; books and series by the events on their vec_id.

    some: which films' rows to keep (by movie_id), before the latest are found.
    """
    if medium == "film":
        t = table(s, d, "ratings").where(F.col("user_id").isNotNull() & F.col("movie_id").isNotNull() & F.col("rating").isNotNull() & ~F.isnan("rating"))
        t = some(t.select("user_id", "movie_id", "rating", "rated_at", "loaded_at"))
        return t.groupBy(F.col("user_id").alias("profile_id"), F.col("movie_id").cast("string").alias("item_id")).agg(F.max_by("rating", F.struct("rated_at", "loaded_at", "rating")).alias("rating"))
    names = unit_vectors(s, d, medium).select(F.col("vec_id").alias("k"), "item_id")
    return ratings(s, d).withColumnRenamed("item_id", "k").join(names, "k").select("profile_id", "item_id", "rating")


# The same in DuckDB's SQL: views cat, vec and prof of one medium.
_SQL_ONE = "CASE WHEN lower(trim(coalesce({0}, ''))) IN ('', 'nan') THEN [] ELSE [lower(trim({0}))] END"
_SQL_DISTINCT = "list_filter({0}, lambda x, i: x <> '' AND x <> 'nan' AND list_position({0}, x) = i)"


def _sql_words(c: str) -> str:
    return _SQL_DISTINCT.format(f"list_transform(string_split_regex(regexp_replace(coalesce({c}, ''), '[\\[\\]''\"]', '', 'g'), '[,;|]'), lambda y: lower(trim(y)))")


_SQL_ROWS = {
    "film": f"""SELECT CAST(id AS VARCHAR) AS item_id, CAST(coalesce(vote_count, 0) AS BIGINT) AS popularity, loaded_at, coalesce(title, '') AS title, {_SQL_ONE.format('director')} AS makers, coalesce(cast_names, []) AS people,
    coalesce(studio, '') AS studio, {_sql_words('genres')} AS genres, CAST(NULL AS VARCHAR) AS work, release_year AS year, lower(original_language) AS lang FROM movies""",
    "series": f"""SELECT CAST(tmdb_id AS VARCHAR) AS item_id, CAST(coalesce(vote_count, 0) AS BIGINT) AS popularity, loaded_at, coalesce(name, '') AS title, {_sql_words('created_by')} AS makers, CAST([] AS VARCHAR[]) AS people,
    coalesce(networks, '') AS studio, {_sql_words('genres')} AS genres, CAST(NULL AS VARCHAR) AS work, start_year AS year, lower(original_language) AS lang FROM tv_corpus""",
    "book": f"""SELECT book_id AS item_id, CAST(greatest(coalesce(ratings_count, 0), 0) AS BIGINT) AS popularity, loaded_at, coalesce(title, '') AS title, {_SQL_ONE.format('primary_author')} AS makers, CAST([] AS VARCHAR[]) AS people,
    '' AS studio, {_SQL_DISTINCT.format("list_transform(coalesce(genres, []), lambda y: lower(trim(y)))")} AS genres, nullif(regexp_extract(trim(coalesce(work_id, '')), '^0*([1-9][0-9]*)(?:\\.0*)?$', 1), '') AS work,
    publication_year AS year, lower(substr(language_code, 1, 2)) AS lang FROM books_v1""",
}


def sql_views(medium: str) -> str:
    cat = f"""cat AS (SELECT * FROM ({_SQL_ROWS[medium]}) WHERE item_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY popularity DESC, loaded_at DESC NULLS LAST, title DESC, makers DESC, people DESC, studio DESC, genres DESC, work DESC NULLS LAST, year DESC NULLS LAST, lang DESC NULLS LAST) = 1)"""
    vec = f"""vec AS MATERIALIZED (SELECT item_key AS item_id, vec_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM (
  SELECT item_key, vec_id, CAST(embedding AS DOUBLE[]) AS w FROM item_vectors WHERE medium = '{medium}' AND vec_id IS NOT NULL AND item_key IS NOT NULL AND len(embedding) = {DIM}
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY vec_id, embedding) = 1))"""
    if medium == "film":
        prof = """prof AS (SELECT user_id AS profile_id, CAST(movie_id AS VARCHAR) AS item_id, rating FROM ratings WHERE user_id IS NOT NULL AND movie_id IS NOT NULL AND rating IS NOT NULL AND NOT isnan(rating)
  QUALIFY row_number() OVER (PARTITION BY user_id, movie_id ORDER BY rated_at DESC NULLS LAST, loaded_at DESC NULLS LAST, rating DESC) = 1)"""
        return ",\n".join((cat, vec, prof))
    from kinolex.plans.adapters import PROF

    events = PROF.replace("prof AS (", "prof_k AS (", 1)
    return ",\n".join((cat, vec, events, "prof AS (SELECT profile_id, vec.item_id, rating FROM prof_k JOIN vec ON vec.vec_id = prof_k.item_id)"))
