"""Queries that choose the best record of each work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolex.llm import books
from kinolex.llm.golden import Bundle, best_bundles
from kinolex.operators.skew import split_join
from kinolex.sources import table


def _editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of the works that at least two different book_ids share, with what is needed to judge them."""
    b = table(spark, sf_dir, "books_v1").select(
        "book_id", "title", "primary_author", "language_code", "publication_year", "num_pages", "ratings_count", "loaded_at", "description",
        books.work_no(F.col("work_id")).alias("work_no"),
    )
    b = b.where(F.col("work_no").isNotNull() & F.col("book_id").isNotNull())
    shared = b.groupBy("work_no").agg(F.min("book_id").alias("lo"), F.max("book_id").alias("hi")).where("lo < hi").select("work_no")
    return books.with_usable(split_join(b, shared, ["work_no"], ["book_id"]), "description", "text", outer=True)


def _count(name: str, agree: tuple[str, ...] = ()) -> Bundle:
    """The latest count that is neither null nor negative, with its time."""
    return Bundle(name, ("ratings_count", "loaded_at"), F.col("ratings_count") >= 0, F.unix_micros("loaded_at"), agree)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edition that supplies ratings_count and description of each work.

    What the problem states depends on the work alone, so that is the column in which the two bundles agree.
    """
    bundles = [
        _count("ratings_count", ("work_no",)),
        Bundle("description", ("description",), F.col("text").isNotNull(), F.size(books.words(F.col("text"))), ("work_no",)),
    ]
    return best_bundles(_editions(spark, sf_dir), "work_no", "book_id", bundles).select(
        "work_no", F.col("bundle").alias("field"), F.col("record").alias("book_id")
    )


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per work from bundles that agree in language: title, author and language; description; edition; count."""
    df = _editions(spark, sf_dir).withColumn("lang", F.lower(F.substring("language_code", 1, 2)))
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    bundles = [
        Bundle("name", ("title", "primary_author", "language_code"), filled("title"), F.coalesce("ratings_count", F.lit(-1)) + F.when(filled("primary_author"), 1e12).otherwise(0), ("lang",), 4),
        Bundle("description", ("description",), F.col("text").isNotNull(), F.size(books.words(F.col("text"))), ("lang",), 2),
        Bundle("edition", ("publication_year", "num_pages"), F.col("publication_year").isNotNull(), F.unix_micros("loaded_at"), ("lang",)),
        _count("count"),
    ]
    best = best_bundles(df, "work_no", "book_id", bundles)
    wide = best.groupBy("work_no").agg(
        *[F.max(F.when(F.col("bundle") == b.name, F.struct("record", "vals"))).alias(b.name) for b in bundles]
    )
    get = lambda b, f, kind="string": F.get_json_object(f"{b}.vals", f"$.{f}").cast(kind).alias(f)
    return wide.select(
        "work_no", get("name", "title"), get("name", "primary_author"), get("name", "language_code"), get("edition", "publication_year", "int"),
        get("edition", "num_pages", "int"), get("count", "ratings_count", "bigint"), get("description", "description"),
        F.col("name.record").alias("name_from"), F.col("description.record").alias("description_from"),
    )


QUERIES = {"p1_found": p1_found, "p1_records": p1_records}
SQL = {
    "p1_found": rf"""
WITH b AS (SELECT *, {books.SQL_WORK_NO} AS work_no, {books.SQL_PLAIN} AS txt FROM books_v1),
s AS (SELECT * FROM b WHERE work_no > 0 AND work_no IN (SELECT work_no FROM b WHERE work_no > 0 GROUP BY 1 HAVING count(DISTINCT book_id) > 1)),
u AS (
  SELECT work_no, 'ratings_count' AS field, book_id, row_number() OVER (PARTITION BY work_no ORDER BY loaded_at DESC NULLS LAST, book_id) AS rk
  FROM s WHERE ratings_count >= 0
  UNION ALL
  SELECT work_no, 'description', book_id,
         row_number() OVER (PARTITION BY work_no ORDER BY len(list_distinct(regexp_extract_all(lower(txt), '[\pL\pN]+'))) DESC, book_id)
  FROM s WHERE length(txt) >= 100)
SELECT work_no, field, book_id FROM u WHERE rk = 1""",
    # every consistent choice of name, description and edition of each work, by cost
    "p1_records": rf"""
WITH b AS (SELECT *, {books.SQL_WORK_NO} AS work_no, {books.SQL_PLAIN} AS txt, lower(substr(language_code, 1, 2)) AS lang FROM books_v1),
s AS (SELECT * FROM b WHERE work_no > 0 AND work_no IN (SELECT work_no FROM b WHERE work_no > 0 GROUP BY 1 HAVING count(DISTINCT book_id) > 1)),
c AS (
  SELECT 1 AS bundle, coalesce(ratings_count, -1) + CASE WHEN trim(coalesce(primary_author, '')) <> '' THEN 1e12 ELSE 0 END AS trust, * FROM s WHERE trim(coalesce(title, '')) <> ''
  UNION ALL SELECT 2, len(list_distinct(regexp_extract_all(lower(txt), '[\pL\pN]+'))), * FROM s WHERE length(txt) >= 100
  UNION ALL SELECT 3, epoch_us(loaded_at), * FROM s WHERE publication_year IS NOT NULL
  UNION ALL SELECT 4, epoch_us(loaded_at), * REPLACE (NULL AS lang) FROM s WHERE ratings_count >= 0 AND book_id IS NOT NULL),
d AS (SELECT * FROM c WHERE book_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY work_no, bundle, lang ORDER BY trust DESC NULLS LAST, book_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY work_no, bundle ORDER BY trust DESC NULLS LAST, book_id) - 1 AS rk FROM d),
o AS (SELECT work_no, bundle, rk, rk AS cost, lang, book_id, title, primary_author, language_code, description, publication_year, num_pages FROM r
      UNION ALL SELECT DISTINCT w.work_no, k.bundle, NULL::BIGINT, CASE WHEN r.work_no IS NULL THEN 0 ELSE 1000000 END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM (SELECT DISTINCT work_no FROM r) w CROSS JOIN (SELECT unnest([1, 2, 3]) AS bundle) k LEFT JOIN r ON r.work_no = w.work_no AND r.bundle = k.bundle),
chosen AS (
  SELECT n.work_no, n.title, n.primary_author, n.language_code, e.publication_year, e.num_pages, t.description, n.book_id AS name_from, t.book_id AS description_from
  FROM o n JOIN o t ON n.work_no = t.work_no AND n.bundle = 1 AND t.bundle = 2 AND (n.lang = t.lang) IS NOT FALSE
  JOIN o e ON e.work_no = n.work_no AND e.bundle = 3 AND (n.lang = e.lang) IS NOT FALSE AND (t.lang = e.lang) IS NOT FALSE
  QUALIFY row_number() OVER (PARTITION BY n.work_no ORDER BY 4 * n.cost + 2 * t.cost + e.cost, n.rk NULLS LAST, t.rk NULLS LAST, e.rk NULLS LAST) = 1)
SELECT chosen.*, q.ratings_count FROM chosen LEFT JOIN r q ON q.work_no = chosen.work_no AND q.bundle = 4 AND q.rk = 0""",
}
