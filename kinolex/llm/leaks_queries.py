"""Queries on evaluation texts inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolex.llm.leaks import leaks
from kinolex.sources import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 16 consecutive words of an item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with the number of documents it leaked into."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "split_name").distinct()
    n = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(n, "item_id", "left").select("item_id", "split_name", F.coalesce("documents", F.lit(0)).alias("documents"))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}

_WORDS = r"""regexp_extract_all(regexp_replace(lower(nfc_normalize(regexp_replace(regexp_replace(text, '[-\x{AD}\x{2010}\x{2011}]\s*[\n\r ]\s*', '', 'g'), '[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g'))), '[''\x{2019}\x{2BC}\x{2010}\x{2011}-]', '', 'g'), '[\pL\pN]+')"""
_HELD = f"""WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
ir AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 15], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 14)) AS k FROM i)),
dr AS (SELECT doc_id, array_to_string(w[k:k + 15], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 14)) AS k FROM d)),
held AS (SELECT DISTINCT doc_id, item_id FROM ir JOIN dr USING (run))
"""
SQL = {
    # every run of 16 words of every document
    "p7_found": _HELD + "SELECT doc_id, item_id FROM held",
    "p7_report": _HELD + "SELECT item_id, split_name, count(doc_id) AS documents FROM (SELECT DISTINCT item_id, split_name FROM eval_items) LEFT JOIN held USING (item_id) GROUP BY 1, 2",
}
