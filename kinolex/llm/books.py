"""Expressions shared by the operators on book records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USABLE_CHARS = 100
# Tags that stand between blocks of text, and named character references.
BLOCK_TAG = r"(?i)</?(p|br|div|li|ul|ol|tr|h[1-6]|hr|blockquote)\b[^>]*>"
REFERENCES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def work_no(c: Column) -> Column:
    """The number in a work id: "0123", "+123", "1,234", "123.0" and outer blanks of any kind; else null, as for zero and negatives."""
    t = F.regexp_replace(c, r"[\s\p{Z}\p{Cf}]+", "")
    digits = F.regexp_extract(t, r"^\+?([0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.0*)?$", 1)
    n = F.regexp_replace(digits, ",", "").try_cast("bigint")
    return F.when(n > 0, n)


def plain(c: Column) -> Column:
    """Text without markup and outer blanks; null stays null."""
    t = F.regexp_replace(F.regexp_replace(c, BLOCK_TAG, " "), r"<[^>]*>", "")
    for name, ch in REFERENCES:
        t = F.replace(t, F.lit(name), F.lit(ch))
    return F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def with_usable(df: DataFrame, column: str, out: str, outer: bool = False) -> DataFrame:
    """Rows whose column holds a usable text, with it in ``out``; all rows, with null elsewhere, if ``outer``.

    The text is generated, not projected, so that no filter above repeats its regular expressions.
    """
    kept = F.filter(F.array(plain(F.col(column))), lambda t: F.char_length(t) >= USABLE_CHARS)
    return df.withColumn(out, (F.explode_outer if outer else F.explode)(kept))


def words(c: Column) -> Column:
    """Distinct runs of letters and digits in lower case; an empty array for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(found)


# The same in DuckDB's SQL, for the queries' equivalents.
SQL_WORK_NO = r"""try_cast(replace(regexp_extract(regexp_replace(work_id, '[\s\pZ]+', '', 'g'), '^\+?([0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.0*)?$', 1), ',', '') AS BIGINT)"""
SQL_PLAIN = r"""regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(description, '</?(p|br|div|li|ul|ol|tr|h[1-6]|hr|blockquote)\b[^>]*>', ' ', 'gi'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"""
