"""String expressions for catalogue text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(o: int) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", chr(o)) if not unicodedata.combining(c))


# Letters that are one ASCII letter with marks, and that letter: by rule, from the Latin blocks.
_MARKED = [(chr(o), _plain(o)) for o in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(_plain(o)) == 1 and _plain(o).isascii()]
MARKED, UNMARKED = "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)


def cleaned(c: Column) -> Column:
    """Trimmed text; the missing markers null, blank and 'nan' become the empty string."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t) == "nan", F.lit("")).otherwise(t)


def alnum(c: Column) -> Column:
    """Small letters and digits of ASCII only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def short_key(title: Column, author: Column) -> Column:
    return F.concat(F.substring(alnum(title), 1, 20), F.lit("|"), F.substring(alnum(author), 1, 10))


def spaced(c: Column) -> Column:
    """Lower-case letters and digits with single blanks between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " +", " "))


def folded(c: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.lower(F.translate(F.regexp_replace(c, r"\p{M}+", ""), MARKED, UNMARKED))


def search_form(c: Column) -> Column:
    """What searches compare: folded letters and digits, single blanks for hyphens, colons, slashes and between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(folded(c), "[-:/&]", " "), "[^a-z0-9 ]", ""), " +", " "))


SQL_FOLDED = f"lower(translate(regexp_replace({{0}}, '\\p{{{{M}}}}+', '', 'g'), '{MARKED}', '{UNMARKED}'))"
SQL_SEARCH_FORM = f"trim(regexp_replace(regexp_replace(regexp_replace({SQL_FOLDED}, '[-:/&]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def people_of(c: Column) -> Column:
    """Names in a packed field: divided at commas, bars and slashes, trimmed, the missing markers gone."""
    return F.filter(F.transform(F.split(cleaned(c), "[,|/]"), lambda x: F.trim(x)), lambda x: x != "")


def ascii_share(c: Column) -> Column:
    """Share of ASCII letters among all letters; 0 where there is no letter."""
    plain = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters > 0, plain / letters).otherwise(F.lit(0.0))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, n), " ")


def listed(c: Column, sep: str = ",") -> Column:
    """Trimmed non-empty elements of a packed list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def year_of(c: Column) -> Column:
    """Year that a date string starts with, else null."""
    return F.substring(c, 1, 4).try_cast("int")


def title_tokens(c: Column, stop: tuple[str, ...]) -> Column:
    """Words of at least three letters or digits that aren't stop words."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(c), "[:-]", " "), "[^a-z0-9 ]", ""), " +")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop)))
