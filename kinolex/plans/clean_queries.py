"""Filters, coercions and derived columns over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolex.functions import text as X
from kinolex.operators.relational import in_range, tiers
from kinolex.plans.adapters import ITEMS, TAGS, with_
from kinolex.sources.tables import items, table, tags_long

# Language codes counted as English, and names of languages.
ENGLISH = ("eng", "en-US", "en-GB", "en-CA", "en")
LANGUAGES = {
    "en": "English", "fr": "French", "es": "Spanish", "ja": "Japanese", "it": "Italian", "de": "German", "ru": "Russian", "zh": "Chinese",
    "pt": "Portuguese", "ko": "Korean", "hi": "Hindi", "sv": "Swedish", "da": "Danish", "fi": "Finnish", "nl": "Dutch", "pl": "Polish",
    "tr": "Turkish", "cn": "Chinese", "ta": "Tamil", "te": "Telugu", "th": "Thai", "no": "Norwegian", "fa": "Persian", "ar": "Arabic",
}
# Patterns of one genre's themes.
THEMES = (
    r"science[- ]fiction", r"\bsci[- ]?fi\b", r"speculative fiction",
    r"\bspace\b", r"\bspaceship\b", r"\bstarship\b", r"interstellar", r"\bgalax",
    r"\bnebula\b", r"\borbit", r"\bcosmos\b",
    r"\balien\b", r"\baliens\b", r"extraterrestrial", r"first contact",
    r"dystopia", r"post[- ]apocalyp", r"apocalyp", r"totalitarian future",
    r"surveillance state", r"climate collapse", r"resource war",
    r"cyberpunk", r"cybernet", r"\bandroid\b", r"\brobot\b",
    r"artificial intelligence", r"sentient machine", r"\bcyborg",
    r"virtual reality", r"\bsimulation\b", r"digital consciousness",
    r"upload(?:ed)? mind", r"neural implant",
    r"time[- ]travel", r"time[- ]loop", r"time displacement",
    r"climate change", r"climate crisis", r"climate fiction",
    r"rising sea", r"ecological collapse", r"climate refugee",
    r"\bmars\b", r"\bvenus\b", r"\bcolony\b", r"colonization",
    r"future[- ]earth", r"far[- ]future", r"near[- ]future", r"22nd century",
    r"genetic engineering", r"\bclone\b", r"bioengineered", r"genetically modified",
    r"alternate (?:history|reality|timeline)", r"parallel universe", r"multiverse",
    r"after the (?:collapse|fall|plague|virus)",
    r"megacorp", r"corporate dystopia",
)
SCENES = "|".join(THEMES)


def film_tier_filter(s, d):
    m = table(s, d, "movies")
    full = (F.length(X.cleaned(F.col("genres"))) > 0) & (F.length(F.trim(F.coalesce("poster_path", F.lit("")))) > 0)
    return tiers(m, F.col("vote_count"), F.col("original_language") == "en", (20, 8, 8, 3), F.col("overview"), 30, full, 100).select("id", "original_language", "tier").distinct()


def tv_tier_filter(s, d):
    t = table(s, d, "tv_corpus")
    full = (F.length(X.cleaned(F.col("genres"))) > 0) & (F.length(F.trim(F.coalesce("poster_path", F.lit("")))) > 0)
    return tiers(t, F.col("vote_count"), F.col("original_language") == "en", (10, 4, 5, 2), F.col("overview"), 80, full, 80).select("tmdb_id", "original_language", "tier").distinct()


def book_filter(s, d):
    b = table(s, d, "books_v1")
    keep = F.col("language_code").isin(*ENGLISH) & (F.length("description") >= 100) & (F.length(F.trim("title")) > 0) & (F.coalesce("ratings_count", F.lit(0)) >= 10)
    return b.where(keep).select("book_id", "language_code", "ratings_count").distinct()


def external_book_filter(s, d):
    h = table(s, d, "hardcover_recent")
    year = F.coalesce(X.year_of(F.col("release_date")), F.lit(0))
    keep = (F.length("description") >= 100) & (F.length(F.trim("title")) > 0) & (X.ascii_share(F.col("description")) > 0.85) & (year <= 2025)
    return h.where(keep).select("id", "title").distinct()


def looks_english(s, d):
    t = table(s, d, "documents").where(F.col("text").isNotNull())
    share = X.ascii_share(F.col("text"))
    return t.select("doc_id", F.round(share, 6).alias("ascii_share"), (share > 0.85).alias("is_english"))


def tagging_candidates(s, d):
    i = items(s, d).join(tags_long(s, d).select("item_id").distinct(), "item_id", "left_anti")
    return i.where("popularity >= 25").orderBy(F.desc("popularity"), "item_id").limit(100).select("item_id", "popularity")


def retag_candidates(s, d):
    i, done = items(s, d).select("item_id", "popularity"), tags_long(s, d).select("item_id").distinct()
    new = i.where("popularity >= 40").join(done, "item_id", "left_anti").withColumn("already_tagged", F.lit(False))
    return new.unionByName(i.join(done, "item_id", "left_semi").withColumn("already_tagged", F.lit(True)))


def regex_candidates(s, d):
    """Books whose title, description or genres name one of the themes."""
    b = table(s, d, "books_v1")
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.array_join(F.coalesce("genres", F.array().cast("array<string>")), " ")))
    return b.where(hay.rlike(SCENES)).select("book_id", "title").distinct()


def coerce_numeric(s, d):
    return table(s, d, "books_v1").select("book_id", F.nanvl(F.coalesce(F.regexp_replace("work_id", r"[\s\p{Z}]", "").try_cast("double"), F.lit(0.0)), F.lit(0.0)).cast("bigint").alias("value")).distinct()


def extract_safe_cast(s, d):
    h = table(s, d, "hardcover_recent")
    return h.select("id", F.split("release_date", "-").getItem(0).try_cast("int").alias("year"), F.get(F.split("release_date", "-"), F.lit(1)).try_cast("int").alias("month"), F.coalesce("rating", F.lit(0.0)).alias("rating")).distinct()


def primary_of_list(s, d):
    m = table(s, d, "movies")
    return m.select("id", F.coalesce(F.trim(F.get(F.split(X.cleaned(F.col("genres")), ","), F.lit(0))), F.lit("")).alias("value")).distinct()


def first_author(s, d):
    names = F.filter(F.transform("contributions", lambda c: c["author"]["name"]), lambda n: F.coalesce(F.trim(n), F.lit("")) != "")
    return table(s, d, "hardcover_recent").select("id", F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("value")).distinct()


def year_from_date(s, d):
    return table(s, d, "hardcover_recent").select("id", X.year_of(F.col("release_date")).alias("value")).distinct()


def null_sentinel_clean(s, d):
    return table(s, d, "tv_corpus").select("tmdb_id", X.cleaned(F.col("created_by")).alias("value")).distinct()


def display_label(s, d):
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    code = F.col("original_language")
    label = F.coalesce(F.try_element_at(names, code), F.upper(code), F.lit(""))
    return table(s, d, "movies").select("id", label.alias("value")).distinct()


def popularity_rescale(s, d):
    """Scaled from the stored value, so that doing it again changes nothing."""
    i = items(s, d)
    return i.select("item_id", F.when(F.col("item_id") % 10 == 0, F.col("popularity") * 25).otherwise(F.col("popularity")).alias("popularity"))


def flags_range_filters(s, d):
    return in_range(items(s, d), year=(1990, 2010), popularity=(25, None)).select("item_id", "title", "year")


def agg_conditional_counters(s, d):
    m = table(s, d, "movies")
    v = F.coalesce("vote_count", F.lit(0))
    rich = (F.length(F.coalesce("overview", F.lit(""))) >= 100) & (F.length(X.cleaned(F.col("genres"))) > 0)
    low = v.between(8, 19)
    n = m.agg(F.count_if(v >= 20).alias("n_clean"), F.count_if(low & rich).alias("n_prob_kept"), F.count_if(low & ~rich).alias("n_prob_rejected"))
    return n.withColumn("reject_pct", F.round(F.col("n_prob_rejected") * 100.0 / F.greatest(F.col("n_prob_kept") + F.col("n_prob_rejected"), F.lit(1)), 6))


QUERIES = {
    f.__name__: f
    for f in (
        film_tier_filter, tv_tier_filter, book_filter, external_book_filter, looks_english, tagging_candidates, retag_candidates, regex_candidates,
        coerce_numeric, extract_safe_cast, primary_of_list, first_author, year_from_date, null_sentinel_clean, display_label, popularity_rescale,
        flags_range_filters, agg_conditional_counters,
    )
}

_CLEAN = "(CASE WHEN lower(trim(coalesce({0}, ''))) = 'nan' THEN '' ELSE trim(coalesce({0}, '')) END)"
_TIER = """SELECT DISTINCT {key}, original_language, tier FROM (
  SELECT *, CASE WHEN v >= hi THEN 'clean' WHEN v >= lo AND n >= {rich} AND full_ THEN 'probation' END AS tier FROM (
    SELECT *, coalesce(vote_count, 0) AS v, length(trim(coalesce(overview, ''))) AS n,
           CASE WHEN original_language = 'en' THEN {a} ELSE {c} END AS hi, CASE WHEN original_language = 'en' THEN {b} ELSE {e} END AS lo,
           length({genres}) > 0 AND length(trim(coalesce(poster_path, ''))) > 0 AS full_ FROM {tbl}) WHERE n >= {least}) WHERE tier IS NOT NULL"""
_SHARE = r"CASE WHEN length(regexp_replace({0}, '[^\pL]', '', 'g')) > 0 THEN length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) / length(regexp_replace({0}, '[^\pL]', '', 'g')) ELSE 0.0 END"
SQL = {
    "film_tier_filter": _TIER.format(key="id", tbl="movies", a=20, b=8, c=8, e=3, least=30, rich=100, genres=_CLEAN.format("genres")),
    "tv_tier_filter": _TIER.format(key="tmdb_id", tbl="tv_corpus", a=10, b=4, c=5, e=2, least=80, rich=80, genres=_CLEAN.format("genres")),
    "book_filter": f"SELECT DISTINCT book_id, language_code, ratings_count FROM books_v1 WHERE language_code IN {ENGLISH} AND length(description) >= 100 AND length(trim(title)) > 0 AND coalesce(ratings_count, 0) >= 10",
    "external_book_filter": f"SELECT DISTINCT id, title FROM hardcover_recent WHERE length(description) >= 100 AND length(trim(title)) > 0 AND {_SHARE.format('description')} > 0.85 AND coalesce(try_cast(substr(release_date, 1, 4) AS INTEGER), 0) <= 2025",
    "looks_english": f"SELECT doc_id, round({_SHARE.format('text')}, 6) AS ascii_share, {_SHARE.format('text')} > 0.85 AS is_english FROM documents WHERE text IS NOT NULL",
    "tagging_candidates": with_(ITEMS, TAGS) + "SELECT item_id, popularity FROM items WHERE popularity >= 25 AND item_id NOT IN (SELECT item_id FROM tags) ORDER BY popularity DESC, item_id LIMIT 100",
    "retag_candidates": with_(ITEMS, TAGS) + "SELECT item_id, popularity, item_id IN (SELECT item_id FROM tags) AS already_tagged FROM items WHERE popularity >= 40 OR item_id IN (SELECT item_id FROM tags)",
    "regex_candidates": rf"SELECT DISTINCT book_id, title FROM books_v1 WHERE regexp_matches(lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), array_to_string(coalesce(genres, []), ' '))), '{SCENES}')",
    "coerce_numeric": r"SELECT DISTINCT book_id, CAST(trunc(coalesce(try_cast(regexp_replace(work_id, '[\s\pZ]', '', 'g') AS DOUBLE), 0)) AS BIGINT) AS value FROM (SELECT book_id, CASE WHEN lower(trim(work_id)) IN ('nan') THEN NULL ELSE work_id END AS work_id FROM books_v1)",
    "extract_safe_cast": "SELECT DISTINCT id, try_cast(split_part(release_date, '-', 1) AS INTEGER) AS year, try_cast(nullif(split_part(release_date, '-', 2), '') AS INTEGER) AS month, coalesce(rating, 0.0) AS rating FROM hardcover_recent",
    "primary_of_list": f"SELECT DISTINCT id, trim(split_part({_CLEAN.format('genres')}, ',', 1)) AS value FROM movies",
    "first_author": "SELECT DISTINCT id, coalesce(list_filter(list_transform(contributions, lambda c: c.author.name), lambda n: coalesce(trim(n), '') <> '')[1], '') AS value FROM hardcover_recent",
    "year_from_date": "SELECT DISTINCT id, try_cast(substr(release_date, 1, 4) AS INTEGER) AS value FROM hardcover_recent",
    "null_sentinel_clean": f"SELECT DISTINCT tmdb_id, {_CLEAN.format('created_by')} AS value FROM tv_corpus",
    "display_label": "SELECT DISTINCT id, coalesce(CASE original_language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " END, upper(original_language), '') AS value FROM movies",
    "popularity_rescale": with_(ITEMS) + "SELECT item_id, CASE WHEN item_id % 10 = 0 THEN popularity * 25 ELSE popularity END AS popularity FROM items",
    "flags_range_filters": with_(ITEMS) + "SELECT item_id, title, year FROM items WHERE year BETWEEN 1990 AND 2010 AND popularity >= 25",
    "agg_conditional_counters": f"""SELECT *, round(n_prob_rejected * 100.0 / greatest(n_prob_kept + n_prob_rejected, 1), 6) AS reject_pct FROM (
  SELECT count(*) FILTER (v >= 20) AS n_clean, count(*) FILTER (v BETWEEN 8 AND 19 AND rich) AS n_prob_kept, count(*) FILTER (v BETWEEN 8 AND 19 AND NOT rich) AS n_prob_rejected
  FROM (SELECT coalesce(vote_count, 0) AS v, length(coalesce(overview, '')) >= 100 AND length({_CLEAN.format('genres')}) > 0 AS rich FROM movies))""",
}
