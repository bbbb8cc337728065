"""Searches, parsing of tag lines and replies, text building and normalisation, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolex.functions import text as X
from kinolex.operators.relational import top_per_group
from kinolex.operators.search import contains, few, matched, popular, tiered
from kinolex.plans.adapters import ITEMS, with_
from kinolex.plans import tools as T
from kinolex.sources.files import hash_embed
from kinolex.sources.catalogues import catalogue, unit_vectors
from kinolex.sources.tables import items, table

SEARCHES = ("the", "treaty ironclad", "flight", "x", "rose", "Bridrûl", "war")
# Vocabulary of tags and their aliases.
VOCABULARY = ("slow-burn", "dark", "cozy", "space-opera")
ALIASES = {"slow": "slow-burn", "cosy": "cozy"}
LINES = ((1, "slow:0.9 Dark:1.7 dark:0.4 unknown:0.5"), (2, "cosy:0.05 space opera:0.6"), (3, "dark:x slow-burn:0.33"), (4, ""), (5, "space-opera:0.5 cozy:0.5 slow:0.5 dark:0.5"))
REPLIES = ((1, "Try Blue Bolt (1999) and Red Widget (2004)."), (2, "1. Small Ring (2010)"), (3, "Nothing fits."), (4, "Perhaps The Lost Harbor (2001) or Blue Bolt (1999)"))
SEEN = ("blue bolt", "small ring")
DUMP = """{"re_movies": "[{\\"movie_id\\": 5, \\"rating\\": 4.5}, {\\"movie_id\\": 7, \\"rating\\": 2}]", "re_books": "[]"}"""
NOISE = ("based", "novel", "sequel")


def topn_popular_substring(s, d):
    return popular(items(s, d), contains(F.col("title"), "WIDGET"), 10, "popularity", "item_id").select("item_id", "title", "popularity")


def topn_with_overfetch(s, d):
    """Filtered before the limit, so the result is complete."""
    return T.search_catalog(s, d, "book", 1, "saga", years=(1980, 2010), floor=5)


def studio_search(s, d):
    return T.search_by_studio(s, d, "film", 1, "pictures", years=(1990, None))


def people_search(s, d):
    """Films directed by, or with, somebody whose name contains the query; the role is told, films rated by profile 1 are left out."""
    return T.search_by_people(s, d, "film", 1, "an")


def people_search_directors(s, d):
    return T.search_by_people(s, d, "film", 1, "an", role="director", floor=5)


def search_user_ratings(s, d):
    """What profile 1 has rated from 3 on, best first."""
    return T.search_user_ratings(s, d, "film", 1, "the", least=3.0)


def search_user_ratings_like(s, d):
    """What profile 1 has rated, by similarity to the first film with a vector."""
    like = unit_vectors(s, d, "film").agg(F.min_by("item_id", "vec_id").alias("i")).first().i or ""
    return T.search_user_ratings(s, d, "film", 1, like=like, limit=10)


def get_recommendations(s, d):
    """Picks for profile 1 from all it likes."""
    return T.get_recommendations(s, d, "film", 1, floor=3)


def find_seed_row(s, d):
    """For each wanted title the most popular item of exactly that title, else one that contains it."""
    want = s.createDataFrame([("Blue Bolt",), ("small",), ("nowhere",)], "query string").select("query", X.search_form(F.col("query")).alias("q"))
    t = items(s, d).withColumn("t", X.search_form(F.col("title")))
    hit = t.join(few(want), F.contains(F.col("t"), F.col("q")))
    best = F.max_by(F.struct("item_id", "title"), F.struct((F.col("t") == F.col("q")).cast("int"), "popularity", -F.col("item_id"))).alias("b")
    return hit.groupBy("query").agg(best).select("query", "b.item_id", "b.title")


def search_tiered(s, d):
    """Titles of films; "rose" finds "Rosé", "half moon" finds "Half-Moon"."""
    q = s.createDataFrame([(x,) for x in SEARCHES], "query string")
    return tiered(catalogue(s, d, "film"), q, "item_id", "title", "popularity", 10)


def search_fuzzy(s, d):
    """The most popular film's title with two letters left out, and a title that nothing is like."""
    cat = catalogue(s, d, "film")
    title = cat.where("length(title) >= 12").agg(F.max_by("title", F.struct("popularity", "item_id")).alias("t")).first().t or ""
    q = s.createDataFrame([(title[:2] + title[3:8] + title[9:],), ("qqqq zzzz",)], "query string")
    return tiered(cat, q, "item_id", "title", "popularity", 10, fuzzy=True)


WANTED = (("The Upright Fabel", "T. Hiwis"), ("carnival of pifuwage", None), ("A Memoir Stuhehufa", "Defert Guwum"), ("Nothing Like This At All", None))


def join_fuzzy_match(s, d):
    """Wanted titles and authors to the books they are most like."""
    want = s.createDataFrame(list(WANTED), "query string, by string")
    return matched(want, table(s, d, "books_v1"), "book_id", "title", "primary_author")


def targeted_fetch(s, d):
    """Wanted titles in the second catalogue, exact before contained, latest release first; books of the first catalogue left out."""
    h = table(s, d, "hardcover_recent").select("id", "title", "release_date").distinct().withColumn("t", X.search_form(F.coalesce("title", F.lit(""))))
    want = s.createDataFrame([("rising",), ("saga",), ("a history",)], "query string")
    known = table(s, d, "books_v1").select(X.search_form(F.coalesce("title", F.lit(""))).alias("t")).distinct()
    hit = h.join(known, "t", "left_anti").join(few(want), F.contains(F.col("t"), F.col("query")))
    best = F.max_by("id", F.struct((F.col("t") == F.col("query")).cast("int"), F.coalesce("release_date", F.lit("")), "id")).alias("id")
    return hit.groupBy("query").agg(best)


def tag_line_parse(s, d):
    lines = s.createDataFrame(LINES, "id int, line string").select("id", F.explode(F.regexp_extract_all("line", F.lit(r"([^:]+:[^ ]*)(?: |$)"), F.lit(1))).alias("part"))
    p = lines.select("id", F.regexp_replace(F.lower(F.trim(F.regexp_extract("part", r"^(.*):([^:]*)$", 1))), " +", "-").alias("tag"), F.regexp_extract("part", r"^(.*):([^:]*)$", 2).try_cast("double").alias("score"))
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    p = p.withColumn("tag", F.coalesce(F.try_element_at(alias, F.col("tag")), F.col("tag"))).where(F.col("score").isNotNull() & F.col("tag").isin(*VOCABULARY))
    best = p.groupBy("id", "tag").agg(F.max(F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("score")))).alias("score"))
    return top_per_group(best, ["id"], [F.desc("score"), "tag"], 8)


def grounding_check(s, d):
    """Titles before a year in parentheses that aren't among those seen."""
    r = s.createDataFrame(REPLIES, "reply_id int, reply string")
    t = r.select("reply_id", F.explode(F.regexp_extract_all("reply", F.lit(r"([A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*)*) \(\d{4}\)"), F.lit(1))).alias("title"))
    low = F.lower("title")
    seen = F.array(*[F.lit(x) for x in SEEN])
    known = F.exists(seen, lambda x: (x == low) | ((F.length(low) >= 4) & (F.contains(x, low) | F.contains(low, x))))
    return t.where((F.length("title") >= 3) & ~known).distinct()


def parse_profile_json(s, d):
    raw = s.createDataFrame([(DUMP,)], "raw string").select(F.from_json(F.get_json_object("raw", "$.re_movies"), "array<struct<movie_id:bigint,rating:double>>").alias("r"))
    return raw.select(F.inline("r")).select(F.col("movie_id").alias("item_id"), "rating")


def embed_text_build(s, d):
    """Texts to encode, in four variants: overview; with genres; with the title's words as themes; with people."""
    m = table(s, d, "movies").select("id", X.cleaned(F.col("overview")).alias("o"), X.listed(X.cleaned(F.col("genres"))).alias("g"), X.title_tokens(F.coalesce("title", F.lit("")), NOISE).alias("k"), X.cleaned(F.col("director")).alias("p"))
    genres = F.when(F.size("g") > 0, F.concat(F.lit("Genres: "), F.array_join("g", ", "), F.lit(".")))
    themes = F.when(F.size("k") > 0, F.concat(F.lit("Themes: "), F.array_join(F.slice("k", 1, 20), ", "), F.lit(".")))
    people = F.when(F.col("p") != "", F.concat(F.lit("By "), F.col("p"), F.lit(".")))
    o = F.nullif("o", F.lit(""))
    kinds = {"overview": [o], "rich": [o, genres], "keywords": [o, themes, genres], "people": [o, themes, genres, people]}
    return m.select("id", F.explode(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.concat_ws(" ", *v))])).alias("variant", "text")).distinct()


def embed_text_series(s, d):
    """Texts of series to encode: overview, genres, creators, networks and seasons."""
    t = table(s, d, "tv_corpus")
    part = lambda label, c: F.when(F.size(X.listed(X.cleaned(F.col(c)))) > 0, F.concat(F.lit(label), F.array_join(X.listed(X.cleaned(F.col(c))), ", "), F.lit(".")))
    seasons = F.when(F.col("number_of_seasons") > 0, F.concat(F.col("number_of_seasons").cast("string"), F.lit(" seasons.")))
    o = F.nullif(X.cleaned(F.col("overview")), F.lit(""))
    text = F.concat_ws(" ", o, part("Genres: ", "genres"), part("Created by ", "created_by"), part("On ", "networks"), seasons)
    return t.select("tmdb_id", text.alias("text")).distinct()


def embed_text_books(s, d):
    """Texts of books to encode: title and author, then description and genres."""
    b = table(s, d, "books_v1")
    author = F.when(X.cleaned(F.col("primary_author")) != "", F.concat(F.lit("by "), X.cleaned(F.col("primary_author")), F.lit(".")))
    genres = F.when(F.size("genres") > 0, F.concat(F.lit("Genres: "), F.array_join("genres", ", "), F.lit(".")))
    clean = lambda c: F.nullif(X.cleaned(F.col(c)), F.lit(""))
    return b.select("book_id", F.concat_ws(" ", clean("title"), author, clean("description"), genres).alias("text")).distinct()


def string_norm_key(s, d):
    return items(s, d).select("item_id", X.short_key(F.col("title"), F.col("maker")).alias("value"))


def string_norm_spaced(s, d):
    return table(s, d, "books_v1").select("book_id", X.spaced(F.coalesce("title", F.lit(""))).alias("value")).distinct()


def string_norm_words(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", X.first_words(F.col("text"), 30).alias("value"))


def scan_parquet(s, d):
    return table(s, d, "part").select("p_partkey", "p_brand", "p_size")


def scan_jsonl(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


def embed_text_encode(s, d):
    """Hashed vectors of the documents' texts, as the sum of their cells' places: no encoder is available here."""
    v = hash_embed(table(s, d, "documents").select("doc_id", "text"), "text", "v")
    return v.select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        topn_popular_substring, topn_with_overfetch, studio_search, people_search, people_search_directors, search_user_ratings, search_user_ratings_like, get_recommendations, find_seed_row, search_tiered, search_fuzzy, join_fuzzy_match, targeted_fetch, tag_line_parse,
        grounding_check, parse_profile_json, embed_text_build, embed_text_series, embed_text_books, string_norm_key, string_norm_spaced, string_norm_words, embed_text_encode, scan_parquet, scan_jsonl,
    )
}

_SP = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
_SF = X.SQL_SEARCH_FORM
_UNRATED = "mine AS (SELECT item_id FROM prof WHERE profile_id = 1)"
_PEOPLE = T.sql_with("film", _UNRATED, "m AS (SELECT *, len(list_filter(makers, lambda x: contains(x, 'an'))) > 0 AS d, len(list_filter(people, lambda x: contains(lower(coalesce(x, '')), 'an'))) > 0 AS p FROM cat WHERE item_id NOT IN (SELECT item_id FROM mine))")
_PEOPLE += "SELECT item_id, popularity, CASE WHEN d AND p THEN 'both' WHEN d THEN 'director' ELSE 'actor' END AS role FROM m "
_CL = "(CASE WHEN lower(trim(coalesce({0}, ''))) = 'nan' THEN '' ELSE trim(coalesce({0}, '')) END)"
_LIST = "list_filter(list_transform(string_split(" + _CL + ", ','), lambda x: trim(x)), lambda x: x <> '')"


def _values(rows):
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


SQL = {
    "topn_popular_substring": with_(ITEMS) + "SELECT item_id, title, popularity FROM items WHERE contains(lower(title), 'widget') ORDER BY popularity DESC, item_id LIMIT 10",
    "topn_with_overfetch": T.sql_with("book", _UNRATED) + "SELECT item_id, popularity FROM cat WHERE (contains(lower(title), 'saga') OR len(list_filter(makers, lambda m: contains(m, 'saga'))) > 0) AND year BETWEEN 1980 AND 2010 AND popularity >= 5 AND item_id NOT IN (SELECT item_id FROM mine) ORDER BY popularity DESC, item_id LIMIT 15",
    "studio_search": T.sql_with("film", _UNRATED) + "SELECT item_id, popularity FROM cat WHERE contains(lower(studio), 'pictures') AND year >= 1990 AND item_id NOT IN (SELECT item_id FROM mine) ORDER BY popularity DESC, item_id LIMIT 15",
    "people_search": _PEOPLE + "WHERE d OR p ORDER BY popularity DESC, item_id LIMIT 25",
    "people_search_directors": _PEOPLE + "WHERE d AND popularity >= 5 ORDER BY popularity DESC, item_id LIMIT 25",
    "search_user_ratings": T.sql_with("film", _UNRATED) + "SELECT item_id, title, year, rating, rating AS rank_by FROM prof JOIN cat USING (item_id) WHERE profile_id = 1 AND rating BETWEEN 3 AND 5 AND contains(lower(title), 'the') ORDER BY rating DESC, item_id LIMIT 20",
    "search_user_ratings_like": T.sql_with("film", "seed AS (SELECT arg_min(v, vec_id) AS q FROM vec)") + """SELECT item_id, title, year, rating, round(list_dot_product(v, q), 9) AS rank_by FROM prof JOIN cat USING (item_id) JOIN vec USING (item_id), seed
WHERE profile_id = 1 AND rating BETWEEN 0.5 AND 5 ORDER BY rank_by DESC, rating DESC, item_id LIMIT 10""",
    "get_recommendations": T.sql_with("film", T.SQL_LIKED.replace("WHERE", "WHERE profile_id = 1 AND"), T.sql_candidates(200, 3, True), T.sql_scored(), T.sql_robin(15)),
    "find_seed_row": with_(ITEMS, "w(query) AS (VALUES ('Blue Bolt'), ('small'), ('nowhere'))") + f"SELECT query, item_id, title FROM items JOIN w ON contains({_SF.format('title')}, {_SF.format('query')}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY CASE WHEN {_SF.format('title')} = {_SF.format('query')} THEN 0 ELSE 1 END, popularity DESC, item_id) = 1",
    "search_tiered": T.sql_with("film", f"w(query) AS (VALUES {_values([(x,) for x in SEARCHES])})") + f"""SELECT query, tier, item_id, CAST(row_number() OVER (PARTITION BY query ORDER BY popularity DESC, item_id) AS INTEGER) AS rk FROM (
  SELECT *, min(tier) OVER (PARTITION BY query) AS first FROM (
    SELECT query, item_id, popularity, CASE WHEN contains(t, q) THEN 1 WHEN len(list_filter(string_split(q, ' '), lambda x: NOT contains(t, x))) = 0 THEN 2 END AS tier
    FROM (SELECT query, {_SF.format('query')} AS q FROM w), (SELECT item_id, popularity, {_SF.format('title')} AS t FROM cat) WHERE length(q) >= 2) WHERE tier IS NOT NULL) WHERE tier = first QUALIFY rk <= 10""",
    "targeted_fetch": f"""WITH w(query) AS (VALUES ('rising'), ('saga'), ('a history')), h AS (SELECT DISTINCT id, {_SF.format("coalesce(title, '')")} AS t, coalesce(release_date, '') AS r FROM hardcover_recent)
SELECT query, id FROM h JOIN w ON contains(t, query) WHERE t NOT IN (SELECT {_SF.format("coalesce(title, '')")} FROM books_v1) QUALIFY row_number() OVER (PARTITION BY query ORDER BY CASE WHEN t = query THEN 0 ELSE 1 END, r DESC, id DESC) = 1""",
    "tag_line_parse": f"""WITH l(id, line) AS (VALUES {_values(LINES)}),
p AS (SELECT id, unnest(regexp_extract_all(line, '([^:]+:[^ ]*)(?: |$)', 1)) AS part FROM l),
t AS (SELECT id, regexp_replace(lower(trim(regexp_extract(part, '^(.*):([^:]*)$', 1))), ' +', '-', 'g') AS tag, try_cast(regexp_extract(part, '^(.*):([^:]*)$', 2) AS DOUBLE) AS score FROM p),
a AS (SELECT id, CASE tag {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())} ELSE tag END AS tag, score FROM t WHERE score IS NOT NULL)
SELECT id, tag, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS INTEGER) AS rk FROM (SELECT id, tag, max(greatest(0.2, least(1.0, score))) AS score FROM a WHERE tag IN {VOCABULARY} GROUP BY 1, 2) QUALIFY rk <= 8""",
    "grounding_check": f"""WITH r(reply_id, reply) AS (VALUES {_values(REPLIES)}), t AS (SELECT reply_id, unnest(regexp_extract_all(reply, '([A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*)*) \\(\\d{{4}}\\)', 1)) AS title FROM r)
SELECT DISTINCT reply_id, title FROM t WHERE length(title) >= 3 AND NOT EXISTS (SELECT 1 FROM (VALUES {_values([(x,) for x in SEEN])}) s(x) WHERE x = lower(title) OR (length(title) >= 4 AND (contains(x, lower(title)) OR contains(lower(title), x))))""",
    "parse_profile_json": "SELECT CAST(json_extract(j, '$.movie_id') AS BIGINT) AS item_id, CAST(json_extract(j, '$.rating') AS DOUBLE) AS rating FROM (SELECT unnest(CAST(json_extract_string('" + DUMP + "', '$.re_movies') AS JSON[])) AS j)",
    "embed_text_build": f"""WITH m AS (SELECT DISTINCT id, nullif({_CL.format('overview')}, '') AS o, {_LIST.format('genres')} AS g,
  list_filter(string_split_regex(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[:-]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: len(w) >= 3 AND w NOT IN {NOISE}) AS k0, {_CL.format('director')} AS p FROM movies),
k AS (SELECT id, o, p, CASE WHEN len(g) > 0 THEN concat('Genres: ', array_to_string(g, ', '), '.') END AS g,
  CASE WHEN len(k0) > 0 THEN concat('Themes: ', array_to_string(list_filter(k0, lambda x, i: list_position(k0, x) = i)[1:20], ', '), '.') END AS k, CASE WHEN p <> '' THEN concat('By ', p, '.') END AS pp FROM m)
SELECT DISTINCT id, variant, text FROM (SELECT id, unnest(['overview', 'rich', 'keywords', 'people']) AS variant, unnest([concat_ws(' ', o), concat_ws(' ', o, g), concat_ws(' ', o, k, g), concat_ws(' ', o, k, g, pp)]) AS text FROM k)""",
    "embed_text_series": f"""SELECT DISTINCT tmdb_id, concat_ws(' ', nullif({_CL.format('overview')}, ''), CASE WHEN len(g) > 0 THEN concat('Genres: ', array_to_string(g, ', '), '.') END, CASE WHEN len(c) > 0 THEN concat('Created by ', array_to_string(c, ', '), '.') END,
  CASE WHEN len(n) > 0 THEN concat('On ', array_to_string(n, ', '), '.') END, CASE WHEN number_of_seasons > 0 THEN concat(number_of_seasons, ' seasons.') END) AS text
FROM (SELECT *, {_LIST.format('genres')} AS g, {_LIST.format('created_by')} AS c, {_LIST.format('networks')} AS n FROM tv_corpus)""",
    "embed_text_books": f"""SELECT DISTINCT book_id, concat_ws(' ', nullif({_CL.format('title')}, ''), CASE WHEN {_CL.format('primary_author')} <> '' THEN concat('by ', {_CL.format('primary_author')}, '.') END, nullif({_CL.format('description')}, ''),
  CASE WHEN len(genres) > 0 THEN concat('Genres: ', array_to_string(genres, ', '), '.') END) AS text FROM books_v1""",
    "string_norm_key": with_(ITEMS) + "SELECT item_id, concat(substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 20), '|', substr(regexp_replace(lower(maker), '[^a-z0-9]', '', 'g'), 1, 10)) AS value FROM items",
    "string_norm_spaced": f"SELECT DISTINCT book_id, {_SP.format('''coalesce(title, '')''')} AS value FROM books_v1",
    "string_norm_words": r"SELECT doc_id, array_to_string(string_split_regex(trim(text), '[ \t\n\x0B\f\r]+')[1:30], ' ') AS value FROM documents WHERE text IS NOT NULL",
    "scan_parquet": "SELECT p_partkey, p_brand, p_size FROM part",
    "scan_jsonl": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
