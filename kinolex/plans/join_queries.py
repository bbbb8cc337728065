"""Joins by membership and lookup, duplicates, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolex.functions import text as X
from kinolex.operators.relational import argmax_edition, keep_one, replace_groups, top_per_group, upsert_last
from kinolex.plans.adapters import CREDITS, ITEMS, PROF, TAGS, with_
from kinolex.sources.tables import credits, items, ratings, table, tags_long, vec_items

# Curated tag by source tag, many to many.
CURATED = (("bright", "d0"), ("bright", "d1"), ("dark", "d2"), ("dark", "d3"), ("slow", "d1"), ("slow", "d5"), ("odd", "d7"))


def curated(s):
    return s.createDataFrame(CURATED, "curated string, tag string")


def join_semi_corpus(s, d):
    return ratings(s, d).join(vec_items(s, d), "item_id", "left_semi").select("profile_id", "item_id", "rating")


def join_anti_rated(s, d):
    return vec_items(s, d).select("item_id").join(ratings(s, d).where("profile_id = 1"), "item_id", "left_anti")


def join_anti_tagged(s, d):
    return items(s, d).select("item_id").join(tags_long(s, d), "item_id", "left_anti")


def join_anti_creator(s, d):
    """Items of no director of a film that user 1 rated; an empty name excludes nobody."""
    m = table(s, d, "movies").select("id", F.lower(X.cleaned(F.col("director"))).alias("who"))
    seen = table(s, d, "ratings").where("user_id = 1").select(F.col("movie_id").alias("id")).distinct().join(m, "id").where("who <> ''").select("who").distinct()
    return m.join(seen, "who", "left_anti").select("id", "who").distinct()


def join_anti_creator_set(s, d):
    """Series that share no creator with a series of at least 50 votes."""
    t = table(s, d, "tv_corpus").select("tmdb_id", "vote_count", F.transform(X.listed(X.cleaned(F.col("created_by"))), lambda x: F.lower(x)).alias("who"))
    names = t.where("vote_count >= 50").select(F.explode("who").alias("name")).distinct()
    hit = t.select("tmdb_id", F.explode("who").alias("name")).join(names, "name", "left_semi").select("tmdb_id").distinct()
    return t.select("tmdb_id").distinct().join(hit, "tmdb_id", "left_anti")


def join_lookup_map(s, d):
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("person_id"), "s_name")
    return credits(s, d).select("film_id", "person_id").distinct().join(sup, "person_id", "left").select("film_id", F.coalesce("s_name", F.lit("")).alias("person")).distinct()


def billed(s, d):
    first = credits(s, d).groupBy("film_id", "person_id").agg(F.min("ordering").alias("ordering"))
    return top_per_group(first, ["film_id"], ["ordering", "person_id"], 5)


def topk_billing_dedup(s, d):
    return billed(s, d).select("film_id", "person_id", "rk")


def join_chain_credits(s, d):
    """Orders as films: the first billed as director, the five first billed as cast."""
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    cast = billed(s, d).join(sup, "person_id", "left").groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("rk", F.coalesce("name", F.lit("")).alias("name")))).alias("c"))
    films = table(s, d, "orders").select(F.col("o_orderkey").alias("film_id"))
    names = F.transform("c", lambda x: x["name"])
    return films.join(cast, "film_id", "left").select("film_id", F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("director"), F.coalesce(F.array_join(names, ","), F.lit("")).alias("cast_csv"))


def agg_collect_ordered_list(s, d):
    c = credits(s, d).groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("ordering", "person_id"))).alias("c"))
    return c.select("film_id", F.array_join(F.transform("c", lambda x: x["person_id"].cast("string")), ",").alias("names_csv"))


def join_mn_explode(s, d):
    return tags_long(s, d).join(F.broadcast(curated(s)), "tag").select("item_id", "curated", "score")


def join_dedup_key(s, d):
    """Records of the second catalogue whose normalised key isn't in the first."""
    b = table(s, d, "books_v1").select(X.short_key(F.coalesce("title", F.lit("")), F.coalesce("primary_author", F.lit(""))).alias("key")).distinct()
    name = F.coalesce(F.get(F.filter(F.transform("contributions", lambda c: c["author"]["name"]), lambda n: F.coalesce(F.trim(n), F.lit("")) != ""), F.lit(0)), F.lit(""))
    h = table(s, d, "hardcover_recent").select("id", X.short_key(F.coalesce("title", F.lit("")), name).alias("key")).distinct()
    return h.join(b, "key", "left_anti").select("id", "key")


def join_key_overlap(s, d):
    key = lambda c: X.alnum(F.coalesce(c, F.lit("")))
    a = table(s, d, "books_v1").select(key("title").alias("key")).where("key <> ''").distinct()
    b = table(s, d, "hardcover_recent").select(key("title").alias("key")).where("key <> ''").distinct()
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "key", "full").agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_overlap"))
    return both.withColumn("pct", F.round(F.col("n_overlap") * 100.0 / F.greatest("n_left", F.lit(1)), 6))


def union_all_corpora(s, d):
    b = table(s, d, "books_v1").select("book_id", "title", "source")
    h = table(s, d, "hardcover_recent").select(F.concat(F.lit("hc_"), F.col("id").cast("string")).alias("book_id"), "title").distinct()
    return b.unionByName(h.withColumn("source", F.lit("hardcover_recent")))


def _halves(s, d):
    """All tags, and new scores of the items with even ids."""
    old = t = tags_long(s, d)
    new = t.where("item_id % 2 = 0").select("item_id", "tag", F.round(F.col("score") + 1, 4).alias("score"))
    return old, new


def upsert_replace_by_key(s, d):
    return replace_groups(*_halves(s, d), "item_id")


def upsert_keep_last(s, d):
    return upsert_last(*_halves(s, d), ["item_id", "tag"])


def set_intersect_overlap(s, d):
    t = tags_long(s, d)
    a, b = t.where("item_id % 2 = 0").select("tag").distinct(), t.where("item_id % 2 = 1").select("tag").distinct()
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("even"))).unionByName(b.exceptAll(a).withColumn("side", F.lit("odd")))


def taxonomy_validate(s, d):
    """Source tags of the mapping that no item carries, and tags that the mapping doesn't know."""
    have, want = tags_long(s, d).select("tag").distinct(), curated(s).select("tag").distinct()
    return want.exceptAll(have).withColumn("problem", F.lit("unused")).unionByName(have.exceptAll(want).withColumn("problem", F.lit("unmapped")))


def _events(s, d):
    return table(s, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_id", "ts")


def dedup_keep_first(s, d):
    return keep_one(_events(s, d), ["user_id", "k"], ["ts", "event_id"]).select("user_id", "k", "event_id")


def dedup_keep_last(s, d):
    return keep_one(_events(s, d), ["user_id", "k"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "k", "event_id")


def agg_argmax_edition(s, d):
    return argmax_edition(items(s, d), "title", "popularity", "item_id").select("title", "item_id", "popularity")


QUERIES = {
    f.__name__: f
    for f in (
        join_semi_corpus, join_anti_rated, join_anti_tagged, join_anti_creator, join_anti_creator_set, join_lookup_map, topk_billing_dedup, join_chain_credits,
        agg_collect_ordered_list, join_mn_explode, join_dedup_key, join_key_overlap, union_all_corpora, upsert_replace_by_key, upsert_keep_last,
        set_intersect_overlap, taxonomy_validate, dedup_keep_first, dedup_keep_last, agg_argmax_edition,
    )
}

_CUR = "cur(curated, tag) AS (VALUES " + ", ".join(map(str, CURATED)) + ")"
_BILLED = """billed AS (SELECT film_id, person_id, CAST(row_number() OVER (PARTITION BY film_id ORDER BY ordering, person_id) AS INTEGER) AS rk
  FROM (SELECT film_id, person_id, min(ordering) AS ordering FROM credits GROUP BY 1, 2) QUALIFY rk <= 5)"""
_CL = "(CASE WHEN lower(trim(coalesce({0}, ''))) = 'nan' THEN '' ELSE trim(coalesce({0}, '')) END)"
_KEY = "concat(substr(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), 1, 20), '|', substr(regexp_replace(lower({1}), '[^a-z0-9]', '', 'g'), 1, 10))"
_EV = "ev AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, ts FROM events)"
_HALF = "o AS (SELECT * FROM tags), n AS (SELECT item_id, tag, round(score + 1, 4) AS score FROM tags WHERE item_id % 2 = 0)"
SQL = {
    "join_semi_corpus": with_(PROF) + "SELECT profile_id, item_id, rating FROM prof WHERE item_id IN (SELECT vec_id FROM embeddings)",
    "join_anti_rated": with_(PROF) + "SELECT vec_id AS item_id FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM prof WHERE profile_id = 1)",
    "join_anti_tagged": with_(ITEMS, TAGS) + "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM tags)",
    "join_anti_creator": f"WITH m AS (SELECT id, lower({_CL.format('director')}) AS who FROM movies) SELECT DISTINCT id, who FROM m WHERE who NOT IN (SELECT who FROM m WHERE who <> '' AND id IN (SELECT movie_id FROM ratings WHERE user_id = 1))",
    "join_anti_creator_set": f"""WITH t AS (SELECT tmdb_id, vote_count, unnest(list_transform(string_split({_CL.format('created_by')}, ','), lambda x: lower(trim(x)))) AS name FROM tv_corpus)
SELECT DISTINCT tmdb_id FROM tv_corpus WHERE tmdb_id NOT IN (SELECT tmdb_id FROM t WHERE name <> '' AND name IN (SELECT name FROM t WHERE vote_count >= 50))""",
    "join_lookup_map": with_(CREDITS) + "SELECT DISTINCT film_id, coalesce(s_name, '') AS person FROM credits LEFT JOIN supplier ON s_suppkey = person_id",
    "topk_billing_dedup": with_(CREDITS, _BILLED) + "SELECT film_id, person_id, rk FROM billed",
    "join_chain_credits": with_(CREDITS, _BILLED) + """SELECT o_orderkey AS film_id, coalesce(min_by(coalesce(s_name, ''), rk), '') AS director, coalesce(string_agg(coalesce(s_name, ''), ',' ORDER BY rk) FILTER (rk IS NOT NULL), '') AS cast_csv
FROM orders LEFT JOIN billed ON film_id = o_orderkey LEFT JOIN supplier ON s_suppkey = person_id GROUP BY 1""",
    "agg_collect_ordered_list": with_(CREDITS) + "SELECT film_id, string_agg(CAST(person_id AS VARCHAR), ',' ORDER BY ordering, person_id) AS names_csv FROM credits GROUP BY 1",
    "join_mn_explode": with_(TAGS, _CUR) + "SELECT item_id, curated, score FROM tags JOIN cur USING (tag)",
    "join_dedup_key": f"""WITH h AS (SELECT DISTINCT id, {_KEY.format("coalesce(title, '')", "coalesce(list_filter(list_transform(contributions, lambda c: c.author.name), lambda n: coalesce(trim(n), '') <> '')[1], '')")} AS key FROM hardcover_recent)
SELECT id, key FROM h WHERE key NOT IN (SELECT {_KEY.format("coalesce(title, '')", "coalesce(primary_author, '')")} FROM books_v1)""",
    "join_key_overlap": """WITH a AS (SELECT DISTINCT regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key FROM books_v1 WHERE key <> ''), b AS (SELECT DISTINCT regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key FROM hardcover_recent WHERE key <> '')
SELECT *, round(n_overlap * 100.0 / greatest(n_left, 1), 6) AS pct FROM (SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (key)) AS n_overlap)""",
    "union_all_corpora": "SELECT book_id, title, source FROM books_v1 UNION ALL SELECT DISTINCT concat('hc_', CAST(id AS VARCHAR)), title, 'hardcover_recent' FROM hardcover_recent",
    "upsert_replace_by_key": with_(TAGS, _HALF) + "SELECT * FROM o WHERE item_id NOT IN (SELECT item_id FROM n) UNION ALL SELECT * FROM n",
    "upsert_keep_last": with_(TAGS, _HALF) + "SELECT item_id, tag, coalesce(n.score, o.score) AS score FROM o FULL JOIN n USING (item_id, tag)",
    "set_intersect_overlap": with_(TAGS) + """SELECT tag, CASE WHEN e AND o THEN 'both' WHEN e THEN 'even' ELSE 'odd' END AS side
FROM (SELECT tag, bool_or(item_id % 2 = 0) AS e, bool_or(item_id % 2 = 1) AS o FROM tags GROUP BY 1)""",
    "taxonomy_validate": with_(TAGS, _CUR) + "SELECT DISTINCT tag, 'unused' AS problem FROM cur WHERE tag NOT IN (SELECT tag FROM tags) UNION ALL SELECT DISTINCT tag, 'unmapped' FROM tags WHERE tag NOT IN (SELECT tag FROM cur)",
    "dedup_keep_first": with_(_EV) + "SELECT user_id, k, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) = 1",
    "dedup_keep_last": with_(_EV) + "SELECT user_id, k, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) = 1",
    "agg_argmax_edition": with_(ITEMS) + "SELECT title, item_id, popularity FROM items QUALIFY row_number() OVER (PARTITION BY title ORDER BY popularity DESC, item_id) = 1",
}
