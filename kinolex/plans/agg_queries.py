"""Aggregates, histograms, tops per group."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinolex.operators.knn import exact_topk, weighted_vector
from kinolex.operators.relational import percent_rank_average, top_per_group
from kinolex.plans.adapters import ITEMS, PROF, TAGS, with_
from kinolex.plans.join_queries import _CUR, curated
from kinolex.sources.tables import items, ratings, table, tags_long, vec_items

PIVOT = [f"d{k}" for k in range(8)]


def _curated_max(s, d):
    return tags_long(s, d).join(F.broadcast(curated(s)), "tag").groupBy("item_id", F.col("curated").alias("tag")).agg(F.max("score").alias("score"))


def agg_max_by_group(s, d):
    return _curated_max(s, d)


def agg_pivot_mean(s, d):
    return tags_long(s, d).groupBy("item_id").pivot("tag", PIVOT).agg(F.round(F.avg("score"), 6)).na.fill(0.0)


def agg_count_size(s, d):
    n = tags_long(s, d).groupBy("item_id").count()
    return n.agg(F.min("count").alias("least"), F.round(F.avg("count"), 6).alias("mean"), F.max("count").alias("most"), F.count("*").alias("groups"))


def agg_nunique(s, d):
    return table(s, d, "ratings").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("movie_id").alias("films"))


def agg_value_counts_topn(s, d):
    """Most frequent cast members; films delivered twice count once."""
    m = table(s, d, "movies").select("id", F.explode("cast_names").alias("name")).distinct()
    return m.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(20)


def agg_quantiles(s, d):
    m = table(s, d, "movies").where("vote_count is not null").select("id", "vote_count", F.when(F.col("original_language") == "en", "en").otherwise("other").alias("grp")).distinct()
    both = m.withColumn("grp", F.lit("all")).unionByName(m)
    q = [F.round(F.percentile("vote_count", F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.75, 0.9, 0.95, 0.99)]
    return both.groupBy("grp").agg(*q)


def agg_median(s, d):
    return tags_long(s, d).groupBy("tag").agg(F.round(F.median("score"), 6).alias("median"))


def agg_coverage(s, d):
    cols = ["director", "studio", "poster_path", "overview", "release_year"]
    m = table(s, d, "movies").agg(*[F.round(F.avg(F.col(c).isNotNull().cast("int")) * 100, 6).alias(c) for c in cols])
    return m.unpivot([], cols, "field", "pct")


def agg_min_max(s, d):
    return table(s, d, "movies").groupBy("original_language").agg(F.min("release_year").alias("lo"), F.max("release_year").alias("hi"))


def _weights(s, d):
    return ratings(s, d).select("profile_id", F.col("item_id").alias("id"), (F.col("rating") - 3).alias("w"))


def agg_weighted_vector(s, d):
    v = vec_items(s, d).select(F.col("item_id").alias("id"), F.col("embedding").alias("v"))
    return weighted_vector(_weights(s, d), v).select("profile_id", "pos", F.round("value", 6).alias("value"))


def tag_profile(s, d):
    """Weights of tags by profile: sum of rating x score over the sum of ratings of the tagged items it likes."""
    liked = ratings(s, d).where("rating >= 3.5").join(tags_long(s, d).select("item_id").distinct(), "item_id", "left_semi")
    total = liked.groupBy("profile_id").agg(F.sum("rating").alias("total"))
    t = liked.join(tags_long(s, d), "item_id").groupBy("profile_id", "tag").agg(F.sum(F.col("rating") * F.col("score")).alias("w"))
    return t.join(total, "profile_id").select("profile_id", "tag", (F.col("w") / F.col("total")).alias("weight"))


def agg_weighted_tag_profile(s, d):
    t = tag_profile(s, d).withColumn("weight", F.round("weight", 6))
    return top_per_group(t, ["profile_id"], [F.desc("weight"), "tag"], 5)


def agg_mean_stderr(s, d):
    n = F.count("rating")
    return ratings(s, d).groupBy("profile_id").agg(
        F.round(F.avg("rating"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("rating") / F.sqrt(n), F.lit(0.0)), 6).alias("stderr"), n.alias("n")
    )


def topk_per_group_tags(s, d):
    return top_per_group(tags_long(s, d).where("score >= 0.15"), ["item_id"], [F.desc("score"), "tag"], 7)


def topk_per_group_genres(s, d):
    n = items(s, d).groupBy("maker", "genre").agg(F.count("*").alias("cnt"))
    return top_per_group(n, ["maker"], [F.desc("cnt"), "genre"], 3)


def rank_pct_average(s, d):
    return percent_rank_average(items(s, d), "popularity").select("item_id", F.round("pct", 6).alias("pct"))


def batching_ntile(s, d):
    """Batches of 15 in order of popularity: ranks within ranges of popularity plus the sizes of the ranges before."""
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    r = items(s, d).select("item_id", "popularity").repartitionByRange(parts, F.desc("popularity"), "item_id").withColumn("p", F.spark_partition_id())
    size = r.groupBy("p").agg(F.count("*").alias("n"))
    before = size.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("popularity"), "item_id"))
    return r.withColumn("own", own).join(F.broadcast(before), "p").select(F.floor((F.col("before") + F.col("own") - 1) / 15).alias("batch_no"), "item_id")


def sort_multi_key(s, d):
    return tags_long(s, d).orderBy("item_id", F.desc("score"), "tag")


def topn_popularity_baseline(s, d):
    """Fifty most popular items that a profile hasn't rated: inner products of one number each, rated items masked in the blocks."""
    r = ratings(s, d).select(F.col("profile_id").alias("query_id"), "item_id")
    pop = items(s, d).select(F.col("item_id").alias("id"), F.array(F.col("popularity").cast("double")).alias("v"))
    asked = r.select(F.col("query_id").alias("id")).distinct().withColumn("v", F.array(F.lit(1.0)))
    return exact_topk(pop, asked, 50, exclude=r).select(F.col("query_id").alias("profile_id"), "item_id", "rk")


QUERIES = {
    f.__name__: f
    for f in (
        agg_max_by_group, agg_pivot_mean, agg_count_size, agg_nunique, agg_value_counts_topn, agg_quantiles, agg_median, agg_coverage, agg_min_max, agg_weighted_vector,
        agg_weighted_tag_profile, agg_mean_stderr, topk_per_group_tags, topk_per_group_genres, rank_pct_average, batching_ntile, sort_multi_key, topn_popularity_baseline,
    )
}

_TP = """liked AS (SELECT * FROM prof WHERE rating >= 3.5 AND item_id IN (SELECT item_id FROM tags)),
tp AS (SELECT l.profile_id, tag, sum(rating * score) / any_value(total) AS weight FROM liked l JOIN tags USING (item_id)
  JOIN (SELECT profile_id, sum(rating) AS total FROM liked GROUP BY 1) x ON x.profile_id = l.profile_id GROUP BY 1, 2)"""
SQL = {
    "agg_max_by_group": with_(TAGS, _CUR) + "SELECT item_id, curated AS tag, max(score) AS score FROM tags JOIN cur USING (tag) GROUP BY 1, 2",
    "agg_pivot_mean": with_(TAGS) + "SELECT item_id, " + ", ".join(f"coalesce(round(avg(score) FILTER (tag = '{t}'), 6), 0) AS {t}" for t in PIVOT) + " FROM tags GROUP BY 1",
    "agg_count_size": with_(TAGS) + "SELECT min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most, count(*) AS groups FROM (SELECT count(*) AS n FROM tags GROUP BY item_id)",
    "agg_nunique": "SELECT count(DISTINCT user_id) AS users, count(DISTINCT movie_id) AS films FROM ratings",
    "agg_value_counts_topn": "SELECT name, count(*) AS n FROM (SELECT DISTINCT id, name FROM (SELECT id, unnest(cast_names) AS name FROM movies)) GROUP BY 1 ORDER BY n DESC, name LIMIT 20",
    "agg_quantiles": """WITH m AS (SELECT DISTINCT id, vote_count, CASE WHEN original_language = 'en' THEN 'en' ELSE 'other' END AS grp FROM movies WHERE vote_count IS NOT NULL)
SELECT grp, """ + ", ".join(f"round(quantile_cont(vote_count, {p}), 6) AS p{int(p * 100)}" for p in (0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM (SELECT 'all' AS grp, vote_count FROM m UNION ALL SELECT grp, vote_count FROM m) GROUP BY 1",
    "agg_median": with_(TAGS) + "SELECT tag, round(median(score), 6) AS median FROM tags GROUP BY 1",
    "agg_coverage": " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) * 100, 6) AS pct FROM movies" for c in ("director", "studio", "poster_path", "overview", "release_year")),
    "agg_min_max": "SELECT original_language, min(release_year) AS lo, max(release_year) AS hi FROM movies GROUP BY 1",
    "agg_weighted_vector": with_(PROF) + """, s AS (SELECT profile_id, pos - 1 AS pos, sum((rating - 3) * x) / sum(abs(rating - 3)) AS value FROM (
  SELECT profile_id, rating, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM prof JOIN embeddings ON vec_id = item_id WHERE rating <> 3) GROUP BY 1, 2)
SELECT profile_id, CAST(pos AS INTEGER) AS pos, round(value / sqrt(sum(value * value) OVER (PARTITION BY profile_id)), 6) AS value FROM s""",
    "agg_weighted_tag_profile": with_(PROF, TAGS, _TP) + "SELECT profile_id, tag, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY round(weight, 6) DESC, tag) AS INTEGER) AS rk FROM tp QUALIFY rk <= 5",
    "agg_mean_stderr": with_(PROF) + "SELECT profile_id, round(avg(rating), 6) AS mean, round(coalesce(stddev_samp(rating) / sqrt(count(*)), 0), 6) AS stderr, count(*) AS n FROM prof GROUP BY 1",
    "topk_per_group_tags": with_(TAGS) + "SELECT item_id, tag, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tag) AS INTEGER) AS rk FROM tags WHERE score >= 0.15 QUALIFY rk <= 7",
    "topk_per_group_genres": with_(ITEMS) + "SELECT maker, genre, cnt, CAST(row_number() OVER (PARTITION BY maker ORDER BY cnt DESC, genre) AS INTEGER) AS rk FROM (SELECT maker, genre, count(*) AS cnt FROM items GROUP BY 1, 2) QUALIFY rk <= 3",
    "rank_pct_average": with_(ITEMS) + "SELECT item_id, round((rank() OVER (ORDER BY popularity) + (count(*) OVER (PARTITION BY popularity) - 1) / 2.0) / count(*) OVER (), 6) AS pct FROM items",
    "batching_ntile": with_(ITEMS) + "SELECT CAST((row_number() OVER (ORDER BY popularity DESC, item_id) - 1) // 15 AS BIGINT) AS batch_no, item_id FROM items",
    "sort_multi_key": with_(TAGS) + "SELECT item_id, tag, score FROM tags ORDER BY item_id, score DESC, tag",
    "topn_popularity_baseline": with_(ITEMS, PROF) + """SELECT profile_id, item_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY popularity DESC, item_id) AS INTEGER) AS rk
FROM (SELECT DISTINCT profile_id FROM prof) p, items i WHERE NOT EXISTS (SELECT 1 FROM prof r WHERE r.profile_id = p.profile_id AND r.item_id = i.item_id) QUALIFY rk <= 50""",
}
