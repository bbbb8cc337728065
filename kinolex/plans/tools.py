"""The parameterised builders of the query API, for every medium: what a user asks with, as functions of plans.

TOOLS names them with their parameters. All take (spark, folder, medium, ...) and return a DataFrame; those with a
profile leave out what it has rated. Thresholds, limits and weights are parameters.
"""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolex.functions import text as X
from kinolex.operators.knn import dot, exact_topk
from kinolex.operators.rank import round_robin
from kinolex.operators.relational import keep_one, top_per_group
from kinolex.operators.search import contains
from kinolex.operators.skew import split_join
from kinolex.session import cut
from kinolex.sources.catalogues import catalogue, rated, sql_views, unit_vectors

LIKED = 3.5
# Words that titles share without being alike.
STOP = ("the", "and", "with", "from", "part")


def _narrowed(cat: DataFrame, floor: int = 0, years: tuple = (None, None), language: str | None = None) -> DataFrame:
    """Rows that pass the optional bounds; a missing value fails a bound that is given."""
    cond = F.col("popularity") >= floor
    if years[0] is not None:
        cond = cond & (F.col("year") >= years[0])
    if years[1] is not None:
        cond = cond & (F.col("year") <= years[1])
    if language is not None:
        cond = cond & (F.col("lang") == language)
    return cat.where(cond)


def _without_known_makers(cand: DataFrame, r: DataFrame, cat: DataFrame) -> DataFrame:
    """Candidates (profile_id, item_id, ...) of makers of whom the profile has rated nothing."""
    makers = cat.select("item_id", F.explode("makers").alias("maker"))
    known = r.join(makers, "item_id").select("profile_id", "maker").distinct()
    met = cand.select("profile_id", "item_id").distinct().join(makers, "item_id").join(known, ["profile_id", "maker"])
    return cand.join(met.select("profile_id", "item_id").distinct(), ["profile_id", "item_id"], "left_anti")


def neighbours(s: SparkSession, d: str, medium: str, anchors: DataFrame, pool: int) -> DataFrame:
    """(anchor_id, item_id, sim): the pool of nearest items of each distinct anchor (anchor_id), itself included; exact, to nine decimals."""
    v = unit_vectors(s, d, medium)
    names = v.select("vec_id", "item_id")
    q = v.join(anchors.select(F.col("anchor_id").alias("item_id")).distinct(), "item_id", "left_semi").select(F.col("vec_id").alias("id"), "v")
    near = exact_topk(v.select(F.col("vec_id").alias("id"), "v"), q, pool, digits=9).select("query_id", F.col("item_id").alias("vec_id"), "sim")
    near = near.join(names, "vec_id").drop("vec_id")
    return near.join(names.toDF("query_id", "anchor_id"), "query_id").select("anchor_id", "item_id", "sim")


def candidates(s: SparkSession, d: str, medium: str, liked: DataFrame | None = None, pool: int = 100, floor: int = 0, years: tuple = (None, None), language: str | None = None, known_makers: bool = True) -> DataFrame:
    """(profile_id, anchor_order, anchor_id, item_id, sim): what the neighbours of liked items offer.

    liked: profile_id, anchor_order, anchor_id; by default all that is rated at least LIKED, best first. Rated items,
    the anchors themselves and, unless ``known_makers``, other works of their makers are left out after the pool.
    """
    r, cat = rated(s, d, medium), catalogue(s, d, medium)
    if liked is None:
        liked = r.where(F.col("rating") >= LIKED).select("profile_id", F.col("rating").alias("anchor_order"), F.col("item_id").alias("anchor_id"))
    near = neighbours(s, d, medium, liked, pool).join(_narrowed(cat, floor, years, language).select("item_id"), "item_id", "left_semi")
    cand = split_join(liked, near, ["anchor_id"], ["profile_id"]).select("profile_id", "anchor_order", "anchor_id", "item_id", "sim")
    taken = r.select("profile_id", "item_id").unionByName(liked.select("profile_id", F.col("anchor_id").alias("item_id"))).distinct()
    cand = cut(cand.join(taken, ["profile_id", "item_id"], "left_anti"))
    return cand if known_makers else _without_known_makers(cand, r, cat)


def with_score(s: SparkSession, d: str, medium: str, cand: DataFrame, penalty: float = 0.0, genre_weight: float = 0.0) -> DataFrame:
    """Adds score: the similarity, mixed with the cosine of genres and the profile's, less ``penalty`` for a title that shares a word with its anchor's."""
    cat = catalogue(s, d, medium)
    score = F.col("sim")
    if genre_weight:
        w = rated(s, d, medium).join(cat.select("item_id", F.explode("genres").alias("genre")), "item_id").groupBy("profile_id", "genre").agg(F.sum(F.col("rating") - 3).alias("w"))
        length = w.groupBy("profile_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("pn"))
        genres = cat.select("item_id", F.size("genres").alias("g"), F.explode("genres").alias("genre"))
        cos = cand.select("profile_id", "item_id").distinct().join(genres, "item_id").join(w, ["profile_id", "genre"], "left")
        cos = cos.groupBy("profile_id", "item_id", "g").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("in_common"))
        cos = cos.join(length, "profile_id").where("pn > 0").select("profile_id", "item_id", (F.col("in_common") / (F.col("pn") * F.sqrt("g"))).alias("cos"))
        cand = cand.join(cos, ["profile_id", "item_id"], "left")
        score = F.when(F.col("cos").isNotNull(), (1 - genre_weight) * score + genre_weight * F.col("cos")).otherwise(score)
    if penalty:
        words = cat.select("item_id", X.title_tokens(F.col("title"), STOP).alias("_words"))
        cand = cand.join(words, "item_id", "left").join(words.toDF("anchor_id", "_anchor"), "anchor_id", "left")
        alike = F.arrays_overlap("_words", "_anchor")
        score = score - F.when(alike, penalty).otherwise(0.0)
    return cand.withColumn("score", F.round(score, 9)).drop("cos", "_words", "_anchor")


def recommend(s: SparkSession, d: str, medium: str, liked: DataFrame | None = None, pool: int = 100, floor: int = 0, years: tuple = (None, None), language: str | None = None,
              penalty: float = 0.0, genre_weight: float = 0.0, one_per_work: bool = False, known_makers: bool = False, per: int = 2, n: int = 20) -> DataFrame:
    """(profile_id, pick_no, item_id, anchor_id): the picks of every profile, liked items taking turns."""
    cand = candidates(s, d, medium, liked, pool, floor, years, language, known_makers)
    cand = with_score(s, d, medium, cand, penalty, genre_weight)
    if one_per_work:
        return round_robin(cand.join(catalogue(s, d, medium).select("item_id", "work"), "item_id"), per, n)
    return round_robin(cand.withColumn("work", F.lit(None).cast("string")), per, n)


def resolved(s: SparkSession, d: str, medium: str, profile: int, titles: list[str], each: bool) -> DataFrame:
    """(profile_id, anchor_order, anchor_id): the item with a vector meant by each title.

    First what the profile has rated best among titles that contain the wanted one or are contained in it; else the most
    popular of the catalogue whose title contains it: for each title by itself, or only if none was found (``each``).
    """
    want = F.broadcast(s.createDataFrame([(k, t.lower()) for k, t in enumerate(titles)], "pos int, q string"))  # the user's few titles
    cat = catalogue(s, d, medium).where("title <> ''").select("item_id", F.lower("title").alias("t"), "popularity").join(unit_vectors(s, d, medium).select("item_id"), "item_id", "left_semi")
    own = rated(s, d, medium).where(F.col("profile_id") == profile).join(cat, "item_id")
    own = own.join(want, F.contains(F.col("t"), F.col("q")) | F.contains(F.col("q"), F.col("t"))).groupBy("pos").agg(F.min(F.struct(-F.col("rating"), "item_id")).getField("item_id").alias("anchor_id"))
    other = cat.join(want, F.contains(F.col("t"), F.col("q"))).groupBy("pos").agg(F.min(F.struct((-F.col("popularity")).alias("less"), "item_id")).getField("item_id").alias("anchor_id"))
    other = other.join(own.select("pos"), "pos", "left_anti") if each else other.join(own.agg(F.count("*").alias("found")).where("found = 0"), F.lit(True)).drop("found")
    found = own.unionByName(other)
    return found.groupBy("anchor_id").agg(F.min("pos").alias("pos")).select(F.lit(profile).cast("bigint").alias("profile_id"), (-F.col("pos")).cast("double").alias("anchor_order"), "anchor_id")


def get_recommendations(s: SparkSession, d: str, medium: str, profile: int, titles: list[str] = (), n: int = 15, years: tuple = (None, None), language: str | None = None, floor: int = 0) -> DataFrame:
    """Picks for one profile, from the titles it names or else from all it likes."""
    liked = resolved(s, d, medium, profile, list(titles), each=medium != "book") if titles else None
    if liked is None:
        liked = rated(s, d, medium).where((F.col("profile_id") == profile) & (F.col("rating") >= LIKED)).select("profile_id", F.col("rating").alias("anchor_order"), F.col("item_id").alias("anchor_id"))
    return recommend(s, d, medium, liked, 150 if medium == "book" else 200, floor, years, language, one_per_work=medium == "book", known_makers=True, n=n)


def search_user_ratings(s: SparkSession, d: str, medium: str, profile: int, query: str = "", least: float = 0.5, most: float = 5.0, like: str | None = None, limit: int = 20) -> DataFrame:
    """What a profile has rated within bounds, with the query in its title, best first; with ``like`` by similarity to that item."""
    r = rated(s, d, medium).where((F.col("profile_id") == profile) & F.col("rating").between(least, most)).join(catalogue(s, d, medium).select("item_id", "title", "year"), "item_id").where(contains(F.col("title"), query))
    key = F.col("rating")
    if like is not None:
        v = unit_vectors(s, d, medium)
        q = v.where(F.col("item_id") == like).select(F.col("v").alias("q"))  # one vector
        r = r.join(v.join(F.broadcast(q)).select("item_id", F.round(dot("v", "q"), 9).alias("relevance")), "item_id")
        key = F.col("relevance")
    return r.orderBy(F.desc(key), F.desc("rating"), "item_id").limit(limit).select("item_id", "title", "year", "rating", key.alias("rank_by"))


def search_catalog(s: SparkSession, d: str, medium: str, profile: int, query: str, years: tuple = (None, None), language: str | None = None, floor: int = 0, limit: int = 15) -> DataFrame:
    """The most popular unrated items with the query in the title or a maker's name."""
    hit = contains(F.col("title"), query) | F.exists("makers", lambda m: contains(m, query))
    return _top(_unrated(s, d, medium, profile, _narrowed(catalogue(s, d, medium), floor, years, language).where(hit)), limit)


def search_by_people(s: SparkSession, d: str, medium: str, profile: int, name: str, role: str = "any", limit: int = 25, floor: int = 0) -> DataFrame:
    """Unrated items made by, or with, somebody whose name contains ``name``; role is any, director or actor."""
    cat = _narrowed(catalogue(s, d, medium), floor).withColumn("directs", F.exists("makers", lambda m: contains(m, name))).withColumn("plays", F.exists("people", lambda p: contains(p, name)))
    wanted = {"any": F.col("directs") | F.col("plays"), "director": F.col("directs"), "actor": F.col("plays")}[role]
    told = F.when(F.col("directs") & F.col("plays"), "both").when(F.col("directs"), "director").otherwise("actor")
    return _top(_unrated(s, d, medium, profile, cat.where(wanted).withColumn("role", told)), limit, "role")


def search_by_studio(s: SparkSession, d: str, medium: str, profile: int, studio: str, years: tuple = (None, None), limit: int = 15, floor: int = 0) -> DataFrame:
    return _top(_unrated(s, d, medium, profile, _narrowed(catalogue(s, d, medium), floor, years).where(contains(F.col("studio"), studio))), limit)


def search_catalog_semantic(s: SparkSession, d: str, medium: str, profile: int, like: str, pool: int = 200, floor: int = 0, years: tuple = (None, None), language: str | None = None, limit: int = 15) -> DataFrame:
    """The items most like item ``like``: its pool without what is rated, known makers and unpopular ones; one per work, chosen before year and language count."""
    anchor = s.createDataFrame([(profile, 0.0, like)], "profile_id bigint, anchor_order double, anchor_id string")
    cand = candidates(s, d, medium, anchor, pool, floor, known_makers=False)
    work = F.coalesce(F.concat(F.lit("w"), "work"), F.concat(F.lit("i"), "item_id"))
    one = keep_one(cand.join(catalogue(s, d, medium).select("item_id", "work"), "item_id").withColumn("_w", work), ["_w"], [F.desc("sim"), "item_id"])
    one = one.join(_narrowed(catalogue(s, d, medium), floor, years, language).select("item_id"), "item_id", "left_semi")
    return top_per_group(one, ["profile_id"], [F.desc("sim"), "item_id"], limit).select("item_id", "sim", "rk")


def search_by_tags(s: SparkSession, d: str, medium: str, profile: int, positive: list[str], negative: list[str] = (), floor: int = 0, years: tuple = (None, None), limit: int = 15) -> DataFrame:
    """Tagged items by wanted less unwanted tags (genres), with their first five tags; wanted tags nobody has are told as ``unknown``."""
    cat = catalogue(s, d, medium).where(F.size("genres") > 0)
    asked = F.broadcast(s.createDataFrame([(t.lower(),) for t in [*positive, *negative]], "tag string").distinct())  # the user's few tags
    met = cat.select(F.explode("genres").alias("tag")).join(asked, "tag").distinct()
    unknown = asked.join(met, "tag", "left_anti").agg(F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("unknown"))
    has = lambda tags: F.size(F.array_intersect("genres", F.array(*[F.lit(t.lower()) for t in tags]).cast("array<string>")))
    left = _narrowed(cat.withColumn("tag_score", has(positive) - has(negative)), floor, years)
    left = _without_known_makers(_unrated(s, d, medium, profile, left).withColumn("profile_id", F.lit(profile).cast("bigint")), rated(s, d, medium).where(F.col("profile_id") == profile), catalogue(s, d, medium))
    top = left.orderBy(F.desc("tag_score"), F.desc("popularity"), "item_id").limit(limit)
    return top.join(F.broadcast(unknown), F.lit(True)).select("item_id", "tag_score", F.array_join(F.slice("genres", 1, 5), ", ").alias("tags"), "unknown")


def _unrated(s: SparkSession, d: str, medium: str, profile: int, cat: DataFrame) -> DataFrame:
    return cat.join(rated(s, d, medium).where(F.col("profile_id") == profile).select("item_id"), "item_id", "left_anti")


def _top(cat: DataFrame, limit: int, *more: str) -> DataFrame:
    return cat.orderBy(F.desc("popularity"), "item_id").limit(limit).select("item_id", "popularity", *more)


def _parameters(f) -> dict[str, str]:
    return {k: p.annotation for k, p in inspect.signature(f).parameters.items() if k not in ("s", "d")}


_FOR_ALL = (search_user_ratings, get_recommendations, search_catalog, search_catalog_semantic, search_by_tags)
TOOLS = {f.__name__: (f, _parameters(f)) for f in (*_FOR_ALL, search_by_people, search_by_studio)}
MEDIA_OF = {"book": [f.__name__ for f in _FOR_ALL], "series": [f.__name__ for f in _FOR_ALL], "film": list(TOOLS)}


# The same in DuckDB's SQL.
def sql_with(medium: str, *views: str) -> str:
    """The views of a medium and more; the last may go on with the statement itself."""
    return "WITH RECURSIVE " + ",\n".join((sql_views(medium), *views)) + "\n"


def sql_near(where: str, pool: int) -> str:
    return f"""near AS MATERIALIZED (SELECT anchor_id, item_id, sim FROM (SELECT a.item_id AS anchor_id, b.item_id, b.vec_id, round(list_dot_product(a.v, b.v), 9) AS sim FROM vec a, vec b WHERE a.item_id IN ({where}))
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY sim DESC, vec_id) <= {pool})"""


SQL_LIKED = f"liked AS (SELECT profile_id, rating AS anchor_order, item_id AS anchor_id FROM prof WHERE rating >= {LIKED})"


def sql_candidates(pool: int, floor: int, known_makers: bool, more: str = "") -> str:
    known = "" if known_makers else """ AND NOT EXISTS (SELECT 1 FROM known k WHERE k.profile_id = l.profile_id AND list_contains(c.makers, k.maker))"""
    return ",\n".join((
        sql_near("SELECT anchor_id FROM liked", pool), "known AS MATERIALIZED (SELECT DISTINCT profile_id, unnest(makers) AS maker FROM prof JOIN cat USING (item_id))",
        f"""cand AS MATERIALIZED (SELECT l.profile_id, anchor_order, l.anchor_id, n.item_id, sim, title, genres, makers, work FROM liked l JOIN near n USING (anchor_id) JOIN cat c USING (item_id) WHERE popularity >= {floor}{more}
  AND NOT EXISTS (SELECT 1 FROM prof r WHERE r.profile_id = l.profile_id AND r.item_id = n.item_id) AND NOT EXISTS (SELECT 1 FROM liked r WHERE r.profile_id = l.profile_id AND r.anchor_id = n.item_id){known})""",
    ))


_SQL_TOKENS = "list_filter(string_split_regex(regexp_replace(regexp_replace(lower({0}), '[:-]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: len(w) >= 3 AND w NOT IN ('the', 'and', 'with', 'from', 'part'))"


def sql_scored(penalty: float = 0.0, genre_weight: float = 0.0) -> str:
    tokens = f"list_has_any({_SQL_TOKENS.format('cand.title')}, {_SQL_TOKENS.format('''coalesce(t.title, '')''')})"
    score = f"CASE WHEN cos IS NOT NULL THEN {1 - genre_weight} * sim + {genre_weight} * cos ELSE sim END" if genre_weight else "sim"
    return f"""gw AS (SELECT profile_id, genre, sum(rating - 3) AS w FROM (SELECT profile_id, rating, unnest(genres) AS genre FROM prof JOIN cat USING (item_id)) GROUP BY 1, 2),
pn AS (SELECT profile_id, sqrt(sum(w * w)) AS pn FROM gw GROUP BY 1),
cs AS (SELECT profile_id, item_id, sum(coalesce(w, 0)) / (any_value(pn) * sqrt(any_value(g))) AS cos FROM (SELECT DISTINCT profile_id, item_id, len(genres) AS g, unnest(genres) AS genre FROM cand) LEFT JOIN gw USING (profile_id, genre) JOIN pn USING (profile_id) WHERE pn > 0 GROUP BY 1, 2),
scored AS (SELECT cand.profile_id, anchor_order, anchor_id, cand.item_id, cand.work, round({score} - CASE WHEN {tokens} THEN {penalty} ELSE 0 END, 9) AS score
  FROM cand LEFT JOIN cat t ON t.item_id = cand.anchor_id LEFT JOIN cs ON cs.profile_id = cand.profile_id AND cs.item_id = cand.item_id)"""


def sql_robin(n: int, per: int = 2, one_per_work: bool = False) -> str:
    """The fold slot by slot; ends at n picks or when a whole turn adds none."""
    work = "work" if one_per_work else "CAST(NULL AS VARCHAR)"
    return f"""q AS (SELECT profile_id, anchor_order, anchor_id, list(struct_pack(i := item_id, w := coalesce({work}, 'item ' || item_id)) ORDER BY score DESC, item_id) AS items FROM scored GROUP BY ALL),
qs AS (SELECT profile_id, list(struct_pack(a := anchor_id, items := items) ORDER BY anchor_order DESC, anchor_id) AS qs FROM q GROUP BY 1),
fold(profile_id, slot, idle, st, ws, an) AS (
  SELECT profile_id, 0, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM qs
  UNION ALL
  SELECT profile_id, slot + 1, CASE WHEN f IS NULL THEN idle + 1 ELSE 0 END, CASE WHEN f IS NULL THEN st ELSE list_append(st, f.i) END, CASE WHEN f IS NULL THEN ws ELSE list_append(ws, f.w) END, CASE WHEN f IS NULL THEN an ELSE list_append(an, a) END FROM (
    SELECT fold.profile_id, slot, idle, st, ws, an, qs[(slot // {per}) % len(qs) + 1].a AS a, list_filter(qs[(slot // {per}) % len(qs) + 1].items, lambda x: NOT list_contains(st, x.i) AND NOT list_contains(ws, x.w))[1] AS f
    FROM fold JOIN qs ON qs.profile_id = fold.profile_id WHERE len(st) < {n} AND idle < len(qs) * {per}))
SELECT profile_id, CAST(generate_subscripts(st, 1) AS INTEGER) AS pick_no, unnest(st) AS item_id, unnest(an) AS anchor_id FROM (SELECT profile_id, st, an FROM fold QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY slot DESC) = 1)"""


def sql_resolved(profile: int, titles: list[str], each: bool) -> str:
    want = ", ".join(f"({k}, '{t.lower()}')" for k, t in enumerate(titles))
    fallback = "pos NOT IN (SELECT pos FROM own)" if each else "NOT EXISTS (SELECT 1 FROM own)"
    return f"""want(pos, q) AS (VALUES {want}),
own AS (SELECT pos, item_id AS anchor_id FROM prof JOIN cat USING (item_id) JOIN want ON contains(lower(title), q) OR contains(q, lower(title)) WHERE profile_id = {profile} AND title <> '' AND item_id IN (SELECT item_id FROM vec) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY rating DESC, item_id) = 1),
other AS (SELECT pos, item_id AS anchor_id FROM cat JOIN want ON contains(lower(title), q) WHERE title <> '' AND item_id IN (SELECT item_id FROM vec) AND {fallback} QUALIFY row_number() OVER (PARTITION BY pos ORDER BY popularity DESC, item_id) = 1),
liked AS (SELECT CAST({profile} AS BIGINT) AS profile_id, CAST(-min(pos) AS DOUBLE) AS anchor_order, anchor_id FROM (SELECT * FROM own UNION ALL SELECT * FROM other) GROUP BY anchor_id)"""
