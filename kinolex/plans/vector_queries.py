"""Nearest neighbours, tag vectors and rankings of profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinolex.functions import text as X
from kinolex.operators.knn import as_vectors, dot, exact_topk, norm, weighted_vector
from kinolex.operators.pools import Lists, about, by_slices, groups, half_up, store_lists
from kinolex.operators.relational import top_per_group
from kinolex.operators.skew import split_join
from kinolex.plans.adapters import ITEMS, PROF, TAGS, VECS, with_
from kinolex.plans.agg_queries import _TP, _weights, tag_profile
from kinolex.plans import tools as T
from kinolex.session import compact, stored
from kinolex.sources.catalogues import unit_vectors
from kinolex.sources.tables import items, ratings, tags_long, vec_items

POOL = 100
# The query sets of searches: the ledger's first twenty ids, and every fiftieth id, which grows with the collection.
FIRST, EVERY_50 = "{0} < 20", "{0} % 50 = 0"
# Words that titles share without being alike.
STOP = ("the", "and", "with", "from", "part")


def corpus(s, d):
    return vec_items(s, d).select(F.col("item_id").alias("id"), F.col("embedding").alias("v"))


def liked(s, d):
    """Liked items of each profile that have a vector."""
    r = ratings(s, d).where("rating >= 3.5").join(vec_items(s, d).select("item_id"), "item_id", "left_semi")
    return r.select("profile_id", F.col("item_id").alias("anchor_id"), "rating")


def anchors_near(s, d, pool=POOL):
    """(profile_id, anchor_id, item_id, sim, rk): the pool of each liked item. Each anchor is searched once, whoever likes it."""
    l = liked(s, d)
    q = corpus(s, d).join(l.select(F.col("anchor_id").alias("id")).distinct(), "id", "left_semi")
    near = exact_topk(corpus(s, d), q, pool).withColumnRenamed("query_id", "anchor_id")
    return split_join(l.select("profile_id", "anchor_id"), near, ["anchor_id"], ["profile_id"])


def unrated(df, s, d):
    return df.join(ratings(s, d).select("profile_id", "item_id"), ["profile_id", "item_id"], "left_anti")


def knn_topk(s, d, seeds=FIRST):
    near = exact_topk(corpus(s, d), corpus(s, d).where(seeds.format("id")), 10)
    return near.select(F.col("query_id").alias("anchor_id"), "item_id", F.round("sim", 6).alias("sim"), "rk")


def knn_exclude_self(s, d, seeds=FIRST):
    near = exact_topk(corpus(s, d), corpus(s, d).where(seeds.format("id")), 10, skip_self=True)
    return near.select(F.col("query_id").alias("anchor_id"), "item_id", F.round("sim", 6).alias("sim"), "rk")


def knn_taste_vector(s, d):
    """Twenty unrated items nearest to each profile's taste vector; what a profile has rated is masked in the blocks."""
    taste = as_vectors(weighted_vector(_weights(s, d), corpus(s, d)), "profile_id").select(F.col("profile_id").alias("id"), "v")
    rated = ratings(s, d).select(F.col("profile_id").alias("query_id"), "item_id")
    near = exact_topk(corpus(s, d).select("id", F.transform("v", lambda x: x.cast("double")).alias("v")), taste, 20, exclude=rated)
    return near.select(F.col("query_id").alias("profile_id"), "item_id", F.round("sim", 6).alias("sim"), "rk")


def knn_anchor_max(s, d, floor=5):
    """Unrated films of every profile by their closest liked film, above a popularity floor."""
    best = T.candidates(s, d, "film", floor=floor).groupBy("profile_id", "item_id").agg(F.max("sim").alias("score"))
    return top_per_group(best, ["profile_id"], [F.desc("score"), "item_id"], 50).select("profile_id", "item_id", "score", "rk")


def rank_profile_by_query(s, d):
    """A profile's rated items by similarity to the vector of item 200."""
    q = corpus(s, d).where("id = 200").select(F.col("v").alias("q"))
    v = corpus(s, d).join(F.broadcast(q)).select(F.col("id").alias("item_id"), dot("v", "q").alias("sim"))
    r = ratings(s, d).select("profile_id", "item_id").join(v, "item_id")
    return top_per_group(r, ["profile_id"], [F.desc("sim"), "item_id"], 8).select("profile_id", "item_id", F.round("sim", 3).alias("relevance"), "rk")


def _first_book(s, d):
    """The book of the smallest vec_id, as an example of a query."""
    return unit_vectors(s, d, "book").agg(F.min_by("item_id", "vec_id").alias("i")).first().i or ""


def semantic_search_filtered(s, d):
    """Profile 1's search for books like one: pool of 200, known authors and rated left out, one per work, from 1960 on."""
    return T.search_catalog_semantic(s, d, "book", 1, _first_book(s, d), floor=10, years=(1960, 2030))


def intra_list_diversity(s, d, seeds=FIRST):
    """One minus the mean similarity of all pairs in each list: from the length of the sum of its vectors, without pairs."""
    near = exact_topk(corpus(s, d), corpus(s, d).where(seeds.format("id")), 10, skip_self=True)
    cells = near.join(corpus(s, d), near.item_id == F.col("id")).select("query_id", F.posexplode("v").alias("pos", "x"))
    sums = cells.groupBy("query_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("t"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("own"), F.count("*").alias("n"))
    ild = sums.groupBy("query_id").agg(F.sum(F.col("t") * F.col("t") - F.col("own")).alias("pairs"), F.max("n").alias("n"))
    return ild.where("n > 1").select(F.col("query_id").alias("anchor_id"), F.round(1 - F.col("pairs") / (F.col("n") * (F.col("n") - 1)), 6).alias("ild"))


def tag_neighbours(s, d, seeds, k=10):
    """Nearest items by the cosine of their tag vectors, seeds left out; items that share no tag don't come."""
    t = tags_long(s, d)
    n = t.groupBy("item_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("n")).where("n > 0")
    a = t.where(seeds).join(n, "item_id").select("item_id", "tag", (F.col("score") / F.col("n")).alias("a"))
    b = t.join(n, "item_id").select(F.col("item_id").alias("other_id"), "tag", (F.col("score") / F.col("n")).alias("b"))
    sim = a.join(b, "tag").where("item_id <> other_id").groupBy("item_id", "other_id").agg(F.round(F.sum(F.col("a") * F.col("b")), 9).alias("cos"))
    return top_per_group(sim, ["item_id"], [F.desc("cos"), "other_id"], k)


def tag_cosine_topk(s, d, seeds=FIRST):
    return tag_neighbours(s, d, F.expr(seeds.format("item_id"))).select("item_id", "other_id", F.round("cos", 6).alias("cos"), "rk")


def _reranked(lists: str, tagged: str):
    """(profile_id, item_id, adj_sim) of a slice of profiles from its ratings; see tag_rerank."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        profile, item, stars = t.column("profile_id"), t.column("item_id").to_numpy(), t.column("rating").to_numpy()
        likes = stars >= 3.5
        near = Lists(lists, np.unique(item[likes]))
        items = np.unique(np.concatenate([near.items, item]))
        local = np.searchsorted(items, near.items)
        tags = about(tagged, "item_id", items)
        whose = np.searchsorted(items, tags.column("item_id").to_numpy()) if tags.num_rows else np.zeros(0, np.int64)
        names, code = np.unique(tags.column("tag").to_numpy().astype(str), return_inverse=True) if tags.num_rows else (np.zeros(0, str), whose)
        score = tags.column("score").to_numpy() if tags.num_rows else np.zeros(0)
        order = np.argsort(whose, kind="stable")
        whose, code, score = whose[order], code[order], score[order]
        start = np.searchsorted(whose, np.arange(len(items) + 1))
        tn = np.sqrt(np.bincount(whose, score * score, len(items)))

        def tags_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = start[at + 1] - start[at]
            return np.repeat(np.arange(len(at)), n), np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())

        best, known = np.full(len(items), -np.inf), np.zeros(len(items), bool)
        for g in groups(profile):
            own, p = item[g], profile[g.start].as_py()
            at, liked = np.searchsorted(items, own), likes[g]
            _, pool = near.rows(own[liked])
            if not len(pool):
                continue
            seen = local[pool]
            np.maximum.at(best, seen, near.sims[pool])
            known[at] = p is not None
            some = np.flatnonzero((best > -np.inf) & ~known)
            of, tag = tags_of(at[liked])
            rated = stars[g][liked]
            total = rated[np.unique(of)].sum()
            weight = np.bincount(code[tag], rated[of] * score[tag], len(names)) / total if p is not None and total else np.zeros(len(names))
            pn = np.sqrt((weight * weight).sum())
            sim, length = best[some], tn[some]
            mixed = (pn > 0) & (length > 0)
            of, tag = tags_of(some)
            cos = np.divide(np.bincount(of, score[tag] * weight[code[tag]], len(some)), pn * length, out=np.zeros(len(some)), where=mixed)
            adj = half_up(np.where(mixed, 0.7 * sim + 0.3 * cos, sim), 6)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()).take(pa.array(np.zeros(len(some), np.int32))), pa.array(items[some], pa.int64()), pa.array(adj)], names=["profile_id", "item_id", "adj_sim"])
            best[seen], known[at] = -np.inf, False

    return run


def tag_rerank(s, d):
    """Best candidates of each profile with 0.3 of the score from the cosine of tags, where an item has tags."""
    l = liked(s, d).select(F.col("anchor_id").alias("id")).distinct()
    lists = store_lists(exact_topk(corpus(s, d), corpus(s, d).join(l, "id", "left_semi"), POOL), "query_id")
    tagged = stored(tags_long(s, d))
    r = compact(ratings(s, d).where("item_id is not null").select(F.col("profile_id").cast("bigint").alias("profile_id"), "item_id", "rating"))
    return by_slices(r, "profile_id", _reranked(lists, tagged), "profile_id bigint, item_id bigint, adj_sim double")


def tag_search_pos_neg(s, d):
    """Profile 1's search for films that are comedies or horror but no romance; one wanted tag is unknown."""
    return T.search_by_tags(s, d, "film", 1, ["Comedy", "Horror", "Unheard"], ["Romance"], floor=3, years=(1950, None))


def title_token_overlap(s, d):
    """Pairs of titles of one maker that share a significant word: joined by the word, not pair by pair."""
    t = items(s, d).select("maker", "title").distinct().select("maker", "title", F.explode(X.title_tokens(F.col("title"), STOP)).alias("tok"))
    j = t.alias("a").join(t.alias("b"), (F.col("a.maker") == F.col("b.maker")) & (F.col("a.tok") == F.col("b.tok")) & (F.col("a.title") < F.col("b.title")))
    return j.groupBy(F.col("a.maker").alias("maker"), F.col("a.title").alias("a"), F.col("b.title").alias("b")).agg(F.count("*").alias("overlap"))


def norm_check(s, d):
    return corpus(s, d).select(norm("v").alias("n")).agg(F.count("*").alias("n"), F.round(F.min("n"), 4).alias("min_norm"), F.round(F.max("n"), 4).alias("max_norm"))


def round_robin_books(s, d):
    """Picks of every profile: known authors left out, one book per work."""
    return T.recommend(s, d, "book", floor=10, one_per_work=True)


def round_robin_films(s, d):
    """Known directors left out, genres with a weight of 0.3, titles like the anchor's set back by 0.15."""
    return T.recommend(s, d, "film", floor=5, penalty=0.15, genre_weight=0.3)


def round_robin_tv(s, d):
    """Known creators left out, titles like the anchor's set back by 0.15."""
    return T.recommend(s, d, "series", floor=2, penalty=0.15)


BOOK_TITLES, FILM_TITLES = ["saga", "amber", "no such title"], ["flight", "treaty"]


def anchor_recs_books(s, d):
    return T.get_recommendations(s, d, "book", 3, BOOK_TITLES, years=(1950, 2030))


def anchor_recs_films(s, d):
    return T.get_recommendations(s, d, "film", 3, FILM_TITLES, years=(1950, 2030), language="en")


def diverse_greedy(s, d, n=10):
    """Farthest-point selection from the pool of 100 around item 0: each pick is least similar to its closest pick."""
    pool = exact_topk(corpus(s, d), corpus(s, d).where("id = 0"), 100).join(corpus(s, d), F.col("item_id") == F.col("id")).select("id", "v", "rk")
    p = pool.agg(F.array_sort(F.collect_list(F.struct("rk", "id", F.transform("v", lambda x: x.cast("double")).alias("v")))).alias("p"))  # 100 items
    prod = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s_, x: s_ + x)
    first = F.transform(F.slice("p", 1, 1), lambda x: x)

    def step(st, _):
        free = F.filter("p", lambda x: ~F.exists(st, lambda y: y["id"] == x["id"]))
        scored = F.transform(free, lambda x: F.struct(F.round(F.array_max(F.transform(st, lambda y: prod(x["v"], y["v"]))), 9).alias("m"), x["rk"].alias("rk"), x["id"].alias("id"), x["v"].alias("v")))
        best = F.get(F.array_sort(scored), F.lit(0))
        return F.concat(st, F.array(F.struct(best["rk"].alias("rk"), best["id"].alias("id"), best["v"].alias("v"))))

    out = p.select(F.posexplode(F.aggregate(F.sequence(F.lit(2), F.lit(n)), first, step)).alias("pos", "x"))
    return out.select((F.col("pos") + 1).alias("pick_no"), F.col("x.id").alias("item_id"))


def signed_profile_rank(s, d, cross=0.35, neg=1.0, n=20):
    """Likes attract, dislikes repel; the two best likes are named. The weights of this ranking are our own."""
    r = ratings(s, d).withColumn("w", F.col("rating") - 3).where("w <> 0").join(vec_items(s, d).select("item_id"), "item_id", "left_semi")
    q = corpus(s, d).join(r.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
    near = exact_topk(corpus(s, d), q, POOL)
    j = r.select("profile_id", F.col("item_id").alias("query_id"), "w").join(near, "query_id")
    j = unrated(j.withColumn("pull", F.col("w") * F.col("sim") / 2), s, d)
    up = top_per_group(j.where("w > 0"), ["profile_id", "item_id"], [F.desc("pull"), "query_id"], 2, "at").groupBy("profile_id", "item_id")
    up = up.agg(F.array_sort(F.collect_list(F.struct((-F.col("pull")).alias("less"), "query_id"))).alias("ups"))
    by = up.join(j.where("w < 0").groupBy("profile_id", "item_id").agg(F.max(-F.col("pull")).alias("down")), ["profile_id", "item_id"], "left")
    score = -F.col("ups")[0]["less"] - cross * F.coalesce(F.get("ups", F.lit(1))["less"], F.lit(0.0)) - neg * F.coalesce(F.greatest("down", F.lit(0.0)), F.lit(0.0))
    out = by.select("profile_id", "item_id", F.round(score, 6).alias("score"), F.col("ups")[0]["query_id"].alias("because_of"), F.get("ups", F.lit(1))["query_id"].alias("also_because"))
    return top_per_group(out, ["profile_id"], [F.desc("score"), "item_id"], n).drop("rk")


def every_50(*queries):
    """The queries by their names with _every50, asked with every fiftieth id."""
    return {f"{f.__name__}_every50": partial(f, seeds=EVERY_50) for f in queries}


def every_50_sql(sql, *names):
    return {f"{n}_every50": sql[n].replace(FIRST.format("a.item_id"), EVERY_50.format("a.item_id")) for n in names}


QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, knn_exclude_self, knn_taste_vector, knn_anchor_max, rank_profile_by_query, semantic_search_filtered, intra_list_diversity, tag_cosine_topk, tag_rerank,
        tag_search_pos_neg, title_token_overlap, norm_check, round_robin_books, round_robin_films, round_robin_tv, anchor_recs_books, anchor_recs_films, diverse_greedy, signed_profile_rank,
    )
}
QUERIES |= every_50(knn_topk, knn_exclude_self, intra_list_diversity, tag_cosine_topk)

_LIKED = "liked0 AS (SELECT profile_id, item_id AS anchor_id, rating FROM prof WHERE rating >= 3.5 AND item_id IN (SELECT item_id FROM vecs))"
_NEAR = """near AS MATERIALIZED (SELECT * FROM (SELECT a.item_id AS anchor_id, b.item_id, list_dot_product(a.v, b.v) AS sim, row_number() OVER (PARTITION BY a.item_id ORDER BY list_dot_product(a.v, b.v) DESC, b.item_id) AS rk
  FROM vecs a, vecs b WHERE {0}) WHERE rk <= {1})"""
_CAND = "cand AS MATERIALIZED (SELECT profile_id, anchor_id, item_id, sim FROM liked0 JOIN near USING (anchor_id) WHERE NOT EXISTS (SELECT 1 FROM prof r WHERE r.profile_id = liked0.profile_id AND r.item_id = near.item_id))"
_ANCH = with_(PROF, VECS, _LIKED, _NEAR.format("a.item_id IN (SELECT anchor_id FROM liked0)", POOL), _CAND)
_TASTE = """taste AS (SELECT profile_id, list(value ORDER BY pos) AS v FROM (
  SELECT profile_id, pos, sum((rating - 3) * x) / sum(abs(rating - 3)) AS value FROM (
    SELECT profile_id, rating, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM prof JOIN embeddings ON vec_id = item_id WHERE rating <> 3) GROUP BY 1, 2) GROUP BY 1)"""


def _film_sql(**k):
    return T.sql_with("film", T.SQL_LIKED, T.sql_candidates(100, 5, **k))


SQL = {
    "knn_topk": with_(VECS, _NEAR.format("a.item_id < 20", 10)) + "SELECT anchor_id, item_id, round(sim, 6) AS sim, CAST(rk AS INTEGER) AS rk FROM near",
    "knn_exclude_self": with_(VECS, _NEAR.format("a.item_id < 20 AND a.item_id <> b.item_id", 10)) + "SELECT anchor_id, item_id, round(sim, 6) AS sim, CAST(rk AS INTEGER) AS rk FROM near",
    "knn_taste_vector": with_(PROF, VECS, _TASTE) + """SELECT profile_id, item_id, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY sim DESC, item_id) AS INTEGER) AS rk
FROM (SELECT profile_id, item_id, list_dot_product(t.v, c.v) / sqrt(list_dot_product(t.v, t.v)) AS sim FROM taste t, vecs c WHERE NOT EXISTS (SELECT 1 FROM prof r WHERE r.profile_id = t.profile_id AND r.item_id = c.item_id)) QUALIFY rk <= 20""",
    "knn_anchor_max": _film_sql(known_makers=True) + "SELECT profile_id, item_id, score, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, item_id) AS INTEGER) AS rk FROM (SELECT profile_id, item_id, max(sim) AS score FROM cand GROUP BY 1, 2) QUALIFY rk <= 50",
    "rank_profile_by_query": with_(PROF, VECS) + "SELECT profile_id, item_id, round(sim, 3) AS relevance, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY sim DESC, item_id) AS INTEGER) AS rk FROM (SELECT profile_id, c.item_id, list_dot_product(c.v, q.v) AS sim FROM prof JOIN vecs c USING (item_id), vecs q WHERE q.item_id = 200) QUALIFY rk <= 8",
    "semantic_search_filtered": T.sql_with("book", "liked AS (SELECT CAST(1 AS BIGINT) AS profile_id, CAST(0 AS DOUBLE) AS anchor_order, arg_min(item_id, vec_id) AS anchor_id FROM vec)", T.sql_candidates(200, 10, False))
    + """SELECT item_id, sim, CAST(row_number() OVER (ORDER BY sim DESC, item_id) AS INTEGER) AS rk FROM (SELECT item_id, sim FROM cand QUALIFY row_number() OVER (PARTITION BY coalesce(work, 'item ' || item_id) ORDER BY sim DESC, item_id) = 1) JOIN cat USING (item_id)
WHERE year BETWEEN 1960 AND 2030 QUALIFY rk <= 15""",
    "intra_list_diversity": with_(VECS, _NEAR.format("a.item_id < 20 AND a.item_id <> b.item_id", 10)) + "SELECT x.anchor_id, round(1 - avg(list_dot_product(a.v, b.v)), 6) AS ild FROM near x JOIN near y ON x.anchor_id = y.anchor_id AND x.item_id < y.item_id JOIN vecs a ON a.item_id = x.item_id JOIN vecs b ON b.item_id = y.item_id GROUP BY 1",
    "tag_cosine_topk": with_(TAGS, "n AS (SELECT item_id, sqrt(sum(score * score)) AS n FROM tags GROUP BY 1)") + """SELECT item_id, other_id, round(cos, 6) AS cos, CAST(row_number() OVER (PARTITION BY item_id ORDER BY cos DESC, other_id) AS INTEGER) AS rk
FROM (SELECT a.item_id, b.item_id AS other_id, round(sum(a.score / na.n * (b.score / nb.n)), 9) AS cos FROM tags a JOIN tags b USING (tag) JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = b.item_id WHERE a.item_id < 20 AND a.item_id <> b.item_id GROUP BY 1, 2) QUALIFY rk <= 10""",
    "tag_rerank": _ANCH.rstrip() + f""", {TAGS}, {_TP},
pn AS (SELECT profile_id, sqrt(sum(weight * weight)) AS pn FROM tp GROUP BY 1), tn AS (SELECT item_id, sqrt(sum(score * score)) AS tn FROM tags GROUP BY 1),
best AS (SELECT profile_id, item_id, max(sim) AS sim FROM cand GROUP BY 1, 2),
sh AS (SELECT profile_id, item_id, sum(score * weight) AS c FROM best JOIN tags USING (item_id) JOIN tp USING (profile_id, tag) GROUP BY 1, 2)
SELECT profile_id, item_id, round(CASE WHEN pn > 0 AND tn > 0 THEN 0.7 * sim + 0.3 * (coalesce(c, 0) / (pn * tn)) ELSE sim END, 6) AS adj_sim FROM best LEFT JOIN sh USING (profile_id, item_id) LEFT JOIN pn USING (profile_id) LEFT JOIN tn USING (item_id)""",
    "tag_search_pos_neg": T.sql_with("film", "asked AS (SELECT unnest(['comedy', 'horror', 'unheard', 'romance']) AS tag)", "known AS (SELECT DISTINCT unnest(makers) AS maker FROM prof JOIN cat USING (item_id) WHERE profile_id = 1)")
    + """SELECT item_id, CAST(len(list_filter(genres, lambda g: g IN ('comedy', 'horror', 'unheard'))) - len(list_filter(genres, lambda g: g = 'romance')) AS INTEGER) AS tag_score, array_to_string(genres[1:5], ', ') AS tags,
  (SELECT string_agg(tag, ', ' ORDER BY tag) FROM asked WHERE tag NOT IN (SELECT unnest(genres) FROM cat)) AS unknown
FROM cat WHERE len(genres) > 0 AND popularity >= 3 AND year >= 1950 AND item_id NOT IN (SELECT item_id FROM prof WHERE profile_id = 1) AND NOT EXISTS (SELECT 1 FROM known WHERE list_contains(makers, maker))
ORDER BY tag_score DESC, popularity DESC, item_id LIMIT 15""",
    "title_token_overlap": with_(ITEMS, f"t AS (SELECT DISTINCT maker, title, unnest(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(title), '[:-]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: len(w) >= 3 AND w NOT IN {STOP})) AS tok FROM items)") + "SELECT a.maker, a.title AS a, b.title AS b, count(*) AS overlap FROM t a JOIN t b ON a.maker = b.maker AND a.tok = b.tok AND a.title < b.title GROUP BY ALL",
    "norm_check": with_(VECS) + "SELECT count(*) AS n, round(min(sqrt(list_dot_product(v, v))), 4) AS min_norm, round(max(sqrt(list_dot_product(v, v))), 4) AS max_norm FROM vecs",
    "round_robin_books": T.sql_with("book", T.SQL_LIKED, T.sql_candidates(100, 10, False), T.sql_scored(), T.sql_robin(20, one_per_work=True)),
    "round_robin_films": T.sql_with("film", T.SQL_LIKED, T.sql_candidates(100, 5, False), T.sql_scored(0.15, 0.3), T.sql_robin(20)),
    "round_robin_tv": T.sql_with("series", T.SQL_LIKED, T.sql_candidates(100, 2, False), T.sql_scored(0.15), T.sql_robin(20)),
    "anchor_recs_books": T.sql_with("book", T.sql_resolved(3, BOOK_TITLES, False), T.sql_candidates(150, 0, True, " AND year BETWEEN 1950 AND 2030"), T.sql_scored(), T.sql_robin(15, one_per_work=True)),
    "anchor_recs_films": T.sql_with("film", T.sql_resolved(3, FILM_TITLES, True), T.sql_candidates(200, 0, True, " AND year BETWEEN 1950 AND 2030 AND lang = 'en'"), T.sql_scored(), T.sql_robin(15)),
    "diverse_greedy": with_(VECS, _NEAR.format("a.item_id = 0", 100)).rstrip() + """, pool AS (SELECT item_id, v, rk FROM near JOIN vecs USING (item_id)),
pick(pick_no, ids) AS (
  SELECT 1, [(SELECT item_id FROM pool ORDER BY rk LIMIT 1)]
  UNION ALL
  SELECT pick_no + 1, list_append(ids, (SELECT p.item_id FROM pool p JOIN pool c ON list_contains(ids, c.item_id) WHERE NOT list_contains(ids, p.item_id) GROUP BY p.item_id, p.rk ORDER BY round(max(list_dot_product(p.v, c.v)), 9), p.rk LIMIT 1)) FROM pick WHERE pick_no < 10)
SELECT CAST(generate_subscripts(ids, 1) AS INTEGER) AS pick_no, unnest(ids) AS item_id FROM pick WHERE pick_no = 10""",
}
SQL |= every_50_sql(SQL, "knn_topk", "knn_exclude_self", "intra_list_diversity", "tag_cosine_topk")
