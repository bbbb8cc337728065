"""Offline evaluation as set operations over all profiles at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinolex.functions import text as X
from kinolex.operators.knn import exact_topk
from kinolex.operators.pools import Lists, about, by_slices, groups, half_up, keep_among
from kinolex.operators.rank import _Fold
from kinolex.operators.relational import percent_rank_average, top_per_group
from kinolex.plans.adapters import ITEMS, PROF, TAGS, VECS, with_
from kinolex.plans.vector_queries import _ANCH, _NEAR, FIRST, POOL, anchors_near, corpus, every_50, every_50_sql, tag_neighbours
from kinolex.operators.skew import split_join
from kinolex.plans.tools import STOP, neighbours, sql_near, sql_with
from kinolex.session import compact, stored, stored_batches
from kinolex.sources.catalogues import catalogue, rated, unit_vectors
from kinolex.sources.tables import items, ratings


def _order(*cols):
    """A portable pseudo-random order: the MD5 of the ids."""
    return F.md5(F.concat_ws("|", F.lit("seed"), *[F.col(c).cast("string") for c in cols]))


def _loo_ranks(s, d):
    """(profile_id, item_id, rank): rank of each item rated at least 4 among the unrated, when it is held out.

    A candidate's score without one anchor is its best similarity, or the second best where that anchor was the best; so
    two values per candidate answer all holdouts of a profile in one pass.
    """
    r = ratings(s, d)
    near = anchors_near(s, d).select("profile_id", "anchor_id", "item_id", "sim")
    w = Window.partitionBy("profile_id", "item_id").orderBy(F.desc("sim"), "anchor_id")
    two = near.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy("profile_id", "item_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("anchor_id"))).alias("best"), F.max(F.when(F.col("n") == 1, F.col("sim"))).alias("s1"), F.max(F.when(F.col("n") == 2, F.col("sim"))).alias("s2")
    )
    hold = r.where("rating >= 4").select("profile_id", F.col("item_id").alias("held"))
    own = hold.join(two.withColumnRenamed("item_id", "held"), ["profile_id", "held"], "left").select("profile_id", "held", F.when(F.col("best") == F.col("held"), F.col("s2")).otherwise(F.col("s1")).alias("own"))
    cand = two.join(r.select("profile_id", "item_id"), ["profile_id", "item_id"], "left_anti")
    # candidates ahead of a holdout by their best similarity: a running count over both, sorted together
    both = cand.select("profile_id", F.col("s1").alias("score"), F.col("item_id").alias("id"), F.lit(1).alias("c")).unionByName(
        own.where("own is not null").select("profile_id", F.col("own").alias("score"), F.col("held").alias("id"), F.lit(0).alias("c"))
    )
    order = Window.partitionBy("profile_id").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = both.withColumn("ahead", F.sum("c").over(order)).where("c = 0").select("profile_id", F.col("id").alias("held"), "ahead")
    # only candidates whose best anchor is held out have another score
    before = lambda x: ((F.col(x) > F.col("own")) | ((F.col(x) == F.col("own")) & (F.col("item_id") < F.col("held")))).cast("int")
    moved = own.join(cand.withColumnRenamed("best", "held"), ["profile_id", "held"]).groupBy("profile_id", "held").agg(F.sum(F.coalesce(before("s2"), F.lit(0)) - F.coalesce(before("s1"), F.lit(0))).alias("moved"))
    out = own.join(ahead, ["profile_id", "held"], "left").join(moved, ["profile_id", "held"], "left")
    return out.select("profile_id", "held", F.when(F.col("own").isNotNull(), F.col("ahead") + F.coalesce("moved", F.lit(0)) + 1).alias("rank"))


def eval_loo(s, d):
    rank = F.when(F.col("rank") <= 50, F.col("rank"))
    return _loo_ranks(s, d).agg(
        F.lit("anchor_max").alias("method"), F.round(F.avg((F.coalesce(rank, F.lit(999)) <= 10).cast("int")), 6).alias("hit10"),
        F.round(F.avg((F.coalesce(rank, F.lit(999)) <= 20).cast("int")), 6).alias("hit20"), F.round(F.avg(F.coalesce(1 / rank, F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n"),
    )


def eval_split_80_20(s, d):
    w = Window.partitionBy("profile_id")
    r = ratings(s, d).select("profile_id", "item_id").withColumn("at", F.row_number().over(w.orderBy(_order("profile_id", "item_id"), "item_id"))).withColumn("n", F.count("*").over(w))
    return r.select("profile_id", "item_id", (F.col("at") <= F.greatest(F.lit(1), F.round(F.col("n") * 0.2).cast("int"))).alias("is_test"))


def eval_user_sample(s, d):
    n = ratings(s, d).groupBy("profile_id").agg(F.count("*").alias("n")).where("n between 38 and 60")
    return n.orderBy(_order("profile_id"), "profile_id").limit(50).select("profile_id")


FLOOR, LIKE = 5, 3.5
GRID = [(c, g, t) for c in (0.2, 0.35, 0.5) for g in (0.5, 1.0, 1.5) for t in (0.15, 0.25)]
DEFAULT = "cross=0.35 neg=1.0 tag=0.25"
# name: by turns, title penalty, popularity floor
VARIANTS = {"full": (True, 0.15, FLOOR), "flat": (False, 0.15, FLOOR), "no title penalty": (True, 0.0, FLOOR), "no floor": (True, 0.15, 0), "flat, no penalty, no floor": (False, 0.0, 0)}


def _held_out(r):
    """Adds is_test: a fifth of each profile's rows."""
    w = Window.partitionBy("profile_id")
    r = r.withColumn("at", F.row_number().over(w.orderBy(_order("profile_id", "item_id"), "item_id"))).withColumn("n", F.count("*").over(w))
    return r.withColumn("is_test", F.col("at") <= F.greatest(F.lit(1), F.round(F.col("n") * 0.2).cast("int")))


def _films(s, d):
    """(train, relevant, likes): ratings of films with vectors, a fifth of each profile's held out; relevant: held out, rated 4, above the floor.

    Profiles that like nothing in what is left, or have nothing relevant, don't count.
    """
    r = rated(s, d, "film").join(unit_vectors(s, d, "film").select("item_id"), "item_id", "left_semi").join(catalogue(s, d, "film").select("item_id", "popularity"), "item_id")
    r = compact(_held_out(r))
    train = r.where("not is_test").select("profile_id", "item_id", "rating")
    likes = train.where(F.col("rating") >= LIKE)
    relevant = r.where(f"is_test and rating >= 4 and popularity >= {FLOOR}").select("profile_id", "item_id").join(likes.select("profile_id").distinct(), "profile_id", "left_semi")
    return train, relevant, likes


def _recalls(relevant, top, by):
    """Recall of the relevant items at 10, 20 and 50, and whether any is among 20, by profile and the columns ``by``. top: by, profile_id, item_id, rk."""
    methods = top.select(*by).distinct()
    j = relevant.join(F.broadcast(methods)).join(top, [*by, "profile_id", "item_id"], "left")  # methods: a handful of rows
    at = lambda k: F.round(F.count_if(F.col("rk") <= k) / F.count("*"), 6)
    return j.groupBy(*by, "profile_id").agg(at(10).alias("r10"), at(20).alias("r20"), at(50).alias("r50"), F.max((F.coalesce("rk", F.lit(99)) <= 20).cast("int")).alias("hit20"))


def _offers(s, d, train, floor=FLOOR, signed=False):
    """(profile_id, anchor_id, rating, item_id, sim, title): neighbours of liked (or all rated) items, without what is known, above the floor."""
    anchors = train.withColumnRenamed("item_id", "anchor_id")
    anchors = anchors.where(F.col("rating") != 3) if signed else anchors.where(F.col("rating") >= LIKE)
    near = split_join(anchors, neighbours(s, d, "film", anchors, POOL), ["anchor_id"], ["profile_id"])
    near = near.join(catalogue(s, d, "film").where(F.col("popularity") >= floor).select("item_id", "title", "popularity", "genres"), "item_id")
    return near.join(train.select("profile_id", "item_id"), ["profile_id", "item_id"], "left_anti")


def _popular(s, d, train):
    """The fifty most popular films with a vector that a profile doesn't know."""
    names = unit_vectors(s, d, "film").select("item_id", "vec_id").join(catalogue(s, d, "film").where(F.col("popularity") >= FLOOR).select("item_id", "popularity"), "item_id")
    known = train.join(names, "item_id").select(F.col("profile_id").alias("query_id"), F.col("vec_id").alias("item_id"))
    asked = train.select(F.col("profile_id").alias("id")).distinct().withColumn("v", F.array(F.lit(1.0)))
    top = exact_topk(names.select(F.col("vec_id").alias("id"), F.array(F.col("popularity").cast("double")).alias("v")), asked, 50, exclude=known)
    return top.select(F.col("query_id").alias("profile_id"), F.col("item_id").alias("vec_id"), "rk").join(names.select("vec_id", "item_id"), "vec_id").select("profile_id", "item_id", "rk")


def _both_methods(s, d):
    train, relevant, _ = _films(s, d)
    best = _offers(s, d, train).groupBy("profile_id", "item_id").agg(F.max("sim").alias("score"))
    old = top_per_group(best, ["profile_id"], [F.desc("score"), "item_id"], 50).select(F.lit("anchor_max").alias("method"), "profile_id", "item_id", "rk")
    pop = _popular(s, d, train).select(F.lit("popularity").alias("method"), "profile_id", "item_id", "rk")
    return _recalls(relevant, old.unionByName(pop), ["method"])


def eval_recall_hit(s, d):
    return _both_methods(s, d).select("method", "profile_id", "r10", "r20", "r50", "hit20")


def eval_summary(s, d):
    long = _both_methods(s, d).select("method", F.expr("stack(4, 'r10', r10, 'r20', r20, 'r50', r50, 'hit20', cast(hit20 as double)) as (metric, x)"))
    n = F.count("x")
    return long.groupBy("metric", "method").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("x") / F.sqrt(n), F.lit(0.0)), 6).alias("stderr"))


def _stored(s, d, signed):
    """(lists, films, rows): the films' neighbour lists and what is known of films, both stored, and the ratings of them; vec_id is the key of lists.

    rows: what is left of each profile and, with is_relevant, what is held out and counts, as in _films. num follows the
    order of item_id. Lists hold all neighbours, whatever their popularity. Vectors and the catalogue are made once, and
    ratings of other films are dropped before anything is shuffled.
    """
    v = compact(unit_vectors(s, d, "film"))
    cat = catalogue(s, d, "film").select("item_id", "popularity", "genres", X.title_tokens(F.col("title"), STOP).alias("words"))
    films = v.select("item_id", "vec_id").join(cat, "item_id").orderBy("item_id").withColumn("num", F.monotonically_increasing_id())
    films = stored(films.withColumn("movie_id", F.col("item_id").try_cast("bigint")))
    known = s.read.parquet(films).select("item_id", "vec_id", "num", "popularity")
    r = _held_out(rated(s, d, "film", lambda t: keep_among(t, "movie_id", films, "movie_id")).join(known, "item_id"))
    likes = F.max(~F.col("is_test") & (F.col("rating") >= LIKE)).over(Window.partitionBy("profile_id"))
    r = r.withColumn("is_relevant", F.col("is_test") & (F.col("rating") >= 4) & (F.col("popularity") >= FLOOR) & likes)
    r = compact(r.where("is_relevant or not is_test").select("profile_id", "item_id", "vec_id", "num", "rating", "is_relevant"))
    anchors = r.where(~F.col("is_relevant") & (F.col("rating") != 3 if signed else F.col("rating") >= LIKE)).select("item_id").distinct()
    ids = lambda df: df.select(F.col("vec_id").alias("id"), "v")
    lists = stored(exact_topk(ids(v), ids(v.join(anchors, "item_id", "left_semi")), POOL, digits=9, lists=True))
    return lists, films, r.drop("item_id")


def _coded(known, column):
    """(start, codes) of a column of lists of texts."""
    if not known.num_rows:
        return np.zeros(1, int), np.zeros(0, int)
    lists = known.column(column).combine_chunks()
    code = lists.flatten().dictionary_encode().indices.to_numpy()
    return np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())], code


class _Slice:
    """A slice of profiles with the lists of their anchors; items are numbers in the order of their item_id."""

    def __init__(self, t, lists, films, is_anchor):
        vec, self.stars, self.relevant = t.column("vec_id").to_numpy(), t.column("rating").to_numpy(), t.column("is_relevant").to_numpy(zero_copy_only=False)
        self.anchor = ~self.relevant & is_anchor(self.stars)
        self.near = Lists(lists, np.unique(vec[self.anchor]))
        known = about(films, "vec_id", np.unique(np.concatenate([self.near.items, vec])))
        known = known.take(pc.sort_indices(known.column("item_id"))) if known.num_rows else known
        ids = known.column("vec_id").to_numpy() if known.num_rows else np.zeros(0, np.int64)
        self.vec, by = vec, np.argsort(ids)
        place = lambda x: by[np.minimum(np.searchsorted(ids[by], x), max(0, len(ids) - 1))] if len(ids) else np.zeros(len(x), int)
        met = lambda x: ids[place(x)] == x if len(ids) else np.zeros(len(x), bool)
        self.item, self.of_list = place(vec), place(self.near.items)
        self.listed = met(self.near.items)  # neighbours that are in the catalogue
        self.size = len(ids)
        self.popularity = known.column("popularity").to_numpy() if len(ids) else np.zeros(0)
        self.genre_start, self.genre = _coded(known, "genres")
        self.groups = groups(t.column("profile_id"))
        self.profile = t.column("profile_id")

    def offered(self, floor):
        """Whether each neighbour is a film of the catalogue and popular enough."""
        return self.listed & (self.popularity[self.of_list] >= floor) if self.size else self.listed

    def pools(self, own, offered, known):
        """(place among the anchors, place in the lists) of what the anchors of a profile offer that it doesn't know. known: room for marks."""
        at, pool = self.near.rows(self.vec[own][self.anchor[own]])
        mine = self.item[own][~self.relevant[own]]
        known[mine] = True
        some = offered[pool] & ~known[self.of_list[pool]]
        known[mine] = False
        return at[some], pool[some]

    @staticmethod
    def listed_of(start, at):
        """(place in at, place in the codes) of the lists of some items."""
        n = start[at + 1] - start[at]
        return np.repeat(np.arange(len(at)), n), np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _recall(ranks):
    """Recall at 10, 20 and 50 and hit at 20 from the ranks of the relevant items (inf: not ranked)."""
    at = lambda k: float(half_up(np.array((ranks <= k).mean()), 6))
    return at(10), at(20), at(50), int((ranks <= 20).any())


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _best_of(item, score):
    """(item, best score, second best or 0) of each distinct item, in the items' order."""
    order = np.lexsort((-score, item))
    item, score = item[order], score[order]
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
    second, two = np.zeros(len(first)), first + 1 < np.r_[first[1:], len(item)] if len(item) else np.zeros(0, bool)
    second[two] = score[first[two] + 1]
    return item[first], score[first], second


def _ranks(base, score, wanted):
    """Rank of each wanted item among the items of base (sorted) by each row of scores, ties to the smaller; inf where it isn't among them."""
    if not len(base):
        return np.full((len(score), len(wanted)), np.inf)
    spot = np.minimum(np.searchsorted(base, wanted), len(base) - 1)
    mine, ahead = score[:, spot][:, :, None], score[:, None, :]
    ahead = (ahead > mine) | ((ahead == mine) & (base < base[spot][:, None])[None])
    return np.where(base[spot] == wanted, ahead.sum(2) + 1, np.inf)


def _tuned(lists, films):
    """(config, profile_id, r20, any): recall of profiles with relevant items (else null), and whether there are candidates; see eval_tune."""
    c, g, tag = (np.array(x)[:, None] for x in zip(*GRID))
    names = [f"cross={c} neg={g} tag={t}" for c, g, t in GRID]
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.bool_()]

    def run(t):
        z = _Slice(t, lists, films, lambda stars: stars != 3)
        known, down, weight = np.zeros(z.size, bool), np.zeros(z.size), np.zeros(int(z.genre.max(initial=-1)) + 1)
        offered = z.offered(FLOOR)
        for own in z.groups:
            item, stars, rel, anchor = z.item[own], z.stars[own], z.relevant[own], z.anchor[own]
            at, pool = z.pools(own, offered, known)
            i, by = z.of_list[pool], stars[anchor][at]
            pull = half_up((by - 3) * z.near.sims[pool] / 2, 9)
            base, up1, up2 = _best_of(i[by > 3], pull[by > 3])
            rank = None
            if rel.any():
                np.maximum.at(down, i[by < 3], -pull[by < 3])
                push = down[base]
                down[i] = 0.0
                of, place = z.listed_of(z.genre_start, item[~rel])
                np.add.at(weight, z.genre[place], stars[~rel][of] - 3)
                length, cos = np.sqrt((weight * weight).sum()), np.zeros(len(base))
                of, codes = z.listed_of(z.genre_start, base)
                n = np.bincount(of, minlength=len(base))
                if length > 0:
                    cos[n > 0] = half_up(np.bincount(of, weight[z.genre[codes]], len(base))[n > 0] / (length * np.sqrt(n[n > 0])), 9)
                weight[z.genre[place]] = 0.0
                rank = _ranks(base, half_up((1 - tag) * (up1 + c * up2 - g * push) + tag * cos, 9), item[rel])
            if rel.any() or len(base):
                p = z.profile[own.start].as_py()
                yield _batch([(n, p, None if rank is None else _recall(rank[k])[1], len(base) > 0) for k, n in enumerate(names)], ["config", "profile_id", "r20", "any"], kinds)

    return run


def eval_tune(s, d):
    """Recall at 20 of 18 settings of a signed ranking on half of the profiles; the best, and the default, on the other half, too.

    Two best pulls (the second by cross), less the strongest push (by neg), mixed with the cosine of genres (by tag).
    All settings are scored in one job from the same four numbers per profile and item.
    """
    lists, films, r = _stored(s, d, True)
    got = by_slices(r, "profile_id", _tuned(lists, films), "config string, profile_id bigint, r20 double, any boolean").withColumn("seen", F.substring(_order("profile_id"), 1, 1) < "8")
    mean = lambda c: F.round(F.avg(F.when(c, F.col("r20"))), 6)
    means = compact(got.groupBy("config").agg(mean(F.col("seen")).alias("r20"), mean(~F.col("seen")).alias("unseen"), F.max("any").alias("any"), F.count("r20").alias("n")).where("any and n > 0"))
    best = means.agg(F.min(F.struct((-F.coalesce("r20", F.lit(-1.0))).alias("less"), "config")).getField("config").alias("best"))
    means = means.join(F.broadcast(best))  # one row
    return means.select("config", "r20", (F.col("config") == F.col("best")).alias("chosen"), F.when(F.col("config").isin(DEFAULT) | (F.col("config") == F.col("best")), F.col("unseen")).alias("r20_unseen"))


FLOORS = sorted({f for _, _, f in VARIANTS.values()})
ALIKE = len(FLOORS)  # the bit of kinds behind those of the floors
UNIT = 10**9  # similarities have nine decimals
LISTED = "key bigint, items array<bigint>, sims array<int>, kinds array<tinyint>"
# rows of a slice: little but the lists of a slice is held, and every slice reads all lists
ABLATED = 80_000


def _kinds(films):
    """Lists by num, ascending, of what the catalogue holds, with sims in billionths; kinds: bits for each floor reached, and for a word shared with the anchor's title."""

    def run(batches):
        known = pa.Table.from_batches(list(stored_batches(films, ["vec_id", "num", "popularity", "words"], 65_536)))
        vec, num, popularity = (known.column(c).to_numpy() for c in ("vec_id", "num", "popularity"))
        by, (start, word) = np.argsort(vec, kind="stable"), _coded(known, "words")
        mark = np.zeros(int(word.max(initial=-1)) + 1, bool)
        bits = sum(((popularity >= f).astype(np.int8) << k for k, f in enumerate(FLOORS)), np.zeros(len(vec), np.int8))

        def place(x):
            at = by[np.minimum(np.searchsorted(vec, x, sorter=by), len(vec) - 1)]
            return at, vec[at] == x

        for b in batches:
            if not len(vec):
                break
            at, there = place(b.column("key").to_numpy())
            b, at = b.filter(pa.array(there)), at[there]
            of = np.repeat(np.arange(len(at)), b.column("items").value_lengths().to_numpy())
            item, there = place(b.column("items").flatten().to_numpy())
            of, item, sim = of[there], item[there], np.rint(b.column("sims").flatten().to_numpy()[there] * UNIT).astype(np.int32)
            order = np.lexsort((num[item], of))
            of, item, sim = of[order], item[order], sim[order]
            ends, alike = np.searchsorted(of, np.arange(len(at) + 1)), np.zeros(len(item), bool)
            n = start[item + 1] - start[item]
            flat = np.repeat(start[item] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            words, whose, first = word[flat], np.repeat(np.arange(len(item)), n), np.r_[0, np.cumsum(n)]
            for k, a in enumerate(at):
                mine, some = word[start[a] : start[a + 1]], slice(first[ends[k]], first[ends[k + 1]])
                mark[mine] = True
                alike[whose[some][mark[words[some]]]] = True
                mark[mine] = False
            made = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([pa.array(num[at]), made(num[item], pa.int64()), made(sim, pa.int32()), made(bits[item] | (alike.astype(np.int8) << ALIKE), pa.int8())], names=["key", "items", "sims", "kinds"])

    return run


def _met(near, anchors, wanted, of_anchor, of_wanted, profiles):
    """Whether each profile has a wanted item in a list of its anchors. of_*: the profile of each, ascending."""
    met = np.bincount(of_wanted, minlength=profiles) > POOL  # too many pairs; these are looked at closely anyway
    some = ~met[of_wanted]
    wanted, of_wanted = wanted[some], of_wanted[some]
    items, code = np.unique(near.items, return_inverse=True)
    if not len(items):
        return met
    pairs = np.repeat(np.arange(len(near.n)), near.n) * len(items) + code  # ascending, as each list is
    first = np.searchsorted(of_anchor, np.arange(profiles + 1))
    n = np.diff(first)[of_wanted]
    list_of, (at, place) = np.full(len(anchors), -1), near.lists(anchors)
    list_of[at] = place
    code = np.minimum(np.searchsorted(items, wanted), len(items) - 1)
    code = np.where(items[code] == wanted, code, -1)
    for lo in range(0, len(wanted), 20_000):
        m = n[lo : lo + 20_000]
        of = np.repeat(np.arange(lo, lo + len(m)), m)
        anchor = list_of[np.repeat(first[of_wanted[lo : lo + len(m)]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        ask = anchor * len(items) + code[of]
        there = (anchor >= 0) & (code[of] >= 0) & (pairs[np.minimum(np.searchsorted(pairs, ask), len(pairs) - 1)] == ask)
        met[of_wanted[of[there]]] = True
    return met


def _ablated(lists):
    """(variant, profile_id, r10, r20, r50, hit20, any) of profiles with relevant items; any: whether the slice has candidates. See eval_ablate.

    A relevant item that no anchor's list holds has no rank in any variant; so only profiles with one that is held are ranked.
    """

    def run(t):
        num, stars, relevant = t.column("num").to_numpy(), t.column("rating").to_numpy(), t.column("is_relevant").to_numpy(zero_copy_only=False)
        own = groups(t.column("profile_id"))
        of = np.repeat(np.arange(len(own)), [g.stop - g.start for g in own])
        asks, anchor = np.bincount(of[relevant], minlength=len(own)) > 0, ~relevant & (stars >= LIKE)
        mine = anchor & asks[of]
        near = Lists(lists, np.unique(num[mine]), "kinds")
        met = _met(near, num[mine], num[relevant], of[mine], of[relevant], len(own))

        def pool(near, g):
            """Places in the lists of what the anchors of a profile offer that it doesn't know."""
            _, at = near.rows(num[g][anchor[g]])
            return at[~np.isin(near.items[at], num[g][~relevant[g]])]

        def any_of(near, some):
            """Bits of the floors that have a candidate in some profiles."""
            bits, every = 0, (1 << ALIKE) - 1
            for k in some:
                bits |= int(np.bitwise_or.reduce(near.kinds[pool(near, own[k])], initial=0)) & every
                if bits == every:
                    break
            return bits

        bits = any_of(near, np.flatnonzero(asks))
        if bits != (1 << ALIKE) - 1 and (anchor & ~asks[of]).any():
            bits |= any_of(Lists(lists, np.unique(num[anchor & ~asks[of]]), "kinds"), np.flatnonzero(~asks))
        queues = {}

        def offered(at, p, f):
            """(item, score) of the places that reach a floor."""
            at = at[near.kinds[at] >> FLOORS.index(f) & 1 == 1]
            return near.items[at], near.sims[at] - round(p * UNIT) * (near.kinds[at] >> ALIKE & 1 == 1)

        def queue(a, p, f):
            if (a, p, f) not in queues:
                i, score = offered(near.rows(np.array([a]))[1], p, f)
                queues[a, p, f] = [(x, None) for x in i[np.lexsort((i, -score))].tolist()]
            return queues[a, p, f]

        who, place = np.flatnonzero(asks), np.cumsum(asks) - 1
        out = {name: np.zeros((4, len(who))) for name in VARIANTS}
        for k in np.flatnonzero(met):
            g = own[k]
            item, rel, likes = num[g], relevant[g], anchor[g]
            wanted, turn, free = item[rel], np.lexsort((item[likes], -stars[g][likes])), pool(near, g)
            for name, (turns, p, f) in VARIANTS.items():
                if turns:
                    fold = _Fold(2, 50)
                    fold.items = set(item[~rel].tolist())
                    for a in item[likes][turn].tolist():
                        if fold.full:
                            break
                        fold.first_turn(a, queue(a, p, f))
                    picked = {i: n + 1 for n, (i, _) in enumerate(fold.finished())}
                    rank = np.array([picked.get(i, np.inf) for i in wanted.tolist()])
                else:
                    base, best, _ = _best_of(*offered(free, p, f))
                    by = np.lexsort((base, -best))
                    picked = dict(zip(base[by].tolist(), range(1, len(by) + 1)))
                    rank = np.array([picked.get(i, np.inf) for i in wanted.tolist()])
                out[name][:, place[k]] = _recall(rank)
        profile = t.column("profile_id").take(pa.array(np.array([own[k].start for k in who], np.int64))).combine_chunks()
        for name, (_, _, f) in VARIANTS.items():
            there = bool(bits >> FLOORS.index(f) & 1)
            if len(who):
                r10, r20, r50, hit = out[name]
                columns = [pa.array([name]).take(pa.array(np.zeros(len(who), np.int32))), profile, *map(pa.array, (r10, r20, r50, hit.astype(np.int32))), pa.array(np.full(len(who), there))]
            elif there:
                columns = [pa.array([name]), *(pa.nulls(1, k) for k in (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())), pa.array([True])]
            else:
                continue
            yield pa.RecordBatch.from_arrays(columns, names=["variant", "profile_id", "r10", "r20", "r50", "hit20", "any"])

    return run


def eval_ablate(s, d):
    """Recall with one part of the ranking taken away at a time: turns, title penalty, popularity floor, and all three; in one job."""
    lists, films, r = _stored(s, d, False)
    lists = stored(s.read.schema("key bigint, items array<bigint>, sims array<double>").parquet(lists).mapInArrow(_kinds(films), LISTED))
    got = by_slices(r, "profile_id", _ablated(lists), "variant string, profile_id bigint, r10 double, r20 double, r50 double, hit20 int, any boolean", ABLATED, s.sparkContext.defaultParallelism)
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    means = got.groupBy("variant").agg(mean("r10"), mean("r20"), mean("r50"), mean("hit20"), F.count("r10").alias("profiles"), F.max("any").alias("any"))
    return means.where("any and profiles > 0").drop("any")


def eval_neighbors(s, d, seeds=FIRST):
    """Per seed: diversity of its ten neighbours, their median rarity, and how many are neighbours by tags too."""
    near = exact_topk(corpus(s, d), corpus(s, d).where(seeds.format("id")), 10, skip_self=True)
    cells = near.join(corpus(s, d), near.item_id == F.col("id")).select("query_id", F.posexplode("v").alias("pos", "x"))
    sums = cells.groupBy("query_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("t"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("own"), F.count("*").alias("n"))
    ild = sums.groupBy(F.col("query_id").alias("anchor_id")).agg((1 - F.sum(F.col("t") * F.col("t") - F.col("own")) / (F.max("n") * (F.max("n") - 1))).alias("ild"))
    pct = percent_rank_average(items(s, d), "popularity").select("item_id", (1 - F.col("pct")).alias("rare"))
    rare = near.join(pct, "item_id").groupBy(F.col("query_id").alias("anchor_id")).agg(F.median("rare").alias("novelty"))
    tags = tag_neighbours(s, d, F.expr(seeds.format("item_id"))).select(F.col("item_id").alias("query_id"), F.col("other_id").alias("item_id"))
    both = near.join(tags, ["query_id", "item_id"]).groupBy(F.col("query_id").alias("anchor_id")).agg((F.count("*") / 10).alias("o"))
    out = ild.join(rare, "anchor_id", "left").join(both, "anchor_id", "left")
    return out.select("anchor_id", F.round("ild", 6).alias("ild"), F.round("novelty", 6).alias("novelty"), F.round(F.coalesce("o", F.lit(0.0)), 6).alias("tag_overlap"))


QUERIES = {f.__name__: f for f in (eval_loo, eval_split_80_20, eval_user_sample, eval_recall_hit, eval_summary, eval_neighbors, eval_tune, eval_ablate)}
QUERIES |= every_50(eval_neighbors)

_SPLIT = """split AS (SELECT profile_id, item_id, row_number() OVER (PARTITION BY profile_id ORDER BY md5(concat_ws('|', 'seed', profile_id, item_id)), item_id)
  <= greatest(1, CAST(round(count(*) OVER (PARTITION BY profile_id) * 0.2) AS INTEGER)) AS is_test FROM prof)"""
_TRAIN = f"""rs AS MATERIALIZED (SELECT p.profile_id, p.item_id, rating, popularity, row_number() OVER (PARTITION BY profile_id ORDER BY md5(concat_ws('|', 'seed', profile_id, item_id)), item_id)
  <= greatest(1, CAST(round(count(*) OVER (PARTITION BY profile_id) * 0.2) AS INTEGER)) AS is_test FROM prof p JOIN cat USING (item_id) WHERE item_id IN (SELECT item_id FROM vec)),
train AS (SELECT * FROM rs WHERE NOT is_test),
rel AS (SELECT profile_id, item_id FROM rs WHERE is_test AND rating >= 4 AND popularity >= {FLOOR} AND profile_id IN (SELECT profile_id FROM train WHERE rating >= {LIKE}))"""
_REC = sql_with("film", _TRAIN, sql_near(f"SELECT item_id FROM train WHERE rating >= {LIKE}", POOL), f"""old AS (SELECT 'anchor_max' AS method, profile_id, item_id, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, item_id) AS rk FROM (
    SELECT t.profile_id, n.item_id, max(sim) AS score FROM train t JOIN near n ON n.anchor_id = t.item_id JOIN cat c ON c.item_id = n.item_id WHERE t.rating >= {LIKE} AND c.popularity >= {FLOOR}
    AND NOT EXISTS (SELECT 1 FROM train k WHERE k.profile_id = t.profile_id AND k.item_id = n.item_id) GROUP BY 1, 2) QUALIFY rk <= 50),
pop AS (SELECT 'popularity' AS method, u.profile_id, v.item_id, row_number() OVER (PARTITION BY u.profile_id ORDER BY popularity DESC, vec_id) AS rk FROM (SELECT DISTINCT profile_id FROM train) u, vec v JOIN cat USING (item_id)
  WHERE popularity >= {FLOOR} AND NOT EXISTS (SELECT 1 FROM train k WHERE k.profile_id = u.profile_id AND k.item_id = v.item_id) QUALIFY rk <= 50),
rec AS (SELECT m.method, rel.profile_id, round(count(*) FILTER (rk <= 10) / count(*), 6) AS r10, round(count(*) FILTER (rk <= 20) / count(*), 6) AS r20, round(count(*) FILTER (rk <= 50) / count(*), 6) AS r50, max(CASE WHEN rk <= 20 THEN 1 ELSE 0 END) AS hit20
  FROM rel CROSS JOIN (SELECT 'anchor_max' AS method UNION ALL SELECT 'popularity') m LEFT JOIN (SELECT * FROM old UNION ALL SELECT * FROM pop) t ON t.method = m.method AND t.profile_id = rel.profile_id AND t.item_id = rel.item_id GROUP BY 1, 2)""")  # fmt: skip
SQL = {
    "eval_loo": with_(PROF, VECS, "liked0 AS (SELECT profile_id, item_id AS anchor_id FROM prof WHERE rating >= 3.5 AND item_id IN (SELECT item_id FROM vecs))", _NEAR.format("a.item_id IN (SELECT anchor_id FROM liked0)", POOL), """
hold AS (SELECT profile_id, item_id AS held FROM prof WHERE rating >= 4),
sc AS (SELECT h.profile_id, h.held, n.item_id, max(sim) AS score FROM hold h JOIN liked0 l ON l.profile_id = h.profile_id AND l.anchor_id <> h.held JOIN near n ON n.anchor_id = l.anchor_id
  WHERE n.item_id = h.held OR NOT EXISTS (SELECT 1 FROM prof r WHERE r.profile_id = h.profile_id AND r.item_id = n.item_id) GROUP BY 1, 2, 3),
rk AS (SELECT profile_id, held, item_id, row_number() OVER (PARTITION BY profile_id, held ORDER BY score DESC, item_id) AS rk FROM sc)""") + """SELECT 'anchor_max' AS method, round(avg(CASE WHEN rk <= 10 THEN 1 ELSE 0 END), 6) AS hit10, round(avg(CASE WHEN rk <= 20 THEN 1 ELSE 0 END), 6) AS hit20,
round(avg(CASE WHEN rk <= 50 THEN 1.0 / rk ELSE 0 END), 6) AS mrr, count(*) AS n FROM hold h LEFT JOIN rk ON rk.profile_id = h.profile_id AND rk.held = h.held AND rk.item_id = h.held""",
    "eval_split_80_20": with_(PROF, _SPLIT) + "SELECT profile_id, item_id, is_test FROM split",
    "eval_user_sample": with_(PROF) + "SELECT profile_id FROM (SELECT profile_id FROM prof GROUP BY 1 HAVING count(*) BETWEEN 38 AND 60) ORDER BY md5(concat_ws('|', 'seed', profile_id)), profile_id LIMIT 50",
    "eval_recall_hit": _REC + "SELECT method, profile_id, r10, r20, r50, hit20 FROM rec",
    "eval_summary": _REC + "SELECT metric, method, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x) / sqrt(count(x)), 0), 6) AS stderr FROM (SELECT unnest(['r10', 'r20', 'r50', 'hit20']) AS metric, unnest([r10, r20, r50, CAST(hit20 AS DOUBLE)]) AS x, method FROM rec) GROUP BY 1, 2",
    "eval_neighbors": with_(ITEMS, VECS, TAGS, _NEAR.format("a.item_id < 20 AND a.item_id <> b.item_id", 10), "n AS (SELECT item_id, sqrt(sum(score * score)) AS n FROM tags GROUP BY 1)", """
tk AS (SELECT item_id, other_id FROM (SELECT a.item_id, b.item_id AS other_id, round(sum(a.score / na.n * (b.score / nb.n)), 9) AS cos FROM tags a JOIN tags b USING (tag) JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = b.item_id WHERE a.item_id < 20 AND a.item_id <> b.item_id GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cos DESC, other_id) <= 10),
ild AS (SELECT x.anchor_id, 1 - avg(list_dot_product(a.v, b.v)) AS ild FROM near x JOIN near y ON x.anchor_id = y.anchor_id AND x.item_id < y.item_id JOIN vecs a ON a.item_id = x.item_id JOIN vecs b ON b.item_id = y.item_id GROUP BY 1),
pc AS (SELECT item_id, 1 - (rank() OVER (ORDER BY popularity) + (count(*) OVER (PARTITION BY popularity) - 1) / 2.0) / count(*) OVER () AS rare FROM items),
nv AS (SELECT anchor_id, median(rare) AS novelty FROM near JOIN pc USING (item_id) GROUP BY 1)""") + """SELECT anchor_id, round(ild, 6) AS ild, round(novelty, 6) AS novelty, round(coalesce(o, 0), 6) AS tag_overlap FROM ild LEFT JOIN nv USING (anchor_id)
LEFT JOIN (SELECT near.anchor_id, count(*) / 10.0 AS o FROM near JOIN tk ON tk.item_id = near.anchor_id AND tk.other_id = near.item_id GROUP BY 1) USING (anchor_id)""",
}
SQL |= every_50_sql(SQL, "eval_neighbors")
