"""Exact nearest neighbours and vector aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolex.operators.relational import top_per_group
from kinolex.session import shuffle_width, stored, stored_batches

CORPUS_BLOCK, QUERY_BLOCK = 4_096, 2_048


def dot(a, b) -> Column:
    """Inner product in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


class Best:
    """The k best items of each query so far, in double precision; ties to the smaller item."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k, self.n = queries, k, 0
        self.kth = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, row: np.ndarray, item: np.ndarray, sim: np.ndarray) -> None:
        self.parts.append((row, item, sim))
        self.n += len(row)
        if self.n > 2 * self.k * self.queries + 10_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, item, sim = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((item, -sim, row))
        row, item, sim = row[order], item[order], sim[order]
        at = _place(row)
        last = at == self.k - 1
        self.kth[row[last]] = sim[last]
        row, item, sim = row[at < self.k], item[at < self.k], sim[at < self.k]
        self.parts, self.n = [(row, item, sim)], 0
        return row, item, sim


def _place(row: np.ndarray) -> np.ndarray:
    """The place of each element among equal neighbours, from 0."""
    if not len(row):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)]))


def _block_top(folder: str, parts: int, k: int, skip_self: bool, digits: int | None, lists: bool = False):
    """A block of queries against the stored corpus, or every ``parts``-th piece of it. lists: one row a query."""

    def run(t: pa.Table) -> pa.Table:
        asks = t.filter(pa.compute.equal(t.column("kind"), 1))
        q_id = asks.column("id").to_numpy()
        piece = t.column("part")[0].as_py()
        best = Best(len(q_id), k)
        if len(q_id):
            q = np.asarray(asks.column("v").combine_chunks().flatten(), np.float64).reshape(len(q_id), -1)
            mask = t.filter(pa.compute.equal(t.column("kind"), 2))
            at, item, by = mask.column("asker").to_numpy(), mask.column("id").to_numpy(), np.argsort(q_id, kind="stable")
            r = np.searchsorted(q_id[by], at)
            known = r < len(q_id)
            at, item, r = at[known], item[known], by[r[known]]
            item, r = item[q_id[r] == at], r[q_id[r] == at]
            # products in single precision only tell what may be among the best; their error is far below 2e-5 of the lengths
            rough = np.float32 if q.shape[1] >= 16 else np.float64
            q_rough, slack = q.astype(rough), (2e-5 if rough is np.float32 else 1e-12) * np.maximum(np.sqrt((q * q).sum(1)), 1e-12)
            for j, b in enumerate(stored_batches(folder, ["id", "v"], CORPUS_BLOCK)):
                if j % parts != piece or not b.num_rows:
                    continue
                d_id = b.column("id").to_numpy()
                d = np.asarray(b.column("v").flatten(), np.float64).reshape(len(d_id), -1)
                order = np.argsort(d_id, kind="stable")
                d_id, d = d_id[order], d[order]
                s = q_rough @ d.astype(rough).T
                if skip_self:
                    s[q_id[:, None] == d_id[None]] = -np.inf
                c = np.searchsorted(d_id, item)
                met = c < len(d_id)
                met[met] = d_id[c[met]] == item[met]
                s[r[met], c[met]] = -np.inf
                room = slack * max(1.0, float(np.sqrt((d * d).sum(1).max())))
                least = best.kth - room
                if (best.kth == -np.inf).any() and s.shape[1] > k:
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * room)
                rows, cols = np.nonzero((s >= least[:, None].astype(rough)) & np.isfinite(s))
                for lo in range(0, len(rows), 20_000):
                    x, y = rows[lo : lo + 20_000], cols[lo : lo + 20_000]
                    sim = np.einsum("ij,ij->i", q[x], d[y])
                    best.add(x, d_id[y], sim if digits is None else np.round(sim, digits) + 0.0)
        row, item, sim = best.merge()
        # an id that asks twice is one query
        row = q_id[row]
        order = np.lexsort((item, -sim, row))
        row, item, sim = row[order], item[order], sim[order]
        rk = _place(row) + 1
        some = rk <= k
        if lists:
            row, item, sim = row[some], item[some], sim[some]
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            ends = pa.array(np.r_[start, len(row)], pa.int32())
            return pa.table({"key": pa.array(row[start], pa.int64()), "items": pa.ListArray.from_arrays(ends, pa.array(item, pa.int64())), "sims": pa.ListArray.from_arrays(ends, pa.array(sim, pa.float64()))})
        return pa.table({"query_id": pa.array(row[some], pa.int64()), "item_id": pa.array(item[some], pa.int64()), "sim": pa.array(sim[some], pa.float64()), "rk": pa.array(rk[some], pa.int32())})

    return run


def exact_topk(corpus: DataFrame, queries: DataFrame, k: int, skip_self: bool = False, digits: int | None = None, exclude: DataFrame | None = None, lists: bool = False) -> DataFrame:
    """(query_id, item_id, sim, rk): the k items with the largest inner product, ties to the smaller id.

    ``digits``: inner products are rounded first, so that equal vectors tie whatever the order of additions.
    ``exclude``: (query_id, item_id) that don't count; they go to the blocks they concern.
    ``lists``: (key, items, sims) instead, one row a query, as store_lists makes them, without rows in between where a block sees the whole corpus.

    corpus, queries: id bigint, v array of one length. The corpus is written once to the checkpoint folder; each block of
    queries reads it piece by piece and keeps its best, so no vector of the corpus is shuffled and nothing is broadcast.
    Few blocks of queries are repeated for parts of the corpus, so that all cores have work.
    """
    spark = corpus.sparkSession
    folder = stored(corpus.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v")))
    nc = max(1, -(-spark.read.parquet(folder).count() // CORPUS_BLOCK))
    nq = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = min(nc, -(-spark.sparkContext.defaultParallelism // nq))
    block = F.pmod(F.xxhash64(F.col("id").cast("bigint")), F.lit(nq)).cast("int")
    none = F.lit(None).cast("bigint")
    rows = queries.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(1).alias("kind"), none.alias("asker"), block.alias("qb"))
    if exclude is not None:
        asker = F.col("query_id").cast("bigint")
        x = exclude.select(F.col("item_id").cast("bigint").alias("id"), F.lit(None).cast("array<double>").alias("v"), F.lit(2).alias("kind"), asker.alias("asker"), F.pmod(F.xxhash64(asker), F.lit(nq)).cast("int").alias("qb"))
        rows = rows.unionByName(x.where("id is not null and asker is not null"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if nq * parts > 1:
        rows = rows.repartition(min(nq * parts, 4 * shuffle_width(rows)), "qb", "part")
    if lists and parts == 1:
        return rows.groupBy("qb", "part").applyInArrow(_block_top(folder, parts, k, skip_self, digits, True), "key bigint, items array<bigint>, sims array<double>")
    near = rows.groupBy("qb", "part").applyInArrow(_block_top(folder, parts, k, skip_self, digits), "query_id bigint, item_id bigint, sim double, rk int")
    near = near if parts == 1 else top_per_group(near.drop("rk"), ["query_id"], [F.desc("sim"), "item_id"], k)
    return as_lists(near, "query_id") if lists else near


def as_lists(near: DataFrame, key: str) -> DataFrame:
    """Neighbour lists (key, items, sims) of rows (key, item_id, sim)."""
    rows = near.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("item_id", "sim")).alias("l"))
    return rows.select("key", F.col("l.item_id").alias("items"), F.col("l.sim").alias("sims"))


def weighted_vector(rated: DataFrame, vectors: DataFrame) -> DataFrame:
    """(profile_id, pos, value): sum of w v over sum of |w|, by profile and position, scaled to unit length.

    rated: profile_id, id, w; vectors: id, v. Weights of zero don't count; profiles without others give no row.
    """
    parts = rated.where("w != 0").join(vectors, "id").select("profile_id", "w", F.posexplode("v").alias("pos", "x"))
    sums = parts.groupBy("profile_id", "pos").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum(F.abs("w"))).alias("value"))
    length = sums.groupBy("profile_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("len")).where("len > 0")
    return sums.join(length, "profile_id").select("profile_id", "pos", (F.col("value") / F.col("len")).alias("value"))


def as_vectors(cells: DataFrame, key: str) -> DataFrame:
    """(key, v) from (key, pos, value)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return cells.groupBy(key).agg(F.transform(ordered, lambda s: s["value"]).alias("v"))
