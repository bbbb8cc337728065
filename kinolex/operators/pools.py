"""Neighbour lists of a profile's items, gathered without joining: profiles x items x neighbours are never rows.

Neighbour lists and what is known of the items are written once (session.stored). Slices of profiles, each of a bounded
number of rows, read of both what they need, so the memory of a task follows its slice and nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolex.operators.knn import as_lists
from kinolex.session import shuffle_width, stored, stored_batches

SLICE = 40_000


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark rounds, halves of the decimal form away from zero."""
    y = np.abs(x) * 10.0**digits
    return np.sign(x) * np.floor(y * (1 + 1e-15) + 0.5) / 10.0**digits + 0.0


def store_lists(near: DataFrame, key: str) -> str:
    """Neighbour lists (key, items, sims) of rows (key, item_id, sim), stored."""
    return stored(as_lists(near, key))


class Lists:
    """The stored lists of some keys (sorted, distinct); key ``at`` has items[start[at] : start[at + 1]]. kinds: another column of lists, if stored."""

    def __init__(self, path: str, keys: np.ndarray, kinds: str | None = None):
        found, n, items, sims, more = [], [], [], [], []
        for b in stored_batches(path, ["key", "items", "sims", *[kinds] * bool(kinds)], 4096):
            k = b.column("key").to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(np.isin(k, keys)))
            found.append(b.column("key").to_numpy(zero_copy_only=False))
            n.append(b.column("items").value_lengths().to_numpy(zero_copy_only=False))
            items.append(np.array(b.column("items").flatten()))
            sims.append(np.array(b.column("sims").flatten()))
            if kinds:
                more.append(np.array(b.column(kinds).flatten()))
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        self.key, self.n, self.items, self.sims = join(found, np.int64), join(n, np.int64), join(items, np.int64), join(sims, np.float64)
        self.kinds = join(more, np.int8)
        self.start = np.r_[0, np.cumsum(self.n)]
        self.by = np.argsort(self.key, kind="stable")

    def lists(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in keys, place of the list) of the keys that have one."""
        at = np.searchsorted(self.key, keys, sorter=self.by)
        known = np.flatnonzero(at < len(self.key))
        known = known[self.key[self.by[at[known]]] == keys[known]]
        return known, self.by[at[known]]

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in keys, place in items) of all neighbours of the keys, in their order; keys without a list have none."""
        known, own = self.lists(keys)
        n = self.n[own]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(known, n), np.repeat(self.start[own], n) + inner


def about(path: str, key: str, keys: np.ndarray) -> pa.Table:
    """The stored rows of some keys."""
    some = pa.array(keys)
    parts = [b.filter(pc.is_in(b.column(key), some)) for b in stored_batches(path, None, 4096)]
    return pa.Table.from_batches(parts) if parts else pa.table({})


def keep_among(rows: DataFrame, column: str, path: str, key: str) -> DataFrame:
    """The rows whose bigint ``column`` is among the stored ``key``s, without a shuffle: each task reads the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column(key).drop_null().to_numpy() for b in stored_batches(path, [key], 65_536))]))
        for b in batches:
            some = b.column(column).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(keys[np.minimum(np.searchsorted(keys, some), len(keys) - 1)] == some if len(keys) else np.zeros(len(some), bool)))

    return rows.mapInArrow(run, rows.schema)


def by_slices(rows: DataFrame, profile: str, fold: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, size: int = SLICE, least: int | None = None) -> DataFrame:
    """``fold`` of each slice of profiles: some ``size`` rows, a profile's rows following one another and never divided. least: of slices."""
    n = max(1, -(-rows.count() // size), least or shuffle_width(rows))
    laid = rows.withColumn("_s", F.pmod(F.xxhash64(profile), F.lit(n)).cast("int")).repartition(n, "_s").sortWithinPartitions("_s", profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            s = b.column("_s").to_numpy()
            for part in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1) if len(s) else []:
                if held and held[-1].column("_s")[0].as_py() != s[part[0]]:
                    yield from fold(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(part[0], len(part)))
        if held:
            yield from fold(pa.Table.from_batches(held))

    return laid.mapInArrow(run, schema)


def groups(column: pa.ChunkedArray) -> list[slice]:
    """Runs of equal values of a sorted column."""
    new = np.flatnonzero(np.r_[True, np.diff(column.fill_null(np.iinfo(np.int64).min).to_numpy()) != 0])
    return [slice(a, b) for a, b in zip(new, [*new[1:], len(column)])]
