"""Order-dependent merges: anchors take turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolex.operators.relational import keep_one, top_per_group
from kinolex.session import cut

FIRST_ANCHORS = 200
MORE = -1  # pick_no of a profile that needs more anchors


class _Fold:
    """The picks of one profile. Anchors are given in order, each with its whole queue."""

    def __init__(self, per: int, n: int):
        self.per, self.n = per, n
        self.picks: list[tuple] = []
        self.items, self.works = set(), set()
        self.kept: list[tuple[object, Iterator]] = []

    @property
    def full(self) -> bool:
        return len(self.picks) >= self.n

    def _take(self, anchor, queue: Iterator) -> bool:
        taken = 0
        while taken < self.per and not self.full and (item := next(queue, None)) is not None:
            i, work = item
            if i not in self.items and (work is None or work not in self.works):
                self.items.add(i)
                self.works.add(work)
                self.picks.append((i, anchor))
                taken += 1
        return taken > 0

    def first_turn(self, anchor, queue: list[tuple]) -> None:
        """An anchor that adds nothing now never will, since all its items are taken; so fewer than n are kept."""
        rest = iter(queue)
        if not self.full and self._take(anchor, rest):
            self.kept.append((anchor, rest))

    def finished(self) -> list[tuple]:
        while not self.full and any([self._take(a, q) for a, q in self.kept]):
            pass
        return self.picks


def _fold(per: int, n: int, first: int | None):
    """Rows come sorted by profile, anchor and place in the queue; what is held is one profile's picks and useful queues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["profile_id", "pick_no", "item_id", "anchor_id"]
        kinds: list = []
        profile, anchor, queue, seen, fold = None, None, [], 0, None

        def close(out: list[tuple]) -> None:
            if fold is None:
                return
            if first is None or seen <= first:
                fold.first_turn(anchor, queue)
            if first is not None and seen > first and not fold.full:
                out.append((profile, MORE, None, None))
            else:
                out += [(profile, k + 1, i, a) for k, (i, a) in enumerate(fold.finished())]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for b in batches:
            kinds = [b.column("profile_id").type, pa.int32(), b.column("item_id").type, b.column("anchor_id").type]
            out: list[tuple] = []
            for p, a, i, w in zip(*(b.column(c).to_pylist() for c in ("profile_id", "anchor_id", "item_id", "work"))):
                if fold is None or p != profile:
                    close(out)
                    profile, anchor, queue, seen, fold = p, a, [], 1, _Fold(per, n)
                elif a != anchor:
                    if first is None or seen <= first:
                        fold.first_turn(anchor, queue)
                    anchor, queue, seen = a, [], seen + 1
                queue.append((i, w))
            yield batch(out)
        if fold is not None:
            out = []
            close(out)
            yield batch(out)

    return run


def round_robin(cand: DataFrame, per: int, n: int, first: int = FIRST_ANCHORS) -> DataFrame:
    """(profile_id, pick_no, item_id, anchor_id): anchors take turns, each up to ``per`` items nobody has taken yet.

    cand: profile_id, anchor_order (the larger, the earlier; ties to the smaller anchor_id), anchor_id, item_id, score,
    and work, of which each is taken once (null: no work). Ends at n picks or when a full turn adds none. A queue needs
    no more than its n best items of different works. Profiles are folded over their ``first`` anchors; those that need
    more are folded again over all, so no anchor is lost.
    """
    work = F.coalesce(F.concat(F.lit("w"), F.col("work").cast("string")), F.concat(F.lit("i"), F.col("item_id").cast("string")))
    by = ["profile_id", "anchor_order", "anchor_id"]
    rows = keep_one(cand.select(*by, "item_id", "score", "work", work.alias("_u")), [*by, "_u"], [F.desc("score"), "item_id"])
    rows = cut(top_per_group(rows, by, [F.desc("score"), "item_id"], n, "_at"))
    turn = F.dense_rank().over(Window.partitionBy("profile_id").orderBy(F.desc("anchor_order"), "anchor_id"))
    kinds = dict(cand.dtypes)
    schema = f"profile_id {kinds['profile_id']}, pick_no int, item_id {kinds['item_id']}, anchor_id {kinds['anchor_id']}"

    def folded(some: DataFrame, limit: int | None) -> DataFrame:
        laid = some.repartition("profile_id").sortWithinPartitions("profile_id", F.desc("anchor_order"), "anchor_id", "_at")
        return laid.select("profile_id", "anchor_id", "item_id", "work").mapInArrow(_fold(per, n, limit), schema)

    early = rows.withColumn("_turn", turn).where(F.col("_turn") <= first + 1).drop("_turn")
    out = cut(folded(early, first))
    more = out.where(F.col("pick_no") == MORE).select("profile_id")
    if more.isEmpty():
        return out
    return out.where(F.col("pick_no") > 0).unionByName(folded(rows.join(more, "profile_id", "left_semi"), None))
