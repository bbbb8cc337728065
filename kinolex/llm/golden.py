"""The best representative of each group of records, put together from consistent bundles of fields.

Fields that depend on one another form a bundle and are taken from one record together. A bundle may name columns in
which it must agree with every other bundle that names them too (functional dependencies between bundles). Of all
consistent choices of one candidate per bundle, the one with the least sum of weighted trust ranks is taken.

Three steps keep this distributed:
1. Dominance. Of the candidates of a bundle with the same values in the columns to agree in, only the most trusted can
   be in a best choice. That is an aggregation with map-side combination, so a group that holds a third of all rows
   shrinks to one row per distinct combination before anything is gathered.
2. Bound. A first choice, which follows the leading bundle's best candidate, bounds the cost; candidates whose rank
   alone costs more are dropped.
3. Branch and bound over the candidates that are left, group by group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolex.session import cut

MISSING_COST = 1_000_000


@dataclass(frozen=True)
class Bundle:
    """fields: columns taken together. valid: which records offer a value. trust: the larger the better, null the least.

    agree: columns whose values must be equal in all bundles that name them; null agrees with anything.
    """

    name: str
    fields: tuple[str, ...]
    valid: Column
    trust: Column
    agree: tuple[str, ...] = ()
    weight: int = field(default=1)


def _candidates(df: DataFrame, key: str, record: str, bundles: list[Bundle]) -> DataFrame:
    shared = sorted({c for b in bundles for c in b.agree})
    kinds = []
    for no, b in enumerate(bundles):
        sig = F.array(*[F.col(c).cast("string") if c in b.agree else F.lit(None).cast("string") for c in shared]) if shared else F.array().cast("array<string>")
        kinds.append(
            F.when(
                b.valid,
                F.struct(
                    F.lit(no).alias("bundle"),
                    sig.alias("sig"),
                    (-F.coalesce(b.trust.cast("double"), F.lit(float("-inf")))).alias("less"),
                    F.to_json(F.struct(*b.fields)).alias("vals"),
                ),
            )
        )
    each = (
        df.where(F.col(key).isNotNull() & F.col(record).isNotNull())
        .select(F.col(key).alias("_key"), F.col(record).cast("string").alias("_record"), F.explode(F.array(*kinds)).alias("c"))
        .where(F.col("c").isNotNull())
    )
    best = F.min(F.struct("c.less", "_record", "c.vals")).alias("best")
    return each.groupBy("_key", F.col("c.bundle").alias("bundle"), F.col("c.sig").alias("sig")).agg(best)


def _search(weights: list[int]):
    """Branch and bound per group: bundles in order, candidates by rank, cut where the bound isn't better."""

    def solve(cands: list[dict]) -> list[dict]:
        lists = [sorted((c for c in cands if c["bundle"] == b), key=lambda c: c["rk"]) for b in range(len(weights))]
        order = [b for b in range(len(weights)) if lists[b]]
        rest = [0] * (len(order) + 1)
        best_cost, best = float("inf"), []

        def go(at: int, cost: int, fixed: tuple, chosen: list) -> None:
            nonlocal best_cost, best
            if cost + rest[at] >= best_cost:
                return
            if at == len(order):
                best_cost, best = cost, list(chosen)
                return
            b = order[at]
            for c in lists[b]:
                if cost + weights[b] * c["rk"] + rest[at + 1] >= best_cost:
                    break
                if all(x is None or y is None or x == y for x, y in zip(c["sig"], fixed)):
                    merged = tuple(x if x is not None else y for x, y in zip(c["sig"], fixed))
                    go(at + 1, cost + weights[b] * c["rk"], merged, [*chosen, c])
            go(at + 1, cost + MISSING_COST * weights[b], fixed, chosen)  # the bundle stays empty

        go(0, 0, (None,) * (len(cands[0]["sig"]) if cands else 0), [])
        return best

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, cands in zip(pdf["_key"], pdf["cands"]):
                out += [(k, c["bundle"], c["record"], c["vals"]) for c in solve([*cands])]
            yield pd.DataFrame(out, columns=["_key", "bundle", "record", "vals"])

    return run


def best_bundles(df: DataFrame, key: str, record: str, bundles: list[Bundle]) -> DataFrame:
    """One row per group and bundle: key, bundle (name), record, vals (JSON of the bundle's fields).

    Rows with a null key or record are no group. A bundle without a valid candidate gives no row for the group; a
    bundle that fits no other stays empty only if no consistent choice fills it. Ties go to the smaller record as
    text. An empty table gives an empty result; columns not named are ignored.
    """
    cand = _candidates(df, key, record, bundles)
    kind = dict(cand.dtypes)["_key"]
    names = F.array(*[F.lit(b.name) for b in bundles])
    weight = F.element_at(F.array(*[F.lit(b.weight) for b in bundles]), F.col("bundle") + 1)
    by = Window.partitionBy("_key", "bundle").orderBy("best.less", "best._record", F.col("sig").cast("string"))
    ranked = cut(cand.withColumn("rk", F.row_number().over(by) - 1))
    lead = ranked.where("rk = 0").groupBy("_key").agg(F.min_by("sig", "bundle").alias("lead"))
    ranked = ranked.join(lead, "_key")
    # a first choice: everything that fits the leading candidate, and, as one value per column, each other
    exact = F.forall(F.zip_with("sig", "lead", lambda x, y: x.isNull() | x.eqNullSafe(y)), lambda x: x)
    first = ranked.groupBy("_key", "bundle").agg(F.min(F.when(exact, F.col("rk"))).alias("first"))
    cost = first.groupBy("_key").agg(F.sum(weight * F.coalesce("first", F.lit(MISSING_COST))).alias("ub"))
    ranked = ranked.join(cost, "_key")
    open_ = (
        ranked.where(weight * F.col("rk") <= F.col("ub"))
        .groupBy("_key")
        .agg(F.collect_list(F.struct("bundle", "sig", "rk", F.col("best._record").alias("record"), F.col("best.vals").alias("vals"))).alias("cands"))
    )
    solved = open_.mapInPandas(_search([b.weight for b in bundles]), f"_key {kind}, bundle int, record string, vals string")
    return solved.select(F.col("_key").alias(key), F.element_at(names, F.col("bundle") + 1).alias("bundle"), "record", "vals")
