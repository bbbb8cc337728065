"""A mixture of documents in which every source has its target share of the tokens.

1. Tokens of every text are counted with a public tokenizer.
2. Documents of a source are laid out, in a seeded order and by shards, in blocks of nearly equal numbers of tokens.
3. Sainte-Lague apportionment gives each source its number of blocks: one at a time to the highest quotient
   share / (2 given + 1), no source beyond its blocks times its repeats. The same divides a source's blocks among groups
   of shards, of which there are at most MOST_GROUPS, and, distributed, those of a group among its shards. Shards hold
   SHARD_TOKENS whatever the size of the collection.
4. Each shard takes whole passes over its blocks, and for the rest blocks in a seeded order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolex.session import cut, spread

BLOCK_TOKENS = 512
SHARD_TOKENS, MOST_GROUPS = 5_000_000, 1_024
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that divides a text before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """(all columns but the text, n_tokens): tokens of each text; 0 for null and empty ones. path: a tiktoken file on every host."""
    kept = [c for c in df.columns if c != text]
    schema = df.select(*kept, F.lit(0).cast("bigint").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    return spread(df.select(*kept, text)).mapInArrow(run, schema)


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients vote / (2 given + 1); nobody gets more than the cap, ties go to the earlier one.

    Fewer seats are given out only if all caps are reached (or all votes are zero).
    """
    v = np.asarray(votes, float)
    cap = np.where(v > 0, np.asarray(caps, np.int64), 0)
    seats = int(min(seats, cap.sum()))
    given = np.zeros(len(v), np.int64)
    if seats > 4 * len(v):  # start just below: the divisor method is house-monotone
        lo, hi = 0.0, float(v.max())
        for _ in range(200):
            d = (lo + hi) / 2
            got = np.minimum(cap, np.floor(v / d + 0.5)) if d > 0 else cap
            lo, hi = (d, hi) if got.sum() > seats else (lo, d)
        given = np.maximum(0, np.minimum(cap, np.floor(v / (hi * (1 + 1e-9)) + 0.5)).astype(np.int64) - 1)
    heap = [(-v[i] / (2 * given[i] + 1), i) for i in range(len(v)) if given[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < cap[i]:
            heapq.heappush(heap, (-v[i] / (2 * given[i] + 1), i))
    return given.tolist()


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, repeats, target_share, actual_share): the documents of the mixture and how often each is used.

    docs: doc_id, source, text; targets: source, target_share, max_repeats (one row per source; a handful of rows).
    total_tokens: size of the mixture, by default the tokens of all texts. Rows of other or no source, with a null
    doc_id, or without tokens stay out; a target without a share, with no documents or no repeats gets nothing, and
    what a source can't supply within its repeats goes to the others by their quotients. actual_share: of the
    mixture's tokens, by source.
    """
    goal = {r.source: (float(r.target_share or 0), max(0, r.max_repeats if r.max_repeats is not None else 1)) for r in targets.where(F.col("source").isNotNull()).collect()}
    counted = cut(with_tokens(docs.select("doc_id", "source", "text"), "text", path).where("n_tokens > 0"))
    by_source = counted.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    size = total_tokens or sum(r.n for r in by_source.agg(F.sum("n").alias("n")).collect() if r.n)
    shards = int(max(1, -(-(size or 0) // SHARD_TOKENS)))
    rows = counted.where(F.col("doc_id").isNotNull() & F.col("source").isin([s for s in goal]))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).cast("int"))
    held = rows.groupBy("source", "shard").agg(F.sum("n_tokens").alias("held"))
    held = held.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("held") / BLOCK_TOKENS)).cast("int")).withColumn("part", F.col("shard") % MOST_GROUPS)
    held = cut(held)
    groups = held.groupBy("source", "part").agg(F.sum("held").alias("held"), F.sum("blocks").alias("blocks")).orderBy("source", "part").collect()  # MOST_GROUPS a source
    sources = sorted(goal)
    per_source = [sum(g.blocks for g in groups if g.source == x) for x in sources]
    quota = sainte_lague([goal[s][0] for s in sources], round((size or 0) / BLOCK_TOKENS), [b * goal[s][1] for s, b in zip(sources, per_source)])
    plan = {}
    for s, q in zip(sources, quota):
        own = [g for g in groups if g.source == s]
        for g, n in zip(own, sainte_lague([g.held for g in own], q, [g.blocks * goal[s][1] for g in own])):
            plan[s, g.part] = n

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        s = pdf["source"].iloc[0]
        got = np.array(sainte_lague(pdf["held"].tolist(), plan[s, pdf["part"].iloc[0]], (pdf["blocks"] * goal[s][1]).tolist()))
        return pdf[["source", "shard", "held", "blocks"]].assign(passes=got // pdf["blocks"], rest=got % pdf["blocks"])

    spark = docs.sparkSession
    table = held.groupBy("source", "part").applyInPandas(divide, "source string, shard int, held bigint, blocks int, passes int, rest int")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(table, ["source", "shard"])
    middle = (F.col("before") + F.col("n_tokens") / 2) * F.col("blocks") / F.col("held")
    laid = laid.withColumn("block", F.least(F.floor(middle).cast("int"), F.col("blocks") - 1))
    ranked = table.select("source", "shard", "rest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    seeded = Window.partitionBy("source", "shard").orderBy(F.xxhash64("block", "source", "shard", F.lit(seed + 2)), "block")
    ranked = ranked.withColumn("extra", (F.row_number().over(seeded) <= F.col("rest")).cast("int")).select("source", "shard", "block", "extra")
    used = laid.join(ranked, ["source", "shard", "block"]).withColumn("repeats", F.col("passes") + F.col("extra")).where("repeats > 0")
    used = cut(used.select("doc_id", "source", "n_tokens", "repeats"))
    sums = {r.source: r.n for r in used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).collect()}
    whole = sum(sums.values()) or 1
    share = spark.createDataFrame([(s, goal[s][0], sums.get(s, 0) / whole) for s in sources], "source string, target_share double, actual_share double")
    return used.join(F.broadcast(share), "source").select("doc_id", "source", "n_tokens", "repeats", "target_share", "actual_share")
