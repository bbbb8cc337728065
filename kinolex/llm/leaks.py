"""Passages of evaluation items inside documents.

The items form an inverted index: a posting list per term with BM25 weights, cut into blocks of neighbouring items with
each block's largest weight. An item's weights are divided by the least score it needs, so 1 is the threshold of all.
Every passage of every document queries the index by block-max WAND, a batch of passages at a time:

1. Pivot: a passage's lists are ordered by their largest weight. Lists before the pivot can't reach 1 together, so every
   item that does stands in a list from the pivot on; a passage without a pivot ends here.
2. Blocks: only blocks of items that a list from the pivot on opens are looked at, and of these only those where the
   block maxima of all lists reach 1.
3. Postings in those blocks are scored; items that reach 1 are retrieved.

What an item needs follows from the task: a passage that holds RUN consecutive words of it scores at least the least sum
of weights of any RUN consecutive words, of which SLACK is asked for words that a document cuts otherwise. Words are
indexed by their parts, so hyphens between words cost nothing: a word that is hyphenated at a line end is looked up
joined and in parts. Verification compares letters and digits only, word by word of the item, on the whole document.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolex.session import spread

RUN, SLACK = 16, 0.7
ITEM_BLOCK, SEGMENT_CHARS = 8, 4_000_000
LEAST_OVERLAP = 32  # words that neighbouring passages share at least
K1, B = 1.2, 0.75

_CUT = "\x01"  # stands where a hyphen at a line end was
_WRAP = re.compile(r"[-­‐‑]\s*[\n\r ]\s*")
_UNSEEN = re.compile(r"[­\u200b\u200c\u200d\u200e\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f'’ʼ-]|[‐‑\x01])*")
_HYPHEN = re.compile(r"[-‐‑]")
_DROP = re.compile(r"[^\w]|_")
_ALNUM = re.compile(r"[^\W_]+")


def _fold(text: str) -> str:
    """One encoding and case, invisible characters gone, a mark where a line end cut a word."""
    return unicodedata.normalize("NFC", _UNSEEN.sub("", _WRAP.sub(_CUT, text)).casefold())


def _parts(word: str, pieces: bool) -> tuple[str, ...]:
    parts = []
    for p in _HYPHEN.split(word):
        parts.append(_DROP.sub("", p))
        if pieces and _CUT in p:
            parts += [_DROP.sub("", x) for x in p.split(_CUT)]
    return tuple(p for p in parts if p)


def words(text: str, pieces: bool = False) -> list[tuple[str, ...]]:
    """The parts of each word of a folded text: letters and digits between hyphens, apostrophes dropped.

    A part that a line end cut is given joined; with ``pieces`` its pieces follow, too.
    """
    return [_parts(w, pieces) for w in _WORD.findall(text)]


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions starts[k] .. starts[k] + counts[k] - 1 for all k, and their k."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(len(owner)) - first[owner] + starts[owner], owner


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order with their sums."""
    some, at = np.unique(key, return_inverse=True)
    return some, np.bincount(at, value, len(some))


class Index:
    """Posting lists of items with block maxima; postings and blocks of a term follow one another (CSR)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, parts = [], []
        for key, text in items:
            p = words(_fold(text))
            w = ["".join(x) for x in p]
            if len(w) >= RUN:
                self.items.append((key, w))
                parts.append(p)
        n = len(self.items)
        tf = [Counter(t for word in p for t in word) for p in parts]
        df = Counter(t for c in tf for t in c)
        self.vocabulary = {t: k for k, t in enumerate(sorted(df))}
        size = [sum(c.values()) for c in tf]
        mean = sum(size) / max(n, 1)
        self.overlap = LEAST_OVERLAP
        terms, owner, weight = [], [], []
        for i, (p, c) in enumerate(zip(parts, tf)):
            score = {}
            for t, f in c.items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                score[t] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size[i] / mean))
            runs = [{t for word in p[k : k + RUN] for t in word} for k in range(len(p) - RUN + 1)]
            self.overlap = max(self.overlap, *(2 * sum(map(len, p[k : k + RUN])) for k in range(len(p) - RUN + 1)))
            need = SLACK * min(sum(score[t] for t in r) for r in runs)
            for t, x in score.items():
                terms.append(self.vocabulary[t])
                owner.append(i)
                weight.append(x / need)
        terms, owner, weight = np.array(terms, np.int64), np.array(owner, np.int64), np.array(weight)
        order = np.lexsort((owner, terms))
        terms, self.item, self.weight = terms[order], owner[order], weight[order].astype(np.float32)
        every = np.arange(len(self.vocabulary) + 1)
        block = self.item // ITEM_BLOCK
        new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])])) if len(terms) else np.zeros(0, np.int64)
        self.block_of, self.block_post = block[new], np.concatenate([new, [len(terms)]])
        self.block_max = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0, np.float32)
        self.list_block = np.searchsorted(terms[new], every)
        self.list_max = np.maximum.reduceat(self.block_max, self.list_block[:-1]) if len(new) else np.zeros(0, np.float32)
        self.blocks = -(-n // ITEM_BLOCK)
        self.chunks: dict[int, list[str]] = {}  # of items looked at
        self.terms: dict[str, list[int]] = {}  # of words seen

    def retrieve(self, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all scores that are high enough; passages are arrays of distinct term numbers."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not passages or not self.items:
            return none
        least = 1 - 1e-4
        term = np.concatenate(passages)
        at = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
        order = np.lexsort((self.list_max[term], at))
        term, at = term[order], at[order]
        run = np.cumsum(self.list_max[term].astype(np.float64))
        begin = np.searchsorted(at, np.arange(len(passages)))
        before = np.concatenate([[0.0], run])[begin]
        from_pivot = run - before[at] >= least
        # blocks that lists from the pivot on open
        count = self.list_block[term + 1] - self.list_block[term]
        pos, own = _expand(self.list_block[term[from_pivot]], count[from_pivot])
        opened = np.unique(at[from_pivot][own] * self.blocks + self.block_of[pos])
        if not len(opened):
            return none
        live = np.isin(at, np.unique(opened // self.blocks))
        term, at, count = term[live], at[live], count[live]
        pos, own = _expand(self.list_block[term], count)
        cell = at[own] * self.blocks + self.block_of[pos]
        keep = _among(cell, opened)
        pos, cell = pos[keep], cell[keep]
        some, bound = _sums(cell, self.block_max[pos])
        keep = _among(cell, some[bound >= least])
        pos, passage = pos[keep], cell[keep] // self.blocks
        post, own = _expand(self.block_post[pos], self.block_post[pos + 1] - self.block_post[pos])
        some, score = _sums(passage[own] * len(self.items) + self.item[post], self.weight[post])
        some = some[score >= least]
        return some // len(self.items), some % len(self.items)

    def holds(self, stream: str, edges: tuple[set[int], set[int]], item: int) -> bool:
        """Whether RUN consecutive words of the item stand in a document's letters, from the start of a word to an end of one."""
        w, half = self.items[item][1], RUN // 2
        # every run of RUN words holds one whole chunk of half as many that starts at a multiple of the half
        if item not in self.chunks:
            self.chunks[item] = ["".join(w[k : k + half]) for k in range(0, len(w) - half + 1, half)]
        if not any(c in stream for c in self.chunks[item]):
            return False
        for k in range(len(w) - RUN + 1):
            run = "".join(w[k : k + RUN])
            at = stream.find(run)
            while at >= 0:
                if at in edges[0] and at + len(run) in edges[1]:
                    return True
                at = stream.find(run, at + 1)
        return False


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among ``some``, which is sorted."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def letters(text: str) -> tuple[str, tuple[set[int], set[int]]]:
    """The letters and digits of a folded text, and where words start and end in them."""
    parts = _ALNUM.findall(text.replace(_CUT, ""))
    ends, n = [], 0
    for p in parts:
        n += len(p)
        ends.append(n)
    return "".join(parts), ({0, *ends}, set(ends))


def passages_of(ix: Index, text: str) -> list[np.ndarray]:
    """Distinct known terms of each passage of a folded text; neighbours share ix.overlap parts of words."""
    known: list[int] = []
    for w in _WORD.findall(text):
        if (own := ix.terms.get(w)) is None:
            own = [ix.vocabulary.get(t, -1) for t in _parts(w, True)]
            if len(w) <= 64 and len(ix.terms) < 1 << 17:
                ix.terms[w] = own
        known += own
    out = []
    for s in range(0, max(1, len(known) - ix.overlap), 2 * ix.overlap):
        out.append(np.array(sorted({t for t in known[s : s + 3 * ix.overlap] if t >= 0}), np.int64))
    return out


def _scan(index: Index):
    blob = pickle.dumps(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = pickle.loads(blob)
        keys = [k for k, _ in ix.items]
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                folded = [_fold(t) for t in batch.column("text").to_pylist()]
                passages = [passages_of(ix, t) for t in folded]
                owner = np.repeat(np.arange(len(folded)), [len(p) for p in passages])
                at, item = ix.retrieve([p for some in passages for p in some])
                pairs = np.unique(np.stack([owner[at], item]), axis=1).T.tolist()
                docs, found, last = [], [], (-1, None)
                for d, i in pairs:
                    if d != last[0]:
                        last = d, letters(folded[d])
                    if ix.holds(*last[1], i):
                        docs.append(d)
                        found.append(keys[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(found, pa.int64())], names=["doc_id", "item_id"]
                )

    return run


def leaks(docs: DataFrame, items: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(doc_id, item_id) of the documents that hold at least RUN consecutive words of an item's text.

    docs: doc_id, text; items: item_id bigint, text; other columns are ignored. Null and blank texts and items of fewer
    words hold nothing; repeated rows count once. Items are indexed in segments of ``segment_chars`` characters (one
    that is longer is a segment of its own), so what a scan of the documents ships to the executors is bounded; there
    are as many scans as segments, one for some thousand items.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0)).select("doc_id", "text")
    items = items.where(F.col("item_id").isNotNull() & (F.length(F.trim("text")) > 0)).select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    kind = dict(docs.dtypes)["doc_id"]
    # a hash bucket holds about a 64th of a segment; consecutive buckets fill one
    chars = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    buckets = 64 * (1 + chars // segment_chars)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets)))
    sizes = items.groupBy("bucket").agg(F.sum(F.length("text")).alias("n"))
    filled = sizes.withColumn("segment", F.floor(F.sum("n").over(Window.orderBy("bucket")) / F.lit(segment_chars)))  # a row per bucket
    ranges = filled.groupBy("segment").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).orderBy("segment").collect()
    docs = spread(docs)
    out = docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id")).limit(0)
    for r in ranges:
        part = items.where(F.col("bucket").between(r.lo, r.hi)).orderBy("item_id", "text").select("item_id", "text").collect()
        found = docs.mapInArrow(_scan(Index([(x.item_id, x.text) for x in part])), f"doc_id {kind}, item_id bigint")
        out = found if r.segment == ranges[0].segment else out.unionByName(found)
    return out.distinct()
