"""Sentences of texts in many languages and scripts, with their places.

Fixed by definition: a blank line ends a sentence, nothing between a pair of quotation marks or brackets does, white
space next to Thai letters does. Everywhere else a candidate boundary (a terminator with the closing marks after it) is
classified by a maximum-entropy model. The model is trained here, on the candidates of at most SAMPLE documents:

* reliable boundaries: candidates at the end of a paragraph, with the start of another paragraph as what follows;
* reliable non-boundaries: candidates before a small letter;
* the rest: how often a kind of candidate (its word, or number with the word before, terminator and closing mark) ends
  a paragraph tells whether it ends sentences at all; that gives the weight with which it counts as either. Kinds are
  counted in all documents.

Every text is read once: its candidates and their features are written to the checkpoint folder together with the counts
of the kinds; once the model is trained, scores are a gather and a sum over these arrays.
"""

from __future__ import annotations

import math
import pickle
import random
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolex.session import cut, spread

SAMPLE, EPOCHS, STEP, SEED = 8_000, 8, 16, 5
SLOTS, WIDTH = 1 << 17, 14  # of the weights; of a candidate's features, those that are missing are SLOTS
WORD, AHEAD = 40, 24  # characters by which features know the word before and what follows

# Marks that may end a sentence, opening and closing marks, and quotation marks that do both.
TERMINATORS = ".!?…。！？．｡।॥؟۔‼⁇⁈⁉"
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "‘": "’", "‚": "‘’", "「": "」", "『": "』", "（": "）", "［": "］", "《": "》", "〈": "〉", "【": "】", "〔": "〕", "｢": "｣"}
CLOSERS = set(")]}”“»«›’‘」』）］》〉】〕｣\"'")

_TERM = re.compile(f"[{re.escape(TERMINATORS)}]+")
_BREAK = re.compile(r"[^\S\n]*(?:\r\n|\n|\r| )(?:[^\S\n]*(?:\r\n|\n|\r| ))+\s*| \s*")
_MARK = re.compile("[" + re.escape("".join(sorted(set(PAIRS) | CLOSERS))) + "]")
_THAI = re.compile("[฀-๿]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=\S)|(?<=\S)\s+(?=[฀-๿])")


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x2000:
        return "latin"
    for lo, hi, name in ((0x370, 0x400, "greek"), (0x400, 0x530, "cyrillic"), (0x590, 0x600, "hebrew"), (0x600, 0x780, "arabic"), (0x8A0, 0x900, "arabic"), (0x900, 0xE00, "indic"), (0xE00, 0xE80, "thai"), (0x2E80, 0xA4D0, "cjk"), (0xAC00, 0xD7B0, "hangul"), (0xF900, 0xFB00, "cjk"), (0xFF00, 0xFFEF, "cjk"), (0x20000, 0x32000, "cjk")):
        if lo <= o < hi:
            return name
    return "other"


def pairs_of(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Outermost spans (opening place, place after the closing mark) of matched marks in a paragraph, in order."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _MARK.finditer(text, lo, hi):
        ch, at = m.group(), m.start()
        before = text[at - 1] if at > lo else " "
        after = text[at + 1] if at + 1 < hi else " "
        if ch in "'’" and before.isalnum() and after.isalnum():
            continue  # an apostrophe
        closes = -1
        for k in range(len(stack) - 1, -1, -1):
            o = stack[k][0]
            if ch in PAIRS.get(o, o):
                closes = k
                break
        if ch in "\"'":
            opens = (before.isspace() or not before.isalnum() and before not in TERMINATORS + ",") and not after.isspace()
            if closes >= 0 and (ch == '"' or not after.isalnum()) and not (opens and before.isspace()):
                pass
            elif opens and closes < 0:
                stack.append((ch, at))
                continue
            else:
                continue
        elif ch == "’" and closes < 0:
            continue
        if closes >= 0 and not (ch in "»«" and closes < 0):
            _, start = stack[closes]
            del stack[closes:]
            spans.append((start, at + 1))
        elif ch in PAIRS:
            stack.append((ch, at))
    out: list[tuple[int, int]] = []
    for s in sorted(spans):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[1] > out[-1][1]:
            out[-1] = (out[-1][0], s[1])
    return out


class Candidate:
    """A place where a sentence may end. kinds: keys by which candidates count as alike, the most particular first."""

    __slots__ = ("end", "start", "next", "prev", "prev2", "term", "closer", "at_start", "script", "gap", "final", "kinds")

    def keys(self) -> tuple[tuple, ...]:
        if self.kinds is None:
            self.kinds = self._keys()
        return self.kinds

    def _keys(self) -> tuple[tuple, ...]:
        if self.closer:
            return ((self.script, "", self.term, self.closer, self.at_start),)
        if self.term != ".":
            return ((self.script, "", self.term, "", False),)
        own = (self.script, self.prev, ".", "", False)
        if self.prev == "0" or len(self.prev) <= 4:
            shape = "A" if len(self.prev) == 1 and self.prev.isupper() else self.prev
            return ((self.script, f"{self.prev2} {shape}", ".", "", False), own)
        return (own,)


def _word_before(text: str, lo: int, at: int) -> tuple[str, int]:
    """The word that ends at ``at`` (digits as 0, small letters; its last WORD characters) and where it begins."""
    tail = text[max(lo, at - WORD) : at][::-1]
    stop = _STOP.search(tail)
    w = tail[: stop.start()] if stop else tail
    return _known(w[::-1]), at - len(w)


_STOP = re.compile(r"[\s" + re.escape("".join(sorted(set(PAIRS) | CLOSERS))) + "]")


@lru_cache(maxsize=1 << 16)
def _known(w: str) -> str:
    w = w.strip(",;:¿¡")
    if w and _script(w[-1]) in ("cjk",):
        return ""
    glued = re.match(r"[^\W\d_]{4,}[.!?…]+(?=[^\W\d_])", w)
    if glued:  # the end of another sentence without white space
        w = w[glued.end() :]
    w = re.sub(r"\d+(?:[.,:/]\d+)*", "0", w)
    return w if len(w) == 1 else w.lower()


def candidates(text: str, lo: int, hi: int) -> list[Candidate]:
    """Candidate boundaries of the paragraph text[lo:hi]."""
    spans = pairs_of(text, lo, hi)
    starts, inner = [s for s, _ in spans], spans
    out: list[Candidate] = []

    def span_at(at: int):
        k = bisect_left(starts, at + 1) - 1
        return inner[k] if k >= 0 and inner[k][0] <= at < inner[k][1] else None

    done, seen, letter_script = lo, lo, "latin"
    for m in _TERM.finditer(text, lo, hi):
        s, e = m.span()
        letter = next((ch for ch in reversed(text[seen:s]) if ch.isalpha()), None)
        seen, letter_script = s, _script(letter) if letter else letter_script
        if e <= done:
            continue
        span, opened = span_at(s), None
        if span:
            # inside a pair: only the closing mark right after may end the sentence
            tail = e
            while tail < span[1] and (text[tail] in CLOSERS or text[tail].isspace()):
                tail += 1
            if tail < span[1]:
                continue
            opened, e = span[0], span[1]
        while e < hi and text[e] in CLOSERS and not (nxt_span := span_at(e)):
            e += 1
        if e < hi and opened is None and text[e] in TERMINATORS:
            continue
        c = Candidate()
        c.kinds = None
        c.end, c.term = e, m.group() if len(m.group()) == 1 else (m.group()[0] * 2 if len(set(m.group())) == 1 else m.group()[:1] + "+")
        k = e
        while k < hi and text[k].isspace():
            k += 1
        c.gap = "end" if k >= hi else "none" if k == e else "line" if "\n" in text[e:k] else "blank"
        c.final = k >= hi
        c.next = text[k : k + AHEAD]
        c.start = k
        c.closer = text[e - 1] if e > m.end() else ""
        c.prev, begin = _word_before(text, lo, s)
        c.script = _script(text[s - 1]) if s > lo else "other"
        if c.script == "latin" and s > lo and not text[s - 1].isalpha():
            c.script = letter_script  # of the last letter before
        c.prev2, c.at_start = "", False
        if c.term == "." and len(c.prev) <= 4:
            q = begin
            while q > lo and text[q - 1].isspace():
                q -= 1
            if q == lo or text[q - 1] in CLOSERS:
                c.prev2 = "^"
            elif text[q - 1] in TERMINATORS:
                w = _word_before(text, lo, q - 1)[0]
                most = 4 if c.prev == "0" else 2
                c.prev2 = ("A" if len(w) == 1 and w.isupper() else w) + "." if 0 < len(w) <= most and text[q - 1] == "." else "^"
            else:
                c.prev2 = _word_before(text, lo, q)[0].lower()
        if opened is not None:
            q = opened
            while q > lo and text[q - 1].isspace():
                q -= 1
            c.at_start = q == lo or text[q - 1] in TERMINATORS or text[q - 1] in CLOSERS
        if not c.final and c.gap == "none" and not _glued(text, s, c):
            continue
        if c.next[:1] in ",;:)]}،、，；：-–/" or c.next[:1] in TERMINATORS:
            continue
        out.append(c)
        done = e
    return out


_PLAIN = re.compile(r"[^\W\d_]+(?=[\s,;:])")  # words that no dot follows


def _glued(text: str, s: int, c: Candidate) -> bool:
    """Whether a terminator without white space after it may end a sentence."""
    n = c.next[:1]
    if c.script in ("cjk", "hangul") or _script(n) == "cjk" and c.term[0] not in ".":
        return not (c.term == "." and n.isdigit())
    if c.term[0] in "।॥؟۔":
        return True
    if c.term == "." and not c.closer:
        k = s
        while k and text[k - 1].isalpha():
            k -= 1
        w = text[k:s]
        if len(w) < 2 or text[k - 1 : k] == ".":
            return False
        caseless = w.lower() == w.upper()
        return (n.isupper() and (w[1:].islower() and len(c.next) > 1 and (c.next[1].islower() or not c.next[1].isalnum()))) or (caseless and n.isalpha()) or n in "“«„¿¡(‘" and w[1:].islower()
    return n.isupper() or n in "“«„¿¡(‘\"'" or (n.isalpha() and n.lower() == n.upper())


def features(c: Candidate, following: str, gap: str) -> list[int]:
    """WIDTH numbers of features."""
    kind, word = _ahead(following)
    return [word, *_hashed(c.term, c.script, c.prev, c.closer, c.at_start, kind, gap), *_kinds(c.keys())]


@lru_cache(maxsize=1 << 16)
def _ahead(following: str) -> tuple[str, int]:
    n = following[:1]
    word = re.match(r"[^\W_]*", following).group().lower()[:12]
    kind = "lower" if n.islower() else "upper" if n.isupper() else "digit" if n.isdigit() else "letter" if n.isalpha() else "open" if n in PAIRS or n in "\"'¿¡" else "mark"
    return kind, hash_of("w" + word)


@lru_cache(maxsize=1 << 16)
def _hashed(term: str, script: str, prev: str, closer: str, at_start: bool, kind: str, gap: str) -> tuple[int, ...]:
    shape = "0" if prev == "0" else f"{min(len(prev), 6)}{'.' in prev}{prev.isalpha()}{prev.isupper()}"
    f = [
        "b", f"t{term}", f"s{script}", f"n{kind}", f"st{script}{term}", f"nt{kind}{term}", f"g{gap}{kind}",
        f"sh{shape}{term}", f"shn{shape}{kind}{term}", f"c{closer}{at_start}{script}{term}", f"cn{closer}{at_start}{kind}",
    ]
    return tuple(map(hash_of, f))


@lru_cache(maxsize=1 << 16)
def _kinds(keys: tuple[tuple, ...]) -> tuple[int, ...]:
    return (*(hash_of(f"k{k}") for k in keys), *[SLOTS] * (2 - len(keys)))


def hash_of(x: str) -> int:
    return crc32(x.encode()) % SLOTS


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Spans between blank lines, without outer white space."""
    at = 0
    for m in _BREAK.finditer(text):
        yield from _trimmed(text, at, m.start())
        at = m.end()
    yield from _trimmed(text, at, len(text))


def _trimmed(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    while lo < hi and text[lo].isspace():
        lo += 1
    while hi > lo and text[hi - 1].isspace():
        hi -= 1
    if lo < hi:
        yield lo, hi


class Sample:
    """What the sampled texts give: candidates, openings of paragraphs, and the kinds that are to be counted."""

    def __init__(self, texts: list[str]):
        self.found: list[Candidate] = []
        self.opening: dict[str, list[str]] = {}
        for t in dict.fromkeys(texts):  # a text that is repeated is no further evidence
            for lo, hi in paragraphs(t):
                own = candidates(t, lo, hi)
                self.found += own
                if own:
                    self.opening.setdefault(_script(t[lo]) if t[lo].isalpha() else own[0].script, []).append(t[lo : lo + AHEAD])
        keys = sorted({k for c in self.found for k in c.keys()})
        self.keys = {k: i for i, k in enumerate(keys)}
        self.words = {w: i for i, w in enumerate(sorted({k[1] for k in keys if len(k[1]) > 2}))}


LONG_END, LONG_MID = "long end", "long mid"  # counted besides the kinds: candidates after words of six letters and more


def counts_of(text: str, found: list[Candidate], keys: dict[tuple, int], words: dict[str, int]) -> Counter:
    """Ends ("e", kind) and others ("m", kind) of the candidates, and words ("a", word) that no dot follows."""
    n: Counter = Counter()
    for c in found:
        if not c.final and c.next[:1].islower():
            continue
        for key in c.keys():
            if len(key[1]) >= 6:
                n[LONG_END if c.final else LONG_MID, 0] += 1
            if key in keys:
                n["e" if c.final else "m", keys[key]] += 1
    for w, k in Counter(_PLAIN.findall(text.lower())).items():
        if w in words:
            n["a", words[w]] += k
    return n


def train(sample: Sample, counts: dict[tuple[str, int], int]) -> np.ndarray:
    """Weights of the maximum-entropy model; counts as from counts_of, over all texts."""
    rng = random.Random(SEED)
    of = lambda what, at: counts.get((what, at), 0)
    long_end, long_mid = of(LONG_END, 0), of(LONG_MID, 0)
    rate = min(0.6, max(0.02, (long_end + 1) / (long_end + long_mid + 2)))

    @lru_cache(maxsize=None)
    def ends_sentences(keys: tuple[tuple, ...]) -> float:
        """Posterior that candidates of this kind end sentences, from how many stand at a paragraph's end.

        The general key's posterior is the prior of the more particular one.
        """
        p = 0.0
        for depth, key in enumerate(reversed(keys)):
            e, m = of("e", sample.keys[key]), of("m", sample.keys[key])
            if depth:
                prior = min(0.9, max(0.02, p))
            elif len(key[1]) > 2 and of("a", sample.words[key[1]]) > e + m:  # a word that mostly stands without a dot
                prior = 0.9995
            else:
                prior = 0.98 if key[2] != "." or key[3] or len(key[1]) >= 6 else 0.85
            odds = math.log(prior / (1 - prior)) + e * math.log(rate / 0.002) + m * math.log((1 - rate) / 0.998)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        return p

    rows: list[list[int]] = []
    target: list[float] = []
    for c in sample.found:
        if c.final:
            pool = sample.opening.get(c.script)
            if not pool:
                continue
            gap = "none" if c.script == "cjk" else "line" if rng.random() < 0.1 else "blank"
            rows.append(features(c, rng.choice(pool), gap))
            target.append(1.0)
        else:
            rows.append(features(c, c.next, c.gap))
            target.append(0.0 if c.next[:1].islower() else ends_sentences(c.keys()))
    w, g2 = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-6)
    if not rows:
        return w
    x, y, order = np.array(rows), np.array(target), np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        some = order.permutation(len(x))
        for at in range(0, len(x), STEP):
            f, t = x[some[at : at + STEP]], y[some[at : at + STEP]]
            d = 1 / (1 + np.exp(-np.clip(w[f].sum(1), -30, 30))) - t
            slots, back = np.unique(f, return_inverse=True)
            g = np.bincount(back.ravel(), np.repeat(d, WIDTH), len(slots)) + 1e-5 * w[slots]
            g2[slots] += g * g
            w[slots] -= 0.3 * g / np.sqrt(g2[slots])
            w[SLOTS] = 0
    return w


def parsed(text: str) -> tuple[list[Candidate], list[tuple[int, int, int]], list[list[int]], list[Candidate]]:
    """(open, marks, numbers of features, all candidates): marks are (from, kind, to) in order, kind 0 a paragraph, 1 a
    fixed boundary from the end of what is before to the start of what follows, 2 one that the model decides."""
    marks, open_, found = [], [], []
    for lo, hi in paragraphs(text):
        own = candidates(text, lo, hi)
        found += own
        inner = [(c.end, 2, c.start) for c in own if not c.final]
        open_ += [c for c in own if not c.final]
        if _THAI.search(text, lo, hi):
            spans = pairs_of(text, lo, hi)
            inner += [(m.start(), 1, m.end()) for m in _THAI_GAP.finditer(text, lo, hi) if not any(s < m.start() < e for s, e in spans)]
        marks.append((lo, 0, hi))
        marks += sorted(inner)
    return open_, marks, [features(c, c.next, c.gap) for c in open_], found


def spans(at: np.ndarray, kind: np.ndarray, to: np.ndarray, cut_here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the sentences of paragraphs and boundaries that follow one another, and the mark that starts each."""
    para = kind == 0
    keep = para | cut_here
    start, end, p = to[keep].copy(), at[keep], para[keep]
    start[p] = end[p]  # a paragraph starts a sentence where it begins
    close = to[para][np.cumsum(p) - 1]  # the end of the own paragraph
    last = np.append(p[1:], True)
    stop = np.where(last, close, np.append(end[1:], 0))
    full = start < stop
    return start[full], stop[full], np.flatnonzero(keep)[full]


def split(text: str, w: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the sentences of a text."""
    _, marks, rows, _ = parsed(text)
    if not marks:
        return []
    at, kind, to = np.array(marks).T
    sure = kind == 1
    sure[kind == 2] = w[np.array(rows, np.int64).reshape(-1, WIDTH)].sum(1) > 0
    return [(int(a), int(b)) for a, b, _ in zip(*spans(at, kind, to, sure))]


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, end_pos) of every sentence, in code points.

    Null and blank texts give no row; rows are distinct, so rows repeated exactly count once; texts of any length are
    taken whole. The model is fitted to the SAMPLE rows whose key is smallest by hash, with the kinds of candidates
    counted in all rows; an empty table gives an empty result.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    sample = Sample([r.text for r in rows.orderBy(F.xxhash64("id"), "text").limit(SAMPLE).select("text").toLocalIterator()])
    counted = pickle.dumps((sample.keys, sample.words))
    lists = "at array<int>, kind array<int>, to array<int>, rows array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words = pickle.loads(counted)
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                n: Counter = Counter()
                out: list[list] = [[], [], [], []]
                for t in b.column("text").to_pylist():
                    _, marks, own, found = parsed(t)
                    n.update(counts_of(t, found, keys, words))
                    for o, v in zip(out, (*zip(*marks), [x for r in own for x in r]) if marks else [[]] * 4):
                        o.append(v)
                tally = [[{"what": k, "key": i, "n": c} for (k, i), c in n.items()]] + [[]] * (b.num_rows - 1)  # with the first row
                kind = pa.list_(pa.struct([("what", pa.string()), ("key", pa.int32()), ("n", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(o, pa.list_(pa.int32())) for o in out), pa.array(tally, kind)], names=["id", "at", "kind", "to", "rows", "tally"])

    kind = dict(rows.dtypes)["id"]
    read_once = cut(spread(rows).mapInArrow(read, f"id {kind}, {lists}, tally array<struct<what: string, key: int, n: bigint>>"))
    tally = read_once.select(F.explode("tally").alias("t")).groupBy("t.what", "t.key").agg(F.sum("t.n").alias("n")).collect()  # the sample's kinds
    w = train(sample, {(r.what, r.key): r.n for r in tally})
    used = np.flatnonzero(w)
    blob = pickle.dumps((used.astype(np.int32), w[used].astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, value = pickle.loads(blob)
        weights = np.zeros(SLOTS + 1, np.float32)
        weights[where] = value
        flat = lambda b, c: b.column(c).flatten().to_numpy(zero_copy_only=False)
        for b in batches:
            at, kind, to, feats = (flat(b, c) for c in ("at", "kind", "to", "rows"))
            sure = kind == 1
            sure[kind == 2] = weights[feats.reshape(-1, WIDTH)].sum(1) > 0
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(b.column("at").offsets)))
            start, end, mark = spans(at, kind, to, sure)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(owner[mark])), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["id", "start_pos", "end_pos"])

    found = read_once.select("id", "at", "kind", "to", "rows").mapInArrow(score, f"id {kind}, start_pos int, end_pos int")
    return found.distinct().toDF(key, "start_pos", "end_pos")
