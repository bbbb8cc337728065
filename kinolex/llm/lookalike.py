"""One form for text that looks the same but is spelled with different characters.

Arrow's text is copied to one numpy array of code points per batch. A table of expansions (start and length by code
point) is gathered for all of it at once, marks are put in canonical order by one stable sort, and marks compose with
their bases in rounds over all bases at a time. No string function is called for a single row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinolex.operators.skew import pairs_in_groups, split_join
from kinolex.session import cut

# Cyrillic, Greek, Armenian, Cherokee and Lisu letters that are drawn as a Latin letter, and that letter.
LOOKALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I", "а": "a", "е": "e", "ѕ": "s", "і": "i",
    "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "ү": "y", "ӏ": "l", "Տ": "S", "Օ": "O", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓳ": "O", "ꓴ": "U",
    "ɡ": "g", "ɑ": "a", "ı": "i", "ꓲ": "I",
    "‐": "-", "‑": "-", "﹣": "-",
}
# Kinds of compatibility decomposition that leave the look as it is. Superscripts, circled and small forms and fractions do change it.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
_SIZE = sys.maxunicode + 1
# Fixed values, Hangul composition: first leading, vowel and trailing letter, first syllable, numbers of vowels and trailing letters.
_L, _V, _T, _S, _NV, _NT = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28


def _expansion(ch: str) -> str:
    """What a character becomes before its marks are put in order."""
    d = unicodedata.decomposition(ch)
    if d:
        parts = d.split()
        if parts[0][0] == "<":
            if parts[0] not in SAME_LOOK:
                return ch
            parts = parts[1:]
        return "".join(_expansion(chr(int(x, 16))) for x in parts)
    kind = unicodedata.category(ch)
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
        return " "
    o = ord(ch)
    if kind in ("Cf", "Cc") or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F:
        return ""
    if o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):  # joiners and fillers that aren't drawn
        return ""
    return LOOKALIKE.get(ch, ch)


@lru_cache(maxsize=1)
def tables():
    """Expansion start, length and pool by code point; combining class by code point; sorted pairs that compose, and what to."""
    start, length = np.zeros(_SIZE, np.int32), np.ones(_SIZE, np.int8)
    ccc = np.zeros(_SIZE, np.uint8)
    pool: list[int] = list(range(_SIZE))
    start[:] = np.arange(_SIZE)
    pairs: dict[int, int] = {}
    for o in range(_SIZE):
        if 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xE000 or 0x17000 <= o < 0x1B000 or 0x20000 <= o < 0x2F800 or 0x2FA20 <= o < 0xE0000 or o >= 0xF0000:
            continue  # unified ideographs, Hangul syllables (below), surrogates, unassigned planes
        ch = chr(o)
        if c := unicodedata.combining(ch):
            ccc[o] = c
        if (x := _expansion(ch)) != ch:
            start[o], length[o] = len(pool), len(x)
            pool += map(ord, x)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and len(p := d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            pairs[int(p[0], 16) << 21 | int(p[1], 16)] = o
    for s in range(19 * _NV * _NT):
        lv, t = s // _NT, s % _NT
        start[_S + s], length[_S + s] = len(pool), 2 + (t > 0)
        pool += [_L + lv // _NV, _V + lv % _NV] + ([_T + t] if t else [])
        if t:
            pairs[(_S + lv * _NT) << 21 | (_T + t)] = _S + s
        else:
            pairs[(_L + lv // _NV) << 21 | (_V + lv % _NV)] = _S + s
    keys = np.array(sorted(pairs), np.int64)
    return start, length, np.array(pool, np.uint32), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


def _composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What pairs of code points compose to, 0 where they don't."""
    *_, keys, to = tables()
    k = a.astype(np.int64) << 21 | b
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    return np.where(keys[at] == k, to[at], 0).astype(np.uint32)


def compose(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of decomposed code points; row: the row of each."""
    ccc = tables()[3]
    if not len(cp):
        return cp, row
    c = ccc[cp]
    begins = np.concatenate([[True], row[1:] != row[:-1]])
    if c.any():
        run = np.cumsum((c == 0) | begins)  # a starter and its marks; marks without a starter make a run of their own
        order = np.argsort(run.astype(np.int64) << 8 | c, kind="stable")
        cp, c = cp[order].copy(), c[order]
        base = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.concatenate([base, [len(cp)]]))
        gone = np.zeros(len(cp), bool)
        live = np.flatnonzero((c[base] == 0) & (size > 1))
        barrier = np.zeros(len(base), np.int16)  # class of the last mark that stayed
        for k in range(1, int(size.max())):
            live = live[size[live] > k]
            if not len(live):
                break
            mark = base[live] + k
            new = _composed(cp[base[live]], cp[mark])
            ok = (new > 0) & (barrier[live] < c[mark])
            cp[base[live[ok]]] = new[ok]
            gone[mark[ok]] = True
            barrier[live[~ok]] = c[mark[~ok]]
        cp, row, c = cp[~gone], row[~gone], c[~gone]
    for _ in range(2):  # starters that compose with the starter after them
        if len(cp) < 2:
            break
        new = _composed(cp[:-1], cp[1:])
        hit = np.flatnonzero((new > 0) & (row[:-1] == row[1:]) & (ccc[cp[1:]] == 0) & (ccc[cp[:-1]] == 0))
        if not len(hit):
            break
        hit = hit[np.concatenate([[True], np.diff(hit) > 1])]
        cp = cp.copy()
        cp[hit] = new[hit]
        keep = np.ones(len(cp), bool)
        keep[hit + 1] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def same_look(values: pa.Array) -> pa.Array:
    """The comparable form of every string; null stays null. Blanks at the ends go, runs of blanks become one."""
    n = len(values)
    text = values.cast(pa.large_string()).fill_null("")
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, text.offset * 8)
    raw = bytes(memoryview(data)[off[0] : off[-1]]) if data is not None else b""
    byte = np.frombuffer(raw, np.uint8)
    lead = (byte & 0xC0) != 0x80
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(n), np.diff(off))[lead]
    start, length, pool, *_ = tables()
    # gather the expansions
    size = length[cp].astype(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    within = np.arange(total) - np.repeat(ends - size, size)
    row = np.repeat(row, size)
    cp = pool[np.repeat(start[cp], size) + within]
    cp, row = compose(cp, row)
    # blanks
    if len(cp):
        space = cp == 32
        first = np.concatenate([[True], row[1:] != row[:-1]])
        before = np.concatenate([[True], space[:-1]]) | first
        keep = ~(space & before)
        cp, row = cp[keep], row[keep]
        if len(cp):
            last = np.concatenate([row[1:] != row[:-1], [True]])
            keep = ~((cp == 32) & last)
            cp, row = cp[keep], row[keep]
    width = np.where(cp < 0x80, 1, np.where(cp < 0x800, 2, np.where(cp < 0x10000, 3, 4)))
    lengths = np.bincount(row, width, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
    out = np.concatenate([[0], np.cumsum(lengths)])
    body = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(out.astype(np.int64)), pa.py_buffer(body))
    return pa.compute.if_else(pa.compute.is_valid(values), made, pa.scalar(None, pa.large_string())).cast(pa.string())


def with_form(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """``df`` with the comparable form of column ``text`` in column ``form`` (which must not exist yet).

    Null gives null, blank or invisible text the empty string; any length of text is taken whole.
    """
    if form in df.columns:
        raise ValueError(f"column {form} exists already")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = same_look(b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, form])

    schema = T.StructType([*df.schema.fields, T.StructField(form, T.StringType())])
    return df.mapInArrow(convert, schema)


def _spelled(df: DataFrame, group: str, member: str, text: str) -> DataFrame:
    rows = with_form(df.select(group, member, text).where(F.length(F.trim(text)) > 0), text).where(F.length("form") > 0)
    return cut(rows.select(F.to_json(F.struct(group, "form")).alias("look"), group, F.col(text).alias("spelling"), member).distinct())


def same_look_pairs(df: DataFrame, group: str, member: str, text: str) -> DataFrame:
    """Pairs of different members of a group whose texts look the same but aren't the same characters.

    Texts are compared as classes of equal spelling: only forms with two or more spellings are joined, spelling by
    spelling, and members are added last, so a title that many rows share costs nothing unless it is spelled twice.
    Null, blank and invisible texts pair with nothing. Returns group, {member}_a < {member}_b.
    """
    spelled = _spelled(df, group, member, text)
    kinds = spelled.select("look", "spelling").distinct()
    kinds = pairs_in_groups(kinds, "look", "spelling")
    a = spelled.select("look", group, F.col("spelling").alias("spelling_a"), F.col(member).alias("_a"))
    b = spelled.select("look", F.col("spelling").alias("spelling_b"), F.col(member).alias("_b"))
    met = split_join(kinds, a, ["look", "spelling_a"], ["spelling_b"], ["_a"])
    met = split_join(met, b, ["look", "spelling_b"], ["spelling_a", "_a"], ["_b"]).where(F.col("_a") != F.col("_b"))
    return met.select(
        group, F.least("_a", "_b").alias(f"{member}_a"), F.greatest("_a", "_b").alias(f"{member}_b")
    ).distinct()


def same_look_classes(df: DataFrame, group: str, member: str, text: str) -> DataFrame:
    """(group, member, class_id, links): each member once per spelling's class, without writing pairs out.

    A class is a look, named by its smallest member; links counts the members that share the look in another spelling.
    Null, blank and invisible texts have no class.
    """
    spelled = _spelled(df, group, member, text)
    looks = spelled.groupBy("look").agg(F.min(member).alias("class_id"), F.count("*").alias("_all"))
    own = spelled.groupBy("look", "spelling").agg(F.count("*").alias("_own"))
    rows = split_join(split_join(spelled, looks, ["look"], [member]), own, ["look", "spelling"], [member])
    return rows.groupBy(group, member, "class_id").agg(F.sum(F.col("_all") - F.col("_own")).alias("links"))
