"""Several values packed in one string field: one row per value, with its position.

The work is done on Arrow's string buffers. Quote parity and delimiters are byte masks over a whole batch; the
child offsets follow from running sums, the values are one Arrow string array over the bytes that remain, and the
parents are ordinals repeated once per child. No Python code runs per row or per value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Whole fields that mean "missing", compared in lower case without outer blanks.
MISSING = ("", "nan", "none", "null", "n/a", "[]")

_QUOTE, _APOS, _BACK, _COMMA, _SLASH, _OPEN, _CLOSE = b"\"'\\,/[]"


def _strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array without nulls."""
    values = values.cast(pa.large_string())
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _from_bytes(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def _at(mask_source: np.ndarray, shift: int) -> np.ndarray:
    """mask_source moved so that place i shows place i + shift; 0 beyond the ends."""
    out = np.zeros_like(mask_source)
    if shift > 0:
        out[:-shift] = mask_source[shift:]
    elif shift < 0:
        out[-shift:] = mask_source[:shift]
    else:
        out[:] = mask_source
    return out


def _running(mask: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Count of the mask from the row's start up to and with each place."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[1:] - total[starts][row]


def split_array(values: pa.Array, persons: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Split every string of an array without nulls.

    persons: by row, whether values are names of people, so that "Last, First" next to a stronger delimiter is one.
    Returns the parent's ordinal, the value and the 1-based position of every value.
    """
    trimmed = pc.utf8_trim_whitespace(values.cast(pa.large_string()))
    gone = pc.is_in(pc.utf8_lower(trimmed), pa.array(MISSING, pa.large_string())).to_numpy(zero_copy_only=False)
    trimmed = pc.if_else(pa.array(gone), "", trimmed)
    n = len(trimmed)
    b, off = _strings(trimmed)
    if not len(b):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64)
    starts, ends = off[:-1], off[1:]
    row = np.repeat(np.arange(n), ends - starts)
    some = ends > starts
    first, last = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    first[some], last[some] = b[starts[some]], b[ends[some] - 1]
    listed = (first == _OPEN) & (last == _CLOSE) & (ends - starts >= 2)
    head, tail = np.zeros(len(b), bool), np.zeros(len(b), bool)
    head[starts[some]], tail[ends[some] - 1] = True, True

    # the next and the previous byte that isn't a blank, within the row; 0 beyond it
    blank = (b == 32) | (b == 9)
    place = np.arange(len(b))
    before = np.maximum.accumulate(np.where(blank, -1, place))
    before = np.concatenate([[-1], before[:-1]])
    after = np.minimum.accumulate(np.where(blank, len(b), place)[::-1])[::-1]
    after = np.concatenate([after[1:], [len(b)]])
    prev = np.where(before >= starts[row], b[np.maximum(before, 0)], 0)
    nxt = np.where(after < ends[row], b[np.minimum(after, len(b) - 1)], 0)

    brackets = listed[row] & (head | tail)
    odd_back = np.zeros(len(b), bool)
    if (b == _BACK).any():  # a quote after an odd run of backslashes is escaped
        run = place - np.maximum.accumulate(np.where(b == _BACK, -1, place))
        odd_back = _at((run % 2 == 1).astype(np.uint8), -1).astype(bool) & ~head
    dq = (b == _QUOTE) & ~odd_back
    even = np.bincount(row[dq], minlength=n) % 2 == 0  # a quote left open quotes nothing
    inside = (_running(dq, starts, row) % 2 == 1) & even[row]
    # apostrophes quote only in lists, next to a bracket or comma, and not within double quotes
    edge = np.zeros(256, bool)
    edge[[0, _OPEN, _CLOSE, _COMMA]] = True
    sq = (b == _APOS) & listed[row] & ~inside & ~odd_back & (edge[prev] | edge[nxt])
    even_s = np.bincount(row[sq], minlength=n) % 2 == 0
    sq &= even_s[row]
    inside |= _running(sq, starts, row) % 2 == 1

    # delimiters outside quotes; the wide ones take three bytes
    comma = (b == _COMMA) & ~inside
    strong = np.isin(b, np.frombuffer(b";|\n\r\t", np.uint8)) & ~inside
    strong |= (b == _SLASH) & ~inside & _at(blank, -1) & _at(blank, 1)
    wide = np.zeros(len(b), bool)
    b1, b2 = _at(b, 1), _at(b, 2)
    # UTF-8 of the full-width comma, semicolon and bar, and the ideographic comma.
    for x, y, z, kind in ((0xEF, 0xBC, 0x8C, comma), (0xEF, 0xBC, 0x9B, strong), (0xEF, 0xBD, 0x9C, strong), (0xE3, 0x80, 0x81, strong)):
        hit = (b == x) & (b1 == y) & (b2 == z) & ~inside
        kind |= hit
        wide |= hit
    outside_list = listed[row] & (strong | (comma & wide))  # lists have commas only
    strong &= ~outside_list
    comma &= ~outside_list
    wide &= ~outside_list
    comma = _names_kept(b, row, starts, ends, comma, strong, blank, inside, np.asarray(persons, bool) & ~listed)
    wide &= comma | strong
    cut = comma | strong
    drop = cut | _at(wide.view(np.uint8), -1).astype(bool) | _at(wide.view(np.uint8), -2).astype(bool) | brackets

    # children: one more than the cuts of each row that has text
    keep = np.concatenate([[0], np.cumsum(~drop)])
    cuts = np.bincount(row[cut], minlength=n)
    kids = np.where(some, cuts + 1, 0)
    parent = np.repeat(np.arange(n), kids)
    child_end = np.sort(np.concatenate([place[cut] * 2, ends[some] * 2 - 1]))  # a row's end comes after the cuts in it
    child_end = (child_end + 1) // 2
    offsets = np.concatenate([[0], keep[child_end]])
    kid = pc.utf8_trim_whitespace(_from_bytes(b[~drop], offsets))
    kid = _unquoted(kid, listed[parent])
    full = pc.greater(pc.binary_length(kid), 0).to_numpy(zero_copy_only=False)
    parent, kid = parent[full], kid.filter(pa.array(full))
    pos = np.arange(len(parent)) - np.searchsorted(parent, parent) + 1
    return parent, kid, pos


def _names_kept(b, row, starts, ends, comma, strong, blank, inside, persons):
    """The commas without those between a last and a first name.

    A comma belongs to a name if it is the only one between two stronger delimiters (or a row's end) of a row that
    has a stronger one, what stands after it is one word, and before it one word or words of which only the last
    begins with a capital ("van Last"). So does a comma before Jr., Sr. or a Roman numeral that ends the value.
    """
    if not (comma.any() and persons.any()):
        return comma
    place = np.arange(len(b))
    piece = np.cumsum(strong) + row  # number of the piece between strong delimiters, over all rows
    piece -= strong  # a delimiter closes the piece before it
    _, piece = np.unique(piece, return_inverse=True)
    m = piece.max() + 1
    has_strong = np.bincount(row[strong], minlength=len(starts)) > 0
    one = np.bincount(piece[comma], minlength=m) == 1
    where = np.full(m, -1)
    where[piece[comma]] = place[comma]
    word = ~blank & ~comma & ~strong
    begin = word & ~_at(word.view(np.uint8), -1).astype(bool)
    begin |= word & np.isin(place, starts)
    behind = place > where[piece]
    lower = (b >= 97) & (b <= 122)
    left = np.bincount(piece[begin & ~behind], minlength=m) - np.bincount(piece[begin & ~behind & lower], minlength=m)
    right = np.bincount(piece[begin & behind], minlength=m)
    quoted = np.bincount(piece[inside | (b == _QUOTE)], minlength=m) > 0
    owner = np.zeros(m, np.int64)
    owner[piece] = row
    name = one & (left == 1) & (right == 1) & ~quoted & has_strong[owner] & persons[owner]
    out = comma & ~name[piece]
    # suffixes, whatever the delimiters
    after = place[out & persons[row]] + 1
    if len(after):
        stop = np.concatenate([place[comma | strong], ends])
        stop.sort()
        upto = stop[np.searchsorted(stop, after)]
        short = upto - after <= 5
        after, upto = after[short], upto[short]
        if len(after):
            length = upto - after
            ends_at = np.cumsum(length)
            within = np.arange(ends_at[-1]) - np.repeat(ends_at - length, length)
            text = _from_bytes(b[np.repeat(after, length) + within], np.concatenate([[0], ends_at]))
            suffix = pc.match_substring_regex(text, r"^\s*(Jr|Sr|II|III|IV)\.?\s*$").to_numpy(zero_copy_only=False)
            out[after[suffix] - 1] = False
    return out


def _unquoted(kid: pa.Array, listed: np.ndarray) -> pa.Array:
    """Values without outer quotes, inner quotes restored: doubled ones, and those escaped in lists."""
    double = pc.and_(pc.starts_with(kid, '"'), pc.and_(pc.ends_with(kid, '"'), pc.greater(pc.utf8_length(kid), 1)))
    inner = pc.utf8_slice_codeunits(kid, 1, -1)
    in_list = pa.array(listed)
    plain = pc.if_else(
        in_list, pc.replace_substring_regex(inner, r'\\(["\\/])', r"\1"), pc.replace_substring(inner, '""', '"')
    )
    single = pc.and_(
        in_list, pc.and_(pc.starts_with(kid, "'"), pc.and_(pc.ends_with(kid, "'"), pc.greater(pc.utf8_length(kid), 1)))
    )
    plain_s = pc.replace_substring_regex(inner, r"\\(['\\])", r"\1")
    return pc.utf8_trim_whitespace(pc.if_else(double, plain, pc.if_else(single, plain_s, kid)))


def split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tbl, item_id, field, persons, raw) -> (tbl, item_id, field, pos, val), by Arrow batches."""
    for batch in batches:
        raw = batch.column("raw")
        persons = batch.column("persons").to_numpy(zero_copy_only=False)
        parent, val, pos = split_array(raw, persons)
        take = pa.array(parent)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("tbl").take(take),
                batch.column("item_id").take(take),
                batch.column("field").take(take),
                pa.array(pos, pa.int32()),
                val.cast(pa.string()),
            ],
            names=["tbl", "item_id", "field", "pos", "val"],
        )


def split_packed(df: DataFrame) -> DataFrame:
    """One row per value of the packed strings in ``raw``.

    df: tbl string, item_id bigint, field string, persons boolean, raw string; other columns are ignored.
    Null, blank and missing-marker strings and empty values give no row; positions count the values that remain,
    repeated ones included. Rows repeated exactly come out once; an empty table gives an empty result.
    """
    rows = df.where(F.col("raw").isNotNull()).select(
        "tbl", F.col("item_id").cast("bigint").alias("item_id"), "field", F.coalesce("persons", F.lit(False)).alias("persons"), "raw"
    )
    out = rows.mapInArrow(split_batches, "tbl string, item_id bigint, field string, pos int, val string")
    return out.distinct()
