import random

import numpy as np
import pyarrow as pa
import pytest

from kinolex.operators.packed import MISSING, split_array, split_packed


def brute(text, persons=False):
    """A plain scanner of one string: quotes, doubled quotes, delimiters; lists and names are tested by example."""
    t = text.strip()
    if t.lower() in MISSING:
        return []
    quoting = t.count('"') % 2 == 0
    out, cur, inside, k = [], "", False, 0
    while k < len(t):
        ch = t[k]
        if ch == '"' and quoting:
            inside = not inside
            cur += ch
        elif not inside and (ch in ",;|\n\t\r，；、" or ch == "/" and 0 < k < len(t) - 1 and t[k - 1] in " \t" and t[k + 1] in " \t"):
            out.append(cur)
            cur = ""
        else:
            cur += ch
        k += 1
    out.append(cur)
    vals = []
    for v in (x.strip() for x in out):
        if len(v) > 1 and v[0] == '"' and v[-1] == '"':
            v = v[1:-1].replace('""', '"').strip()
        if v:
            vals.append(v)
    return vals


def run(texts, persons=False):
    parent, val, pos = split_array(pa.array(texts, pa.string()), np.full(len(texts), persons))
    out = [[] for _ in texts]
    for p, v, k in zip(parent, val.to_pylist(), pos):
        out[p].append(v)
        assert len(out[p]) == k
    return out


@pytest.mark.parametrize(
    "text, persons, expected",
    [
        ('["a, b","c"]', False, ["a, b", "c"]),
        ("[\"Children's\", 'x']", False, ["Children's", "x"]),
        ('["The \\"D\\" Channel"]', False, ['The "D" Channel']),
        ('"The ""D"" Channel", N-4', False, ['The "D" Channel', "N-4"]),
        ("Last, First; Other, Name", True, ["Last, First", "Other, Name"]),
        ("van Last, First | Two, Three", True, ["van Last, First", "Two, Three"]),
        ("One Two, Three Four", True, ["One Two", "Three Four"]),
        ("One Two, Three Four, Jr., Five Six", True, ["One Two", "Three Four, Jr.", "Five Six"]),
        (",One Two,,Three Four |", True, ["One Two", "Three Four"]),
        ("War & Peace / Love/Hate", False, ["War & Peace", "Love/Hate"]),
        ("a，b、c；d", False, ["a", "b", "c", "d"]),
        ("[]", False, []),
        ("nan", False, []),
        ('5" tape; x', False, ['5" tape', "x"]),
        ("x", False, ["x"]),
    ],
)
def test_examples(text, persons, expected):
    assert run([text], persons)[0] == expected


def test_random_against_scanner():
    rng = random.Random(3)
    alphabet = ["a", "Bc", " ", " / ", "/", ",", ";", "|", "\n", "\t", '"', '""', "，", "、", "é", "日", "&"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts = [t for t in texts if not (t.strip().startswith("[") and t.strip().endswith("]"))]
    got = run(texts)
    for t, g in zip(texts, got):
        assert g == brute(t), repr(t)


def test_spark(spark):
    rows = [("t", 1, "f", False, "a; b; a", 9), ("t", 1, "f", False, "a; b; a", 9), ("t", 2, "f", False, None, 9), ("t", 3, "f", None, "x" * 200_000 + ", y", 9)]
    df = spark.createDataFrame(rows, "tbl string, item_id bigint, field string, persons boolean, raw string, val int")
    got = sorted((r.item_id, r.pos, r.val[:3]) for r in split_packed(df).collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (3, 1, "xxx"), (3, 2, "y")]
    assert split_packed(df.limit(0)).count() == 0
