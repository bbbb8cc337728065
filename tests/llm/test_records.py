import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolex.operators.skew import split_join
from kinolex.llm import books, golden, linkage, mixing, nearcopies, vectors


@pytest.mark.parametrize("text, n", [("0123", 123), ("+77", 77), (" 9 ", 9), ("1,234", 1234), ("12.0", 12), ("5 ", 5), ("0", None), ("-3", None), ("nan", None), ("", None), (None, None), ("1,23", None), ("x1", None)])
def test_work_no(spark, text, n):
    df = spark.createDataFrame([(text,)], "w string")
    assert df.select(books.work_no(F.col("w")).alias("n")).first().n == n


def test_bundles_without_dependencies(spark):
    rows = [(1, "a", 5, 1), (1, "b", 7, 1), (1, "c", None, 9), (1, "c", None, 9), (2, "d", None, None), (None, "e", 1, 1), (3, None, 1, 1)]
    df = spark.createDataFrame(rows, "k int, id string, x int, bundle int")
    b = [golden.Bundle("x", ("x",), F.col("x").isNotNull(), F.col("x")), golden.Bundle("y", ("bundle",), F.col("bundle") > 0, F.col("bundle"))]
    assert sorted((r.k, r.bundle, r.record) for r in golden.best_bundles(df, "k", "id", b).collect()) == [(1, "x", "b"), (1, "y", "c")]
    assert golden.best_bundles(df.limit(0), "k", "id", b).count() == 0


def test_bundles_against_all_choices(spark):
    rng = random.Random(8)
    rows = [(k, f"r{i}", rng.choice(["en", "fr", "de", None]), rng.choice([None, rng.randint(1, 9)]), rng.choice([None, rng.randint(1, 9)]), rng.randint(1, 9)) for k in range(40) for i in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "k int, id string, lang string, a int, b int, c int")
    spec = [("A", "a", ("lang",), 3), ("B", "b", ("lang",), 2), ("C", "c", (), 1)]
    bundles = [golden.Bundle(n, (f,), F.col(f).isNotNull(), F.col(f), ag, w) for n, f, ag, w in spec]
    got = {}
    for r in golden.best_bundles(df, "k", "id", bundles).collect():
        got.setdefault(r.k, {})[r.bundle] = r.record

    def ranked(k, f, ag):
        """Candidates after dominance: (rank, record, language to agree in)."""
        best = {}
        for key, i, lang, a, b, c in rows:
            v = {"a": a, "b": b, "c": c}[f]
            if key == k and v is not None:
                sig = lang if ag else None
                if sig not in best or (-v, i) < best[sig]:
                    best[sig] = (-v, i)
        return [(n, t[1], s) for n, (t, s) in enumerate(sorted(((v, s) for s, v in best.items()), key=lambda x: x[0]))]

    for k in {r[0] for r in rows}:
        lists = [ranked(k, f, ag) for _, f, ag, _ in spec]
        least = None
        for x in [*lists[0], None]:
            for y in [*lists[1], None]:
                if x and y and x[2] is not None and y[2] is not None and x[2] != y[2]:
                    continue
                cost = sum((p[0] if p else (golden.MISSING_COST if q else 0)) * w for p, q, w in ((x, lists[0], 3), (y, lists[1], 2)))
                least = cost if least is None else min(least, cost)
        mine = 0
        for (n, _, _, w), l in zip(spec[:2], lists[:2]):
            if l:
                mine += w * next((c[0] for c in l if c[1] == got.get(k, {}).get(n)), golden.MISSING_COST)
        assert mine == least, k


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(400)}" for _ in range(30)] for _ in range(30)]
    rows = []
    for k, b in enumerate(base):
        for j in range(4):
            w = list(b)
            for _ in range(rng.choice([0, 1, 3, 5])):
                w[rng.randrange(30)] = f"n{rng.randrange(10_000)}"
            rows.append((f"{k:02d}-{j}", w, "x"))
    rows += [rows[0], ("zz", [], "x"), ("yy", None, "x"), (None, ["a"], "x"), ("xx", ["only"], "x"), ("xy", ["only"], "x"), ("00-0", ["other", "set"], "x")]
    df = spark.createDataFrame(rows, "id string, words array<string>, rep string").withColumn("words", F.array_distinct("words"))
    members, links = nearcopies.near_copies(df, "id", "words")
    got = {tuple(r) for r in nearcopies.all_pairs(members, links, "id").collect()}
    sets = [(i, frozenset(w)) for i, w, _ in rows if i and w]
    true = {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(sets, 2) if a != b and len(x & y) / len(x | y) >= 0.6}
    assert got == true
    root = {r.rep: r.root for r in nearcopies.components(members.select("rep").distinct(), links).collect()}
    assert all(root[r.rep_a] == root[r.rep_b] for r in links.collect())
    m, k = nearcopies.near_copies(df.limit(0), "id", "words")
    assert m.count() == 0 and nearcopies.all_pairs(m, k, "id").count() == 0


def _found_and_true(spark, sets):
    df = spark.createDataFrame([(f"{k:04d}", sorted(w)) for k, w in enumerate(sets)], "id string, words array<string>")
    got = {tuple(r) for r in nearcopies.all_pairs(*nearcopies.near_copies(df, "id", "words"), "id").collect()}
    true = {(f"{a:04d}", f"{b:04d}") for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    return got, true


def test_near_copies_of_a_third_of_the_rows(spark):
    """Words that a group of near copies makes frequent still find its pairs."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    sets = []
    for k in range(450):
        if k % 3:
            sets.append({f"w{rng.randrange(5000)}" for _ in range(60)})
        else:
            edits = rng.choice([3, 6, 8])
            sets.append(set(rng.sample(base, 60 - edits)) | {f"own{k}-{j}" for j in range(edits)})
    got, true = _found_and_true(spark, sets)
    assert len(true) > 5000 and got <= true and len(got) >= 0.998 * len(true)


def test_near_copies_above_a_tenth_of_the_rows(spark):
    """40 of 200 records share 40 words and hold 8 of their own each: all 780 pairs come out."""
    rng = random.Random(9)
    sets = [{f"b{j}" for j in range(40)} | {f"own{k}-{j}" for j in range(8)} for k in range(40)]
    sets += [{f"w{rng.randrange(5000)}" for _ in range(48)} for _ in range(160)]
    got, true = _found_and_true(spark, sets)
    assert len(true) == 780 and got == true


def test_band_plan():
    """Bands grow slower than the table, and those of any size keep the promised share of pairs at the threshold."""
    plans = [nearcopies.band_plan(n) for n in (10, 10**4, 10**6, 10**8)]
    assert plans == sorted(plans) and plans[2][0] < 1000
    assert nearcopies.band_plan(10**6, 0.8)[0] < plans[2][0]


def test_near_copies_of_ten_rows(spark):
    """In a small table three copies make a word frequent."""
    sets = [{f"b{j}" for j in range(20)} - {f"b{k}"} | {f"own{k}"} for k in range(4)] + [{f"x{k}-{j}" for j in range(20)} for k in range(6)]
    got, true = _found_and_true(spark, sets)
    assert len(true) == 6 and got == true


def test_components_of_a_chain(spark):
    e = [(f"{k:03d}", f"{k + 1:03d}") for k in range(0, 40)] + [("a", "b"), ("b", "c"), ("a", "c")]
    nodes = spark.createDataFrame([(x,) for x in sorted({y for p in e for y in p} | {"alone"})], "rep string")
    got = {r.rep: r.root for r in nearcopies.components(nodes, spark.createDataFrame(e, "rep_a string, rep_b string")).collect()}
    assert {got[f"{k:03d}"] for k in range(41)} == {"000"} and {got[x] for x in "abc"} == {"a"} and got["alone"] == "alone"


def test_posterior_bounds():
    need = nearcopies.least_matches(0.6, 1e-4)
    assert list(need) == sorted(need) and need[-1] < 0.6 * 64


def test_linkage(spark):
    rng = random.Random(2)
    syl = ["ba", "ko", "ri", "ne", "tu", "sa", "vo", "mi", "da", "lu"]
    word = lambda n: "".join(rng.choice(syl) for _ in range(n)).capitalize()
    a, b, true = [], [], set()
    for k in range(300):
        title, first, last, year = f"The {word(3)} of {word(4)}", word(2), word(3), rng.randint(1950, 2020)
        said = " ".join(word(3) for _ in range(20))
        b.append((f"b{k}", title, f"{first} {last}", said, year, 100 + k))
        if k % 2:
            t = rng.choice([title, title[4:] + ", The", title.upper(), title + " [Kindle]"])
            n = rng.choice([[f"{last}, {first}"], ["Some Helper", f"{first} {last}"], [f"{first[0]}. {last}"], [None], None])
            a.append((k, t, n, said, str(year), 100 + k))
            true.add((k, f"b{k}"))
        else:
            a.append((k, title, ["Quite Different"], " ".join(word(3) for _ in range(20)), str(year + 9), 7))
    a += [(900, None, None, None, None, None), (901, " ", [""], "", "", -1), a[1]]
    b += [("n", None, None, None, None, None), b[1]]
    da = spark.createDataFrame(a, "id int, t string, n array<string>, d string, y string, p int")
    db = spark.createDataFrame(b, "id string, t string, n string, d string, y int, p int")
    left = linkage.prepared(da, "id", F.col("t"), F.col("n"), F.col("d"), F.col("y").try_cast("int"), F.col("p"))
    right = linkage.prepared(db, "id", F.col("t"), F.array("n"), F.col("d"), F.col("y"), F.col("p"))
    got = {(r.id_a, r.id_b) for r in linkage.link(left, right).collect()}
    assert len(got & true) >= 0.97 * len(true) and len(got - true) <= 2
    assert linkage.link(left.limit(0), right).count() == 0


def test_long_titles_stay_whole(spark):
    for article in ("", "The "):
        df = spark.createDataFrame([(1, article + " ".join(f"word{k}" for k in range(120)))], "id int, t string")
        assert len(linkage.with_title_parts(df, "t").first().core) == 120


def test_hot_blocks_of_the_linkage(spark, monkeypatch):
    """Blocks that are divided propose the same pairs."""
    rows = [(k, f"The Same Title {k % 3}", "Ann Lee", None, 1990 + k % 4, 100) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, t string, p string, d string, y int, n int")
    side = lambda: linkage.prepared(df, "id", F.col("t"), F.array("p"), F.col("d"), F.col("y"), F.col("n"))
    whole = sorted(map(tuple, linkage.link(side(), side()).collect()))
    monkeypatch.setattr(linkage, "split_join", lambda *a, **k: split_join(*a, **{**k, "block": 4}))
    assert whole and sorted(map(tuple, linkage.link(side(), side()).collect())) == whole


def test_volumes_are_different_books(spark):
    rows = [("a", "The Long Saga: Book One"), ("b", "The Long Saga - Part 2"), ("c", "Night Watch Moon Cycle 5"), ("d", "Night Watch (Moon Cycle, #5)")]
    got = {r.id: r for r in linkage.with_title_parts(spark.createDataFrame(rows, "id string, t string"), "t").collect()}
    assert got["a"].core == got["b"].core and (got["a"].volume, got["b"].volume) == (1, 2)
    assert got["c"].core == got["d"].core and got["c"].volume == got["d"].volume == 5 and got["c"].series == got["d"].series


def _vectors(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(max(2, n // 40), dim))
    return (centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, dim)) * 0.25).astype(np.float32)


def _exact(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    return {i: sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:k] for i in range(len(x))}


def test_nearest_with_ties_and_dirt(spark):
    x = _vectors(120)
    x[50:58] = x[10]
    x[60] = x[11] * 4
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 15), (904, [1.0] * 15 + [None]), (None, x[0].tolist())]
    df = spark.createDataFrame([(k, v.tolist(), 1.0) for k, v in enumerate(x)] + [(k, v, 1.0) for k, v in bad] + [(3, x[3].tolist(), 1.0)], "key bigint, v array<float>, sim double")
    got = {}
    for r in vectors.nearest(df, "key", "v", dim=16).collect():
        got.setdefault(r.id, {})[r.rk] = r.other
    assert {k: [v[i] for i in range(1, 6)] for k, v in got.items()} == _exact(x, 5)
    assert vectors.nearest(df.limit(0), "key", "v", dim=16).count() == 0
    assert {r.id for r in vectors.nearest(df, "key", "v", dim=16, queries="id % 50 = 0").collect()} == {0, 50, 100}


def test_nearest_recall_with_partitions(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_PARTITION", 150)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    x = _vectors(1500)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key bigint, v array<float>")
    true = {(k, o) for k, v in _exact(x, 5).items() for o in v}
    got = {(r.id, r.other) for r in vectors.nearest(df, "key", "v", dim=16).collect()}
    assert len(got & true) / len(true) >= 0.9


@pytest.mark.parametrize("n", [1200, 4800])
def test_nearest_recall_with_two_levels(spark, monkeypatch, n):
    """Partitions grow in number, not in size; recall stays, for all and for asked ids alone."""
    monkeypatch.setattr(vectors, "PER_PARTITION", 60)
    monkeypatch.setattr(vectors, "FAN", 8)
    monkeypatch.setattr(vectors, "SAMPLE", 600)
    monkeypatch.setattr(vectors, "SAMPLE_BELOW", 300)
    x = _vectors(n)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key bigint, v array<float>")
    exact = _exact(x, 5)
    got = {(r.id, r.other) for r in vectors.nearest(df, "key", "v", dim=16).collect()}
    true = {(k, o) for k, v in exact.items() for o in v}
    assert len(got & true) / len(true) >= 0.9
    some = {(r.id, r.other) for r in vectors.nearest(df, "key", "v", dim=16, queries="id % 50 = 0").collect()}
    assert some == {p for p in got if p[0] % 50 == 0}


def test_partition_is_balanced():
    x = _vectors(600)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = vectors.balanced_partition(x, vectors.neighbour_graph(x, 8), 6)
    assert np.bincount(label, minlength=6).max() <= np.ceil(1.1 * 100)


def test_apportionment_against_plain_highest_quotients():
    rng = random.Random(9)
    for _ in range(200):
        v = [rng.choice([0, rng.random()]) for _ in range(rng.randint(1, 6))]
        caps = [rng.randint(0, 60) for _ in v]
        seats = rng.randint(0, 150)
        given = [0] * len(v)
        for _ in range(seats):
            best = max((i for i in range(len(v)) if v[i] > 0 and given[i] < caps[i]), key=lambda i: (v[i] / (2 * given[i] + 1), -i), default=None)
            if best is None:
                break
            given[best] += 1
        assert mixing.sainte_lague(v, seats, caps) == given


def test_mixture_of_many_shards(spark, monkeypatch):
    """More shards than groups: shares hold, and nothing depends on the driver's knowing the shards."""
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 2000)
    monkeypatch.setattr(mixing, "MOST_GROUPS", 3)
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, rng.choice("aab"), "word " * rng.randint(1, 60)) for k in range(2000)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 3)], "source string, target_share double, max_repeats int")
    out = mixing.mix(docs, targets, total_tokens=40_000).collect()
    assert abs({r.source: r.actual_share for r in out}["b"] - 0.6) < 0.04 and len({r.doc_id for r in out}) == len(out)


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a"] * 6 + ["b"] * 3 + ["c"]), "word " * rng.randint(1, 60), 0) for k in range(3000)] + [(9001, None, "x", 0), (9002, "other", "x y", 0), (None, "a", "x", 0), (9003, "a", None, 0), (9004, "b", "", 0), (9005, "b", "long " * 3000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.3, 4), ("empty", 0.0, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(docs, targets, total_tokens=60_000).collect()
    assert len({r.doc_id for r in out}) == len(out) and {r.source for r in out} == {"a", "b", "c"}
    total = sum(r.n_tokens * r.repeats for r in out)
    for s, share, most in (("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.3, 4)):
        own = [r for r in out if r.source == s]
        real = sum(r.n_tokens * r.repeats for r in own) / total
        assert abs(real - share) < 0.03 and abs(own[0].actual_share - real) < 1e-9 and max(r.repeats for r in own) <= most
    assert mixing.mix(docs.limit(0), targets).count() == 0
    again = mixing.mix(docs, targets, total_tokens=60_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
