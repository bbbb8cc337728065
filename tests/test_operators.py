import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolex import plans
from kinolex.operators.knn import as_vectors, exact_topk, weighted_vector
from kinolex.operators.rank import round_robin
from kinolex.operators.relational import argmax_edition, percent_rank_average, replace_groups, upsert_last
from kinolex.operators.search import common_letters, matched, tiered, weighted_ratio
from kinolex.operators.skew import pairs_in_groups, split_join
from kinolex.session import checkpoint_ready


def test_pairs_of_small_and_split_groups(spark):
    rows = [("a", k, k * 2) for k in range(200)] + [("b", 1, 0), (None, 3, 0), ("c", None, 0), ("c", 5, 0), ("d", 7, 0), ("d", 4, 0)]
    df = spark.createDataFrame(rows, "k string, m int, x int")
    for block in (7, 1000):
        got = [(r.m_a, r.m_b) for r in pairs_in_groups(df, "k", "m", block=block).collect()]
        assert sorted(got) == sorted([(a, b) for a in range(200) for b in range(a + 1, 200)] + [(4, 7)]), block
    assert pairs_in_groups(df.limit(0), "k", "m").count() == 0


def test_topk_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    x[7] = x[3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, v array<float>")
    import kinolex.operators.knn as K

    monkeypatch.setattr(K, "CORPUS_BLOCK", 20)
    monkeypatch.setattr(K, "QUERY_BLOCK", 9)
    got = {(r.query_id, r.rk): r.item_id for r in exact_topk(df, df.where("id < 25"), 4, skip_self=True).collect()}
    s = x.astype(float) @ x.astype(float).T
    for q in range(25):
        order = sorted((k for k in range(90) if k != q), key=lambda k: (-s[q, k], k))[:4]
        assert [got[q, r] for r in range(1, 5)] == order


def test_weighted_vector_null_profile(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, v array<double>")
    r = spark.createDataFrame([(1, 1, 2.0), (1, 2, -1.0), (2, 1, 0.0)], "profile_id int, id bigint, w double")
    got = {x.profile_id: x.v for x in as_vectors(weighted_vector(r, v), "profile_id").collect()}
    assert set(got) == {1} and np.allclose(got[1], np.array([2, -1]) / np.sqrt(5))


def simulate(queues, per, n, work):
    picked, seen, at = [], set(), [0] * len(queues)
    while len(picked) < n:
        before = len(picked)
        for a, q in enumerate(queues):
            took = 0
            while took < per and at[a] < len(q) and len(picked) < n:
                item = q[at[a]]
                at[a] += 1
                if item not in seen and (work.get(item) is None or ("w", work[item]) not in seen):
                    seen |= {item, ("w", work.get(item))}
                    picked.append((item, a))
                    took += 1
        if len(picked) == before:
            break
    return picked


@pytest.mark.parametrize("first", [200, 2])
def test_round_robin_equals_simulation(spark, first):
    """Also where profiles need more anchors than the first fold looks at, and with works."""
    rng = random.Random(4)
    cases = {p: [rng.sample(range(12), rng.randint(0, 9)) for _ in range(rng.randint(1, 9))] for p in range(40)}
    work = {i: None if i % 3 else str(i // 6) for i in range(12)}
    for works in (False, True):
        rows = [(p, float(-a), a, i, float(-k), work[i] if works else None) for p, qs in cases.items() for a, q in enumerate(qs) for k, i in enumerate(q)]
        df = spark.createDataFrame(rows, "profile_id int, anchor_order double, anchor_id bigint, item_id bigint, score double, work string")
        got = {}
        for r in round_robin(df, 2, 7, first).orderBy("profile_id", "pick_no").collect():
            got.setdefault(r.profile_id, []).append((r.item_id, r.anchor_id))
        for p, qs in cases.items():
            assert got.get(p, []) == simulate(qs, 2, 7, work if works else {}), qs
    assert round_robin(df.limit(0), 2, 7).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "id int, tag string, s double")
    new = spark.createDataFrame([(1, "c", 9.0), (2, "a", 4.0)], "id int, tag string, s double")
    assert sorted(map(tuple, replace_groups(old, new, "id").collect())) == [(1, "c", 9.0), (2, "a", 4.0)]
    once = upsert_last(old, new, ["id", "tag"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1.0), (1, "b", 2.0), (1, "c", 9.0), (2, "a", 4.0)]
    assert sorted(map(tuple, upsert_last(once, new, ["id", "tag"]).collect())) == sorted(map(tuple, once.collect()))


def test_editions_without_a_work_stay(spark):
    df = spark.createDataFrame([("w", 1, 5), ("w", 2, 5), ("", 3, 1), (None, 4, 1), (" ", 5, 1)], "work string, id int, pop int")
    assert sorted(r.id for r in argmax_edition(df, "work", "pop", "id").collect()) == [1, 3, 4, 5]


def test_percent_rank_equals_pandas(spark):
    rng = random.Random(2)
    vals = [rng.randint(0, 12) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, v int")
    got = percent_rank_average(df, "v").orderBy("id").toPandas()
    import pandas as pd

    assert np.allclose(got["pct"], pd.Series(vals).rank(pct=True))
    assert percent_rank_average(df.withColumn("v", F.lit(None).cast("int")), "v").count() == 0


@pytest.mark.parametrize("name, anchor", [("knn_topk", "anchor_id"), ("knn_exclude_self", "anchor_id"), ("intra_list_diversity", "anchor_id"), ("tag_cosine_topk", "item_id"), ("eval_neighbors", "anchor_id")])
def test_searches_ask_with_every_fiftieth_id(spark, name, anchor):
    data = "/root/testdata/sf0.001"
    ids = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    got = {r[0] for r in plans.QUERIES[f"{name}_every50"](spark, data).select(anchor).collect()}
    assert max(ids) >= 20 and got == ids


def test_searches_fold_accents_and_hyphens(spark):
    cat = spark.createDataFrame([(1, "Amélie", 5), (2, "Spider-Man", 4), (3, "Ａ plain one", 9), (4, None, 8), (5, "Amelie again", 7)], "id int, t string, pop int")
    q = spark.createDataFrame([("amelie",), ("spider man",), ("SPIDER-MAN",), ("spydar mann",), ("a",), (None,)], "query string")
    got = {}
    for r in tiered(cat, q, "id", "t", "pop", 5, fuzzy=True).orderBy("query", "rk").collect():
        got.setdefault(r.query, []).append((r.tier, r.id))
    assert got == {"amelie": [(1, 5), (1, 1)], "spider man": [(1, 2)], "SPIDER-MAN": [(1, 2)], "spydar mann": [(3, 2)]}
    assert tiered(cat.limit(0), q, "id", "t", "pop", 5, fuzzy=True).count() == 0


def test_similarity_of_strings():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_letters(a, b) == table[-1][-1]
        assert 0 <= weighted_ratio(a, b) <= 1 and abs(weighted_ratio(a, b) - weighted_ratio(b, a)) < 1e-12
    assert weighted_ratio("new york mets", "mets new york") == 0.95
    assert weighted_ratio("dune", "dune") == 1 and weighted_ratio("dune", "") == 0
    assert weighted_ratio("saga", "the long saga of a house") >= 0.85 > weighted_ratio("saga", "the long saga of a house by the sea")


def test_matches_need_title_and_author(spark):
    books = spark.createDataFrame([("1", "The Upright Fable", "Stahond Hiwis"), ("2", "The Upright Fable", "Another Writer"), ("3", "Old Ways", None), ("4", None, "x"), (None, "Old Ways", "x")], "book_id string, title string, who string")
    want = spark.createDataFrame([("Teh Uprihgt Fable", "S. Hiwis"), ("old ways", None), ("nothing such", None), ("Upright Fable", "Nobody Else At All")], "query string, by string")
    assert {(r.query, r.book_id) for r in matched(want, books, "book_id", "title", "who").collect()} == {("Teh Uprihgt Fable", "1"), ("old ways", "3")}

@pytest.mark.parametrize("other", [None, ["v"]])
def test_split_join_with_hot_keys(spark, other):
    left = spark.createDataFrame([(k % 3 if k % 2 else 7, k) for k in range(900)] + [(None, 1), (99, 2)], "k int, u int")
    right = spark.createDataFrame([(0, 0), (1, 1), (7, 2), (7, 3), (None, 4), (5, 5)] + [(7, v) for v in range(100, 400)], "k int, v int")
    want = sorted(map(tuple, left.join(right, ["k"]).collect()))
    assert sorted(map(tuple, split_join(left, right, ["k"], ["u"], other, block=20).select("k", "u", "v").collect())) == want
    if other is None:
        assert split_join(left, right, ["k"], ["u"], how="left", block=20).count() == left.join(right, ["k"], "left").count()
        assert split_join(left, right, ["k"], ["u"], how="left_semi", block=20).count() == left.join(right, ["k"], "left_semi").count()
    assert split_join(left.limit(0), right, ["k"], ["u"], other).count() == 0


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_ready(SimpleNamespace(sparkContext=context, conf={}))
