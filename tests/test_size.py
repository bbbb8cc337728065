"""What a query shuffles follows its input, not the rows it goes through on its way."""

import numpy as np

from kinolex import plans

DATA = "/root/testdata/sf0.01"


def shuffled(spark, run):
    """(result, MB written to shuffles meanwhile)."""
    written = lambda: sum(x.totalShuffleWrite() for x in [spark._jsc.sc().statusStore().executorList(True).apply(0)])
    before = written()
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, (written() - before) / 1e6


def test_tag_rerank_shuffles_ratings_only(spark):
    n, mb = shuffled(spark, lambda: plans.QUERIES["tag_rerank"](spark, DATA).count())
    assert n > 50_000 and mb < 1, (n, mb)


def test_topk_shuffles_no_corpus(spark, monkeypatch):
    import kinolex.operators.knn as K

    monkeypatch.setattr(K, "CORPUS_BLOCK", 200)
    monkeypatch.setattr(K, "QUERY_BLOCK", 100)
    x = np.random.default_rng(3).normal(size=(2000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, v array<double>")
    got, mb = shuffled(spark, lambda: K.exact_topk(df, df, 3, skip_self=True).collect())
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert {(r.query_id, r.rk): r.item_id for r in got} == {(q, k + 1): i for q in range(2000) for k, i in enumerate(np.argsort(-s[q])[:3])}
    assert mb < 2, mb  # the vectors, once


def test_half_up_is_sparks_round(spark):
    from pyspark.sql import functions as F

    from kinolex.operators.pools import half_up

    x = np.r_[np.arange(-2000, 2000) * 0.0123456789 / 2, 0.0617283945, -0.0617283945, np.random.default_rng(1).random(2000)]
    got = [r.y for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 9).alias("y")).collect()]
    assert got == half_up(x, 9).tolist()


def test_eval_tune_and_ablate_shuffle_no_offers(spark):
    for name, most in (("eval_tune", 4), ("eval_ablate", 4)):
        n, mb = shuffled(spark, lambda: plans.QUERIES[name](spark, DATA).count())
        assert n and mb < most, (name, n, mb)


def test_nearest_shuffles_no_asked_partitions(spark, monkeypatch):
    import kinolex.llm.vectors as V

    monkeypatch.setattr(V, "PER_PARTITION", 100)
    x = np.random.default_rng(5).normal(size=(2000, 128)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>").cache()
    df.count()
    n, mb = shuffled(spark, lambda: V.nearest(df, "vec_id", "embedding").count())
    assert n == 5 * 2000 and mb < 6, (n, mb)  # 1 MB of vectors, moved four times


def test_bands_in_rounds_find_the_same(spark, monkeypatch):
    from kinolex.llm import nearcopies as N

    rounds = N.band_rounds(36_000_000, 1200)
    assert [b for r in rounds for b in r] == list(range(1200)) and max(map(len, rounds)) <= N.KEYS_A_CLASS
    words = [f"w{k}" for k in range(400)]
    rng = np.random.default_rng(2)
    sets = [sorted(rng.choice(words, 30, replace=False).tolist()) for _ in range(60)]
    sets += [s[:27] + [f"x{k}"] for k, s in enumerate(sets)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "id int, words array<string>")
    run = lambda: sorted((r.rep_a, r.rep_b) for r in N.near_copies(df.selectExpr("cast(id as string) as id", "words"), "id", "words")[1].collect())
    once = run()
    monkeypatch.setattr(N, "PER_ROUND", 1)
    assert len(once) >= 60 and run() == once


def test_eval_ablate_shuffles_no_other_films_ratings(spark):
    n, mb = shuffled(spark, lambda: plans.QUERIES["eval_ablate"](spark, DATA).count())
    assert n == 5 and mb < 0.8, (n, mb)  # 1.0 with ratings of films without vectors and neighbours as rows


def test_ablation_ranks_only_what_a_list_holds(monkeypatch, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    import kinolex.plans.eval_queries as E

    rng, films, folds = np.random.default_rng(4), 4000, []
    near = {k: sorted(rng.choice(films, 100, replace=False).tolist()) for k in range(0, films, 2)}
    sims = {k: np.sort(rng.integers(0, 40, 100) * 10_000_000).tolist() for k in near}  # with ties
    kinds = {k: rng.integers(0, 8, 100).tolist() for k in near}
    table = {"key": pa.array(near), "items": pa.array(near.values()), "sims": pa.array(sims.values(), pa.list_(pa.int32())), "kinds": pa.array(kinds.values(), pa.list_(pa.int8()))}
    pq.write_table(pa.table(table), tmp_path / "part-0.parquet")
    rows = []
    for p in range(300):
        own = rng.choice(films, 700 if p == 7 else int(rng.integers(3, 30)), replace=False).tolist()
        held = 0 if p % 10 == 3 else len(own) // 5
        rows += [(p, i, float(rng.choice([2.0, 3.5, 5.0])), n < held) for n, i in enumerate(own)]
    t = pa.table(dict(zip(("profile_id", "num", "rating", "is_relevant"), map(pa.array, zip(*rows)))))

    class Counted(E._Fold):
        def __init__(self, *a):
            folds.append(1)
            super().__init__(*a)

    monkeypatch.setattr(E, "_Fold", Counted)
    got = {(r["variant"], r["profile_id"]): r for b in E._ablated(str(tmp_path))(t) for r in b.to_pylist()}
    want, held = {}, 0
    for p in range(300):
        mine = [r for r in rows if r[0] == p]
        known, wanted = {i for _, i, _, rel in mine if not rel}, [i for _, i, _, rel in mine if rel]
        likes = [i for _, i, stars, rel in sorted(mine, key=lambda r: (-r[2], r[1])) if not rel and stars >= E.LIKE and i in near]
        held += bool(wanted) and (len(wanted) > E.POOL or any(w in near[a] for w in wanted for a in likes))
        for name, (turns, penalty, floor) in E.VARIANTS.items():
            bit = 1 << E.FLOORS.index(floor)
            queue = [sorted((round(penalty * 1e9) * (k >> E.ALIKE & 1) - s, i) for i, s, k in zip(near[a], sims[a], kinds[a]) if k & bit and i not in known) for a in likes]
            if turns:
                order, more = [], True
                while more and len(order) < 50:
                    more = False
                    for q in queue:
                        for i in [i for _, i in q if i not in order][:2]:
                            if len(order) < 50:
                                order, more = [*order, i], True
            else:
                best = {}
                for less, i in sum(queue, []):
                    best[i] = min(best.get(i, less), less)
                order = sorted(best, key=lambda i: (best[i], i))
            if wanted:
                want[name, p] = [round(len(set(order[:k]) & set(wanted)) / len(wanted), 6) for k in (10, 20, 50)]
    assert {k: [r["r10"], r["r20"], r["r50"]] for k, r in got.items()} == want and all(r["any"] for r in got.values())
    assert sum(x[2] > 0 for x in want.values()) > 50 and len(folds) == 3 * held < 3 * 270
    alone = t.filter(pa.array([r[0] == 3 for r in rows]))  # nothing relevant, but candidates
    assert [(r["r10"], r["any"]) for b in E._ablated(str(tmp_path))(alone) for r in b.to_pylist()] == [(None, True)] * 5
