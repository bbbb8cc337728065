import gzip
import json
import shutil
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolex.sources import files
from kinolex.streaming.ingest import append_stream, current, session_state, upsert_stream, versions, windowed_counts


def test_csv_tsv_json_zip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,votes\n1,"A, ""quoted""\nline",12.0\n2,,abc\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, title string, votes double").collect()
    assert [tuple(r) for r in rows] == [(1, 'A, "quoted"\nline', 12.0), (2, None, None)]
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write('id\tname\n1\t\\N\n2\t"x\n')
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "t.tsv.gz"), "id int, name string", 2).orderBy("id").collect()] == [(1, None), (2, '"x')]
    (tmp_path / "j.json").write_text('{"id": 1, "c": [{"a": "x"}]}\n{"id": 2}\n')
    got = files.read_jsonl(spark, str(tmp_path / "j.json"), "id int, c array<struct<a:string>>").orderBy("id").collect()
    assert got[0].c[0].a == "x" and got[1].c is None
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("d.csv", "id,v\n1,2.5\n2,bad\n")
    got = files.read_zip_csv(spark, str(tmp_path / "z.zip"), "id int, v double, w string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2.5, None), (2, None, None)]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_sinks_round_trip(spark, tmp_path, kind):
    df = spark.range(5).select("id", F.concat(F.lit('n "'), F.col("id").cast("string")).alias("name"))
    files.write_table(df, str(tmp_path / kind), kind)
    back = {"parquet": lambda: spark.read.parquet(str(tmp_path / kind)), "csv": lambda: spark.read.schema("id bigint, name string").csv(str(tmp_path / kind), header=True), "json": lambda: spark.read.schema("id bigint, name string").json(str(tmp_path / kind))}[kind]()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        files.write_table(back, str(tmp_path / kind), kind)


def test_half_precision_and_paged_source(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.5]), (2, None)], "id int, v array<float>")
    got = {r.id: r.h for r in files.to_half(df, "v", "h").collect()}
    assert np.frombuffer(got[1], np.float16).tolist() == [1.0, 0.5] and got[2] is None
    back = {r.id: r.w for r in files.from_half(files.to_half(df, "v", "h"), "h", "w").collect()}
    assert back[1] == [1.0, 0.5] and back[2] is None
    p = tmp_path / "api.jsonl"
    p.write_text("".join(json.dumps({"id": k}) + "\n" for k in range(120)))
    spark.dataSource.register(files.PagedSource)
    read = lambda **o: spark.read.format("paged_jsonl").options(path=str(p), **o).load()
    assert read(limit=50).count() == 120
    assert sorted(r.row_no for r in read(limit=50, start=100).collect()) == list(range(100, 120))
    assert read(limit=50, target=70).count() == 70 and read(start=500).count() == 0
    assert [json.loads(r.payload)["id"] for r in read(limit=7, start=3).orderBy("row_no").collect()] == list(range(3, 120))
    p.write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)json"):
        read(tries=2, backoff=0.01).collect()


@pytest.mark.parametrize("kind", [np.float16, np.float32])
def test_npy_rows(spark, tmp_path, kind):
    x = np.arange(70).reshape(14, 5).astype(kind)
    np.save(tmp_path / "v.npy", x)
    got = files.read_npy(spark, str(tmp_path / "v.npy"), rows=4).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(14)) and [r.v for r in got] == x.tolist()
    np.save(tmp_path / "w.npy", x[:0])
    assert files.read_npy(spark, str(tmp_path / "w.npy")).count() == 0


def test_hash_embedding(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: np.array(r.v) for r in files.hash_embed(df, "t", "v", 16).collect()}
    assert np.allclose(got[1], got[2]) and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and not got[3].any() and not got[4].any()


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id": 1, "v": 1, "seq": 1}\n{"id": 2, "v": 5, "seq": 2}\n')
    schema = "id int, v int, seq int"
    run = lambda: append_stream(spark, str(src), schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (src / "2.json").write_text('{"id": 1, "v": 7, "seq": 3}\n{"id": 1, "v": 6, "seq": 2}\n')
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    for _ in range(2):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        upsert_stream(rows, ["id"], "seq", str(tmp_path / "up"), str(tmp_path / "ck2")).awaitTermination()
    assert sorted((r.id, r.v) for r in current(spark, str(tmp_path / "up")).collect()) == [(1, 7), (2, 5)]


def test_windows_and_sessions(spark):
    e = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'view' as event_type union all select timestamp'2024-01-01 00:50:00', 'view' union all select timestamp'2024-01-01 01:01:00', 'view'")
    assert sorted(r.n for r in windowed_counts(e).collect()) == [1, 2]
    a = spark.createDataFrame(
        [(1, 5, "add", 4.0, 1), (1, 5, "add", 2.0, 2), (1, 6, "add", 3.0, 3), (1, 6, "remove", None, 4), (1, 6, "add", 1.0, 5), (2, 5, "add", 4.0, 1), (2, None, "clear", None, 2)],
        "profile_id int, item_id int, action string, rating double, seq int",
    )
    assert sorted(map(tuple, session_state(a).collect())) == [(1, 5, 4.0), (1, 6, 1.0)]


def test_history_that_is_missing_fails(spark, tmp_path):
    """A batch never stands for the whole table because earlier versions can't be found."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id": 1, "v": 1, "seq": 1}\n')
    run = lambda ck: upsert_stream(spark.readStream.schema("id int, v int, seq int").json(str(src)), ["id"], "seq", str(tmp_path / "up"), str(tmp_path / ck)).awaitTermination()
    run("ck")
    shutil.move(tmp_path / "up", tmp_path / "gone")
    (src / "2.json").write_text('{"id": 2, "v": 2, "seq": 2}\n')
    with pytest.raises(Exception, match="no version before"):
        run("ck")
    assert not (tmp_path / "up" / "v=1").exists()
    shutil.move(tmp_path / "gone", tmp_path / "up")
    run("ck")
    assert current(spark, str(tmp_path / "up")).count() == 2
    with pytest.raises(Exception, match="versions after"):
        run("another")
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError):
        versions(spark, str(tmp_path / "file"))
