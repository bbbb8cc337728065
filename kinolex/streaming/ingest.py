"""Structured Streaming forms of the resumable ingest, the idempotent upsert and the rating session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinolex.operators.relational import upsert_last


def append_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """JSON lines that arrive in a folder are appended to a Parquet table; the checkpoint makes it resumable."""
    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions of an upserted table, from the file system it lies on. What can't be listed is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    if not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"{target} is no folder of versions")
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    done = lambda v: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{v}/_SUCCESS"))
    return sorted(int(v[2:]) for v in names if v.startswith("v=") and done(v))


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest complete version of an upserted table, or None."""
    done = versions(spark, target)
    return spark.read.parquet(f"{target}/v={done[-1]}") if done else None


def upsert_stream(rows: DataFrame, keys: list[str], order: str, target: str, checkpoint: str):
    """Each micro-batch replaces rows by key in a versioned table; a batch that is run again writes the same version.

    A batch fails, and writes nothing, if the versions can't be listed, if an earlier batch has left none, or if there
    are later ones (the checkpoint isn't this table's): history is never replaced by a batch alone.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in batch.columns if c not in keys]).select(*batch.columns)
        done = versions(spark, target)
        prior = [v for v in done if v < batch_id]
        if batch_id > 0 and not prior:
            raise RuntimeError(f"{target} holds no version before batch {batch_id}")
        if any(v > batch_id for v in done):
            raise RuntimeError(f"{target} holds versions after batch {batch_id}")
        out = upsert_last(spark.read.parquet(f"{target}/v={prior[-1]}"), newest, keys) if prior else newest
        out.write.mode("overwrite").parquet(f"{target}/v={batch_id}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window; rows later than the watermark no longer count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_state(actions: DataFrame) -> DataFrame:
    """Ratings of each profile after its add, remove and clear actions: the first add wins until it is removed.

    actions: profile_id, item_id, action, rating, seq. The same plan serves a batch and the state of a stream's history.
    """
    clear = actions.where("action = 'clear'").groupBy("profile_id").agg(F.max("seq").alias("cleared"))
    live = actions.where("action <> 'clear'").join(clear, "profile_id", "left").where(F.col("cleared").isNull() | (F.col("seq") > F.col("cleared")))
    w = Window.partitionBy("profile_id", "item_id")
    live = live.withColumn("gone", F.max(F.when(F.col("action") == "remove", F.col("seq"))).over(w))
    adds = live.where((F.col("action") == "add") & (F.col("gone").isNull() | (F.col("seq") > F.col("gone"))))
    return adds.groupBy("profile_id", "item_id").agg(F.min_by("rating", "seq").alias("rating"))
