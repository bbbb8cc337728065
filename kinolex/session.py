"""Session helpers: checkpoint folder, parallelism of small scans."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs

from pyspark.sql import DataFrame, SparkSession


def checkpoint_ready(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the shared folder that spark.checkpoint.dir names, else, with a local master only, an own one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="kinolex-ck-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there, so that lost executors don't recompute it."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more, without waiting for the driver's memory to fill."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame) -> str:
    """The folder, among the checkpoints, of ``df`` written as compressed columns; its shuffles are freed. It goes with the session."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    free(spark)
    return path


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete what ``stored`` has written; nothing may read it afterwards."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def compact(df: DataFrame) -> DataFrame:
    """As ``cut``, but in compressed columns, which take a fraction of the disk."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


def stored_batches(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """What ``stored`` has written, read by a Python worker in the same order each time."""
    if path.startswith("file:"):
        fs, at = pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    elif "://" in path:
        fs, at = pafs.FileSystem.from_uri(path)
    else:
        fs, at = pafs.LocalFileSystem(), path
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet"))
    for f in files:
        yield from ds.dataset(f, filesystem=fs, format="parquet").to_batches(columns=columns, batch_size=rows, batch_readahead=1, fragment_readahead=1, use_threads=False)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """More partitions for CPU-heavy Python work on small files; to be called on a scan with filters and projections only.

    A scan whose files already give enough partitions is left as it is, so nothing is shuffled at scale. Nothing runs
    here: the partitions are estimated from the plan's size and the session's split size.
    """
    spark = df.sparkSession
    want = per_core * spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if held >= want * split else df.repartition(want)


def shuffle_width(df: DataFrame) -> int:
    """Number of partitions for an explicit repartitioning: the session's setting, but no fewer than the cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
