"""Readers and sinks for the dumps a catalogue comes in, and a paged source that can be resumed."""

from __future__ import annotations

import io
import json
import os
import time
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header, quoted fields that may span lines; values that don't fit the schema become null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")


def read_tsv(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    r"""Tab-separated, perhaps gzipped, with \N for null and no quoting. gzip can't be split: ``partitions`` spreads it."""
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, nullValue="\\N", quote="")
    return df.repartition(partitions) if partitions else df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def opened(uri: str):
    """A seekable file of any file system that pyarrow knows (local, HDFS, object stores), also on executors."""
    system, path = pa.fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{os.path.abspath(uri)}")
    return io.BufferedReader(system.open_input_file(path), 1 << 20)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Hadoop's file systems write it, so that two spellings can be compared."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_zip_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first .csv member of each zip file, all columns read as text and cast to the schema.

    Each file is opened where its task runs and unpacked as a stream, so its size doesn't matter.
    """
    target = spark.createDataFrame([], schema).schema
    names = [f.name for f in target.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                with opened(uri) as raw, zipfile.ZipFile(raw) as z:
                    member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                    if member:
                        with z.open(member) as f:
                            for part in pd.read_csv(f, dtype=str, keep_default_na=False, na_values=[""], chunksize=50_000):
                                yield part.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)

    text = spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, ", ".join(f"`{n}` string" for n in names))
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in target.fields])


def write_table(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Parquet, csv or json; a path that the plan reads must not be its target."""
    target = qualified(df.sparkSession, path)
    if any(qualified(df.sparkSession, f).startswith(target.rstrip("/") + "/") for f in df.inputFiles()):
        raise ValueError(f"{path} is read by the same plan")
    w = df.write.mode("overwrite").options(**options)
    {"parquet": w.parquet, "csv": lambda p: w.csv(p, header=True), "json": w.json}[kind](path)


def from_half(df: DataFrame, halves: str, out: str) -> DataFrame:
    """Adds the vector of bytes of half-precision numbers, the inverse of to_half; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [None if h is None else np.frombuffer(h, np.float16).astype(np.float32) for h in b.column(halves).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, pa.list_(pa.float32()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def read_npy(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """(row_no, v) of a two-dimensional .npy file of half, single or double precision; a task reads ``rows`` of them."""
    with opened(path) as f:
        major, _ = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(f)
        begin = f.tell()
    if fortran or len(shape) != 2 or dtype.kind != "f":
        raise ValueError(f"{path} holds no rows of floating-point numbers")
    n, dim = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                with opened(path) as g:
                    g.seek(begin + k * rows * dim * dtype.itemsize)
                    x = np.frombuffer(g.read(min(rows, n - k * rows) * dim * dtype.itemsize), dtype).astype(np.float32)
                some = np.arange(len(x) // dim, dtype=np.int64)
                v = pa.ListArray.from_arrays(pa.array(np.append(some, len(some)) * dim, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(some + k * rows), v], names=["row_no", "v"])

    parts = -(-n // rows)
    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(run, "row_no bigint, v array<float>")


def to_half(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Adds the vector as bytes of half-precision numbers; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half = [None if v is None else np.array([np.nan if x is None else x for x in v], np.float16).tobytes() for v in b.column(vector).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(half, pa.binary())], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


class _Page(InputPartition):
    def __init__(self, at: int, limit: int, byte: int):
        self.at, self.limit, self.byte = at, limit, byte


class PagedSource(DataSource):
    """Pages of a JSON-lines file as an API would serve them: options path, limit (50), start (rows fetched before), target,
    tries (4) and backoff (5 seconds, then 10, 15, ...).

    Each page is a partition and is read from its own place. Resuming means passing the number of rows already stored as
    ``start``. A page that fails is tried again; after the last time its task fails.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_jsonl"

    def schema(self) -> str:
        return "row_no bigint, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("limit", "50"))
        self.start, self.target = int(options.get("start", "0")), int(options.get("target", "25000"))

        self.tries, self.backoff = int(options.get("tries", "4")), float(options.get("backoff", "5"))

    def partitions(self):
        pages, byte = [], 0
        with opened(self.path) as f:
            for k, line in enumerate(iter(f.readline, b"")):
                if k >= self.target:
                    break
                if k >= self.start and (k - self.start) % self.limit == 0:
                    pages.append(_Page(k, min(self.limit, self.target - k), byte))
                byte += len(line)
        return pages or [_Page(0, 0, 0)]

    def _page(self, partition) -> list[tuple[int, str]]:
        with opened(self.path) as f:
            f.seek(partition.byte)
            lines = [f.readline().decode().rstrip("\n") for _ in range(partition.limit)]
        lines = [x for x in lines if x]
        for x in lines:
            json.loads(x)  # a broken page is a failure
        return [(partition.at + k, x) for k, x in enumerate(lines)]

    def read(self, partition):
        for k in range(self.tries):
            try:
                page = self._page(partition)
                break
            except (OSError, ValueError):
                if k == self.tries - 1:
                    raise
                time.sleep(self.backoff * (k + 1))
        yield from page


def hash_embed(df: DataFrame, text: str, out: str, dim: int = 64) -> DataFrame:
    """Adds a unit vector made of the words' hashes: a deterministic stand-in where no encoder is at hand.

    Each word adds +1 or -1 to one of ``dim`` places; words are hashed in the JVM and summed by Arrow batches. Null and
    empty texts give a vector of zeros.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1).otherwise(-1) * (1 + F.pmod(F.xxhash64(w), F.lit(dim))).cast("int"))
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("_cells")
            cell, count = c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(c.offsets.to_numpy())
            x = np.zeros((b.num_rows, dim))
            np.add.at(x, (np.repeat(np.arange(b.num_rows), count), np.abs(cell) - 1), np.sign(cell))
            x = (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)).astype(np.float32)
            v = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), v], names=[*kept, out])

    return df.withColumn("_cells", cells).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))
