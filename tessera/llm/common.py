"""Helpers of the operators in this folder."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The ASCII white space of the word rule, as used in Java and in RE2 patterns.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What operators keep in a Python worker between tasks; the worker lives on through later stages. A function that Spark sends out
#: must reach its cache through a function of its module: a global that it names itself is sent along as a copy.
KEPT_IN_WORKERS: list[dict] = []
#: Rows that a worker function turns into Python objects at a time.
SLICE = 512


def release(but: dict | None = None) -> None:
    """Let go of what other operators have kept in this Python worker, and give the memory back to the machine."""
    held = [cache for cache in KEPT_IN_WORKERS if cache and cache is not but]
    for cache in held:
        cache.clear()
    if held:
        trim()


def trim() -> None:
    """Give freed memory back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; only a local master may leave it unset, and gets one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tessera_folder", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = sc._tessera_folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back with its own schema."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def python_path(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(text: Column) -> Column:
    """Text with null as the empty string."""
    return F.coalesce(text, F.lit(""))


def hash52(*parts: Column) -> Column:
    """A long below 2^52 from the MD5 of the parts joined by '|' (null parts as ''): SQL engines agree on it."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def id_text(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """Rows (id, UTF-8 text) of an Arrow batch whose first column is the id and whose second is binary or string; null texts are empty."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
    for i, t in zip(ids, texts):
        yield i, t or b""
