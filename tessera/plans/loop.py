"""Loops of DataFrame jobs: each round is written to a folder that all executors share, which cuts the lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; only a local master may leave that unset, and gets a folder of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tessera_loops", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = sc._tessera_loops = "file://" + tempfile.mkdtemp(prefix="tessera-loops-")
    return found.rstrip("/")


def kept(df: DataFrame, name: str = "round") -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(start: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], DataFrame], stop: Callable[[Row], bool] | None = None, most: int = 60) -> DataFrame:
    """Apply step until measure (a one-row DataFrame) repeats itself, or stop accepts it; fails loudly after `most` rounds."""
    state = kept(start)
    before = measure(state).first()
    if stop and stop(before):
        return state
    for _ in range(most):
        state = kept(step(state))
        now = measure(state).first()
        if stop(now) if stop else now == before:
            return state
        before = now
    raise RuntimeError(f"the loop has not settled in {most} rounds")
