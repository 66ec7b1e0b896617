"""Graphs cut into lots: whole weak components of bounded size, so that a task holds all that its starts can reach and searches without a job per round.

A lot is one component, or small ones together; no edge leaves it. Components beyond the bounds have no lot, and are searched by rounds of joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.loop import kept

#: Edges and nodes of a component that a task holds whole, and edges and nodes that small components fill a lot with.
LOT_EDGES, LOT_NODES, SHARE = 4_000_000, 500_000, 100_000
#: Edges that are contracted at a time.
AT_ONCE = 1 << 20


def components(e: DataFrame, n: DataFrame, most: int = 60) -> DataFrame:
    """(id, component): weakly connected components, named by their smallest id. In each round a label takes the least of its smaller neighbours, with pointer jumping, and edges within a label go, so that few are left for the next."""
    ids = n.select("id")
    between = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("src <> dst").distinct()
    for end in ("a", "b"):
        between = between.join(ids.withColumnRenamed("id", end), end, "left_semi")
    between, now = kept(between.select("a", "b"), "between"), kept(n.select("id", F.col("id").alias("component")))
    for _ in range(most):
        if not between.head(1):
            return now
        up = between.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to"))
        for _ in range(3):
            up = kept(up, "labels")
            up = up.join(up.select(F.col("label").alias("to"), F.col("to").alias("then")), "to", "left").select("label", F.coalesce("then", "to").alias("to"))
        up = kept(up, "labels")

        def moved(rows: DataFrame, column: str, up: DataFrame = up) -> DataFrame:
            return rows.join(up.withColumnRenamed("label", column), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

        now = kept(moved(now, "component").select("id", "component"))
        ends = moved(moved(between, "a"), "b").filter("a <> b")
        between = kept(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "between")
    raise RuntimeError(f"components are not found in {most} rounds")


def coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of all columns, and each column as places in them."""
    whole = pa.chunked_array([x for c in columns for x in c.chunks], columns[0].type).combine_chunks()
    whole = (whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole).dictionary_encode()
    codes = whole.indices.to_numpy(zero_copy_only=False)
    return whole.dictionary, np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst -> src, dst: fewer edges that join the same nodes, a star for each component of the edges at hand."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        ids, (a, b) = coded(rows.column(0), rows.column(1))
        label = np.arange(len(ids))
        while len(a):
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != (up := label[label])).any():
                label = up
            a, b = label[a], label[b]
            a, b = a[a != b], b[a != b]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(label)), ids], ["src", "dst"])

    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= AT_ONCE:
            yield stars(held)
            held, rows = [], 0
    if rows:
        yield stars(held)


def lots(e: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, lot, size): the lot of each node of the edges (src, dst; no nulls) and of the starts (id), null where its component is too large, and the lot's number of nodes.

    Edges are joined where they lie before components are found, so neighbours that lie together leave few edges.
    """
    kind = e.schema["src"].dataType.simpleString()
    forest = kept(e.select("src", "dst").mapInArrow(_forest, f"src {kind}, dst {kind}"), "forest")
    ids = forest.select(F.col("dst").alias("id")).unionByName(starts.select("id")).distinct()
    found = components(forest, ids)
    degree = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    sizes = kept(found.join(degree, "id", "left").groupBy("component").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("out"), F.lit(0)).alias("edges")), "sizes")
    large, small = (F.col("nodes") > LOT_NODES) | (F.col("edges") > LOT_EDGES), F.col("nodes") + F.col("edges") < SHARE
    shares = math.ceil((sizes.filter(small).agg(F.sum(F.col("nodes") + F.col("edges"))).first()[0] or 0) / SHARE)
    lot = F.when(large, None).when(small, F.pmod(F.xxhash64("component"), F.lit(max(shares, 1)))).otherwise(F.xxhash64("component"))
    sizes = sizes.withColumn("lot", lot).withColumn("size", F.sum("nodes").over(Window.partitionBy("lot")))
    return kept(found.join(sizes, "component").select(F.col("id").alias("node"), "lot", "size"), "lots")


def dealt(e: DataFrame, starts: DataFrame, of: DataFrame, cells: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(lot, block, and the edges' columns) and (lot, block, id): each start in a block of its lot, with all edges of the lot. A block has at most `most` starts, and at most `cells` of nodes times starts (or one start)."""
    at = starts.join(of.withColumnRenamed("node", "id"), "id").filter("lot IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("lot").orderBy("id")) - 1
    at = kept(at.select("lot", F.floor(place / F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(cells) / F.col("size"))))).alias("block"), "id"), "dealt-starts")
    inner = e.join(of.select(F.col("node").alias("src"), "lot").filter("lot IS NOT NULL"), "src")
    # A number of their own, so that tasks are not laid together by the size of their rows: it is the search that takes time.
    parts = e.sparkSession.sparkContext.defaultParallelism * 16
    inner = inner.join(at.select("lot", "block").distinct().toDF("lot", "block"), "lot").repartition(parts, "lot", "block")
    # Columns of their own names: both sides come from the same rows.
    return inner.select("lot", "block", *e.columns).toDF("lot", "block", *e.columns), at.toDF("lot", "block", "id").repartition(parts, "lot", "block")


def rest(e: DataFrame, starts: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The edges and starts (id) that no lot has, if there are any."""
    none = of.filter("lot IS NULL").select("node")
    if not none.head(1):
        return None
    return e.join(none.withColumnRenamed("node", "src"), "src", "left_semi").select(*e.columns), starts.join(none.withColumnRenamed("node", "id"), "id", "left_semi")
