"""Shards by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends region, rack and shard. At each level every child draws
-ln(u) / weight from a hash of (doc_id, the child's path) and the smallest draw
wins, so a child gets rows in proportion to its weight, and a change of one
weight moves rows only into or out of the subtree that holds it. A new shard
opens a region of its own (`grow`): its draw is the only new one on the path of
any row, so rows move into the new shard and nowhere else.

Defined cases: a null or empty text has size 1 and checksum 0; a null doc_id
hashes as the empty string and sorts first in its bucket; rows that repeat a doc_id land in the same shard, each
with its own slot; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import hash52, plain, written


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0


#: A tree is {region: {rack: [Shard, ...]}}.
Tree = dict[str, dict[str, list[Shard]]]


def base_tree(regions: int = 2, racks: int = 2, shards: int = 2) -> Tree:
    number = iter(range(regions * racks * shards))
    return {f"g{g}": {f"r{r}": [Shard(next(number)) for _ in range(shards)] for r in range(racks)} for g in range(regions)}


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    number = 1 + max(s.number for racks in tree.values() for shards in racks.values() for s in shards)
    return {**tree, f"g{len(tree)}": {"r0": [Shard(number, weight)]}}


def _draw(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The third part of the child with the smallest draw; children are (path, weight, result)."""
    if len(children) == 1:
        return children[0][2]

    def draw(path: str, weight: float) -> Column:
        return -F.log((hash52(key, F.lit(path)) + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weight))

    return F.array_min(F.array(*[F.struct(draw(p, w).alias("d"), F.lit(i).alias("i"), c.alias("c")) for i, (p, w, c) in enumerate(children)]))["c"]


def shard_column(key: Column, tree: Tree) -> Column:
    """The shard number of a key, by descent through the tree."""
    regions = []
    for g, racks in tree.items():
        inside = []
        for r, shards in racks.items():
            leaf = _draw(key, [(f"{g}/{r}/{s.number}", s.weight, F.lit(s.number)) for s in shards])
            inside.append((f"{g}/{r}", sum(s.weight for s in shards), leaf))
        regions.append((g, sum(w for _, w, _ in inside), _draw(key, inside)))
    return _draw(key, regions)


def shard_documents(docs: DataFrame, tree: Tree | None = None, rows_per_bucket: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    Slots number a shard's rows from 0 without gaps. A shard is cut into hash
    buckets of about rows_per_bucket rows; slots are numbered inside a bucket and
    shifted by the counts of the shard's earlier buckets, so no task sorts a
    whole shard.
    """
    tree = tree or base_tree()
    text = plain(F.col("text"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumns({"shard": shard_column(F.col("doc_id"), tree), "grown_shard": shard_column(F.col("doc_id"), grow(tree))})
    rows = written(rows, "shards")
    buckets = max(1, -(-rows.count() // rows_per_bucket))
    rows = rows.withColumn("bucket", (hash52(F.col("doc_id"), F.col("text_crc32"), F.lit("slot")) % F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard"
    )


def _sql_draw(children: list[tuple[str, float, str]]) -> str:
    if len(children) == 1:
        return children[0][2]
    draws = [f"{{'d': -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{p}'), 1, 13))::BIGINT + 0.5::DOUBLE) / {2**52}::DOUBLE) / {float(w)}::DOUBLE, 'i': {i}, 'c': {c}}}" for i, (p, w, c) in enumerate(children)]
    return f"list_min([{', '.join(draws)}]).c"


def _sql_shard(tree: Tree) -> str:
    regions = []
    for g, racks in tree.items():
        inside = []
        for r, shards in racks.items():
            leaf = _sql_draw([(f"{g}/{r}/{s.number}", s.weight, str(s.number)) for s in shards])
            inside.append((f"{g}/{r}", sum(s.weight for s in shards), f"({leaf})"))
        regions.append((g, sum(w for _, w, _ in inside), f"({_sql_draw(inside)})"))
    return _sql_draw(regions)


def shards_only_sql() -> str:
    """DuckDB SQL of the columns that need no CRC-32 (it has none); the tests check the rest by hand."""
    tree = base_tree()
    return f"SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, ({_sql_shard(tree)})::INT AS shard, ({_sql_shard(grow(tree))})::INT AS grown_shard FROM documents"
