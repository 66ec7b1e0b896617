"""Exact order statistics of groups of any size: values are counted, range-partitioned with their counts, and only the ranges that hold a wanted rank are opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.loop import kept


def counted_values(rows: DataFrame, group: str, value: str, ranges: int | None = None) -> DataFrame:
    """(group, value, times, range): the distinct values of each group in ranges of (group, value), ascending; written once.

    Rows without a value are left out; rows without a group are a group of their own. A repeated value is one row, so neither a large group nor a
    frequent value makes a large range.
    """
    counts = rows.select(group, value).filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("times"))
    ordered = counts.repartitionByRange(ranges, group, value) if ranges else counts.repartitionByRange(group, value)
    return kept(ordered.withColumn("range", F.spark_partition_id()), "counted-values")


def at_ranks(counts: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(group, n, a column per rank): the values at the 0-based ranks, stated as columns of n, the group's number of values; null where there is no such rank.

    Sums per range give each range's first rank; what is then ordered is the ranges with a wanted rank, each by itself.
    """
    sums = counts.groupBy(group, "range").agg(F.sum("times").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumns({"_first": F.coalesce(before, F.lit(0)), "n": F.sum("_rows").over(Window.partitionBy(group))})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    inside = lambda at, first, size: (at >= first) & (at < first + size)
    asked = sums.withColumn("_wanted", F.filter(wanted, lambda w: inside(w["rank"], F.col("_first"), F.col("_rows"))))
    opened = asked.filter(F.size("_wanted") > 0).select(F.col(group).alias("_group"), F.col("range").alias("_range"), "_first", "_wanted")
    near = counts.join(opened, counts[group].eqNullSafe(F.col("_group")) & (counts["range"] == F.col("_range")))
    upto = F.sum("times").over(Window.partitionBy(group, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_at", F.col("_first") + upto - F.col("times"))
    hits = near.withColumn("_hits", F.filter("_wanted", lambda w: inside(w["rank"], F.col("_at"), F.col("times")))).filter(F.size("_hits") > 0)
    named = lambda name: F.max(F.when(F.exists("_hits", lambda w: w["name"] == name), F.col(value))).alias(name)
    picked = hits.groupBy(group).agg(*map(named, ranks)).withColumnRenamed(group, "_group")
    sizes = counts.groupBy(group).agg(F.sum("times").alias("n"))
    return sizes.join(picked, sizes[group].eqNullSafe(picked["_group"]), "left").drop("_group")


def summary(counts: DataFrame, group: str, value: str) -> DataFrame:
    """(group, least, most, mean, zero): of all values of each group; zero is the share of values that are 0."""
    times = F.col("times")
    mean, zero = F.sum(F.col(value) * times) / F.sum(times), F.sum(F.when(F.col(value) == 0, times).otherwise(0)) / F.sum(times)
    return counts.groupBy(group).agg(F.min(value).alias("least"), F.max(value).alias("most"), mean.alias("mean"), zero.alias("zero"))


def with_summary(counts: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """`at_ranks` and `summary` of each group in one row."""
    found, rest = at_ranks(counts, group, value, ranks), summary(counts, group, value).withColumnRenamed(group, "_group")
    return found.join(rest, found[group].eqNullSafe(rest["_group"])).drop("_group")
