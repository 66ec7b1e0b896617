"""Ratios against medians do not hang on the order in which prices are summed."""

from pyspark.sql import functions as F

from tessera.operators import series


def test_equal_ratios_are_not_below_their_median(spark):
    prices = [0.1, 0.2, 0.3, 0.7, 1e9, 84197.04]
    rows = [(k, p) for k in range(6) for p in (prices[k:] + prices[:k])]
    x = spark.createDataFrame(rows, "s_suppkey long, l_extendedprice double").coalesce(1).groupBy("s_suppkey").agg(series.exact_sum("l_extendedprice").alias("sales"))
    x = x.withColumns({"s_nationkey": F.lit(1), "s_acctbal": F.lit(3.7)})
    assert x.select("sales").distinct().count() == 1
    assert series.ratio_screen(x).count() == 0
