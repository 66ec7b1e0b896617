"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source is a queue of its documents in a hashed order, passed up to
`passes` times. Documents are served in packets of up to `packet` words, so that a long
one can't throw its source off the target; a packet's virtual finish time is
the source's cumulative words through it, divided by the source's target. The mix is the
globally sorted sequence of all packets, cut where the total budget is spent.

Targets share the budget in proportion to weight. A target stops at `passes`
times the source's size, and what it can't use is shared by weight among the others:
with sources in ascending order of cap / weight, the water level is that of the first source
whose cap lies above it.

Defined cases: null and empty texts have size 0 and nothing is taken from them;
the null source comes last; a null doc_id hashes as ''; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import hash52, parallelism, plain, written


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text."""
    bare = F.btrim(plain(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = 3) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source; weights repeat over the sources in code-point order."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")).cast("double")
    s = sizes.select("source", "source_size", weight.alias("weight"), (passes * F.col("source_size")).alias("cap"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    s = s.withColumns(
        {
            "left": F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)),
            "open": F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
        }
    ).withColumn("level", F.col("left") / F.col("open"))
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(total)["level"])
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = 3, packet: int = 64, rows_per_bucket: int = 20_000, key: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs, and its columns `key`, by which rows of one doc_id and size are ordered.

    The running sum of a source is taken inside hash buckets and shifted by the
    sums of earlier buckets, so one source may hold any share of the rows. What
    finishes by virtual time 1 fits the budget, as the targets add up to it; packets that
    begin by the time when every source has had its target are range-sorted and cut
    where the rest of the budget ends. No later packet can come before that cut.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", *key, "source", word_count(F.col("text")).alias("size"))
    rows = written(rows.withColumn("place", hash52(F.col("doc_id"), F.lit("mix"))), "mix")
    bits = max(rows.count() // rows_per_bucket, parallelism(spark)).bit_length()
    rows = rows.withColumn("bucket", F.shiftright("place", 52 - bits).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sums = written(sums, "mix-sums")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    targets = written(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, passes), "mix-targets")
    starts = starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "source_size", "target")

    order = ["place", "doc_id", "size", *key]
    inside = Window.partitionBy("source", "bucket").orderBy(*order)
    queue = rows.withColumns({"own": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(inside)})
    queue = (
        queue.alias("q")
        .join(starts.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.bucket") == F.col("s.bucket")))
        .select("doc_id", *key, "size", "q.source", "source_size", "target", (F.col("start") + F.col("own")).alias("through"), (F.col("first") + F.col("rank")).alias("nth"))
    )

    def sure(e: int) -> Column:
        """Words of pass e in packets that finish by time 1."""
        begin = F.col("through") - F.col("size") + e * F.col("source_size")
        whole = F.floor((F.col("target") - begin) / packet) * packet
        return F.when(begin + F.col("size") <= F.col("target"), F.col("size")).otherwise(F.greatest(F.lit(0), whole)).cast("long")

    queue = written(queue.withColumns({"passes": F.array(*map(sure, range(passes)))}), "mix-queue")
    # By this time every source that can go on has had its target.
    slack = targets.filter(f"target > 0 AND target < {passes} * source_size").agg((1 + packet / F.min("target")).alias("until"))
    rest = queue.filter("size > 0 AND target > 0").join(F.broadcast(slack))  # one row
    rest = rest.select("source", "nth", "size", "target", "until", F.posexplode("passes").alias("e", "sure"), F.col("through"), "source_size").filter("sure < size")
    rest = rest.withColumn("begin", F.col("through") - F.col("size") + F.col("e") * F.col("source_size")).filter("begin < until * target")
    ends = F.least(F.ceil(F.col("size") / packet) - 1, F.floor((F.col("until") * F.col("target") - F.col("begin")) / packet))
    late = rest.select("source", "nth", "e", "size", "target", "begin", F.explode(F.sequence(F.floor(F.col("sure") / packet), F.greatest(ends, F.floor(F.col("sure") / packet)))).alias("k"))
    late = late.withColumn("words", F.least(F.lit(packet), F.col("size") - F.col("k") * packet))
    late = late.select("source", "nth", "e", "k", "words", ((F.col("begin") + F.col("k") * packet + F.col("words")) / F.col("target")).alias("finish"))
    order = ["finish", F.col("source").asc_nulls_last(), "nth", "e", "k"]
    late = written(late.repartitionByRange(parallelism(spark), *order).withColumn("part", F.spark_partition_id()), "mix-late")
    budget = queue.agg((F.sum("size") - F.sum(F.aggregate("passes", F.lit(0).cast("long"), lambda a, b: a + b))).alias("budget"))
    parts = late.groupBy("part").agg(F.sum("words").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    parts = parts.join(F.broadcast(budget), parts["start"] < budget["budget"])  # one row; parts past the budget go
    late = late.join(F.broadcast(parts), "part")  # one row per shuffle partition
    before = F.col("start") + F.coalesce(F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    late = late.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - before))).filter("taken > 0")
    late = late.groupBy("source", "nth").agg(F.sum("taken").alias("more"))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, b: a + b) + F.coalesce("more", F.lit(0))
    return (
        queue.alias("q")
        .join(late.alias("l"), F.col("q.source").eqNullSafe(F.col("l.source")) & (F.col("q.nth") == F.col("l.nth")), "left")
        .select("doc_id", *key, "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("q.source").alias("source"))
    )


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix'), 1, 13))::BIGINT AS place
  FROM documents),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
  FROM d GROUP BY source),
s1 AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM s0),
s2 AS (
  SELECT *,
    ((SELECT sum(source_size) FROM s1) - coalesce(sum(cap) OVER w, 0))::DOUBLE
      / ((SELECT sum(weight) FROM s1) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s1 WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (
  SELECT source, source_size,
    least(cap::DOUBLE, weight * (SELECT arg_min(level, ratio) FROM s2 WHERE level <= ratio)) AS target
  FROM s2),
q AS (
  SELECT d.*, source_size, target,
    sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS through,
    row_number() OVER (PARTITION BY d.source ORDER BY place, doc_id, size) AS nth
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (
  SELECT q.source, nth, e, k, least(64, size - k * 64) AS words,
    (through - size + e * source_size + k * 64 + least(64, size - k * 64))::DOUBLE / target AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS e) e, unnest(range(0, (size + 63) // 64)) AS u(k) WHERE target > 0),
r AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY finish, source NULLS LAST, nth, e, k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM p),
t AS (SELECT source, nth, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - before))) AS taken FROM r GROUP BY source, nth)
SELECT doc_id, size, source_size, target, q.source, coalesce(taken, 0)::BIGINT AS taken
FROM q LEFT JOIN t ON q.source IS NOT DISTINCT FROM t.source AND q.nth = t.nth
"""
