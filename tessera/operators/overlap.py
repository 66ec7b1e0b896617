"""Set-overlap joins: pairs of entries with many common tags, and the entries that share most tags with each.

Inputs are tags (entry_id, tag); repeated rows count once, rows with a null in either are left out. Sets are ordered by the frequency
of their tags, rarest first, so frequent tags stand last and seldom have to be joined. Of a tag that stays frequent, rows meet in tiles
of a bounded number of rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.loop import kept

#: Rows of one tag that meet as many others in one tile.
BLOCK = 4_000


def tiles(left: DataFrame, right: DataFrame, size: Column, by: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join with _i and _j to join on besides the key, so that each two rows of a key meet once in a tile; size is the key's number of rows."""
    n = F.ceil(size / block).cast("int")
    own, every = F.pmod(F.xxhash64(by), n).cast("int"), F.explode(F.sequence(F.lit(0), n - 1))
    return left.withColumn("_i", own).withColumn("_j", every), right.withColumn("_j", own).withColumn("_i", every)


def tag_sets(tags: DataFrame) -> DataFrame:
    """(id, n, tags, items): each entry's n tags as numbers by ascending frequency, and the same with their frequencies as (df, tag); written once.

    Numbers stand for tags of any type, since sets of numbers meet much faster.
    """
    tags = tags.select(F.col("entry_id").alias("id"), "tag").filter("id IS NOT NULL AND tag IS NOT NULL")
    numbers = kept(tags.groupBy("tag").agg(F.count("*").alias("df")).withColumn("number", F.monotonically_increasing_id()), "tag-numbers")
    sets = tags.join(numbers, "tag").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("df", F.col("number").alias("tag")))).alias("items"))
    return kept(sets.select("id", F.size("items").alias("n"), F.col("items.tag").alias("tags"), "items"), "tag-sets")


def overlap_pairs(left: DataFrame, right: DataFrame, least: int, once: bool = False, block: int = BLOCK) -> DataFrame:
    """(a, b, shared): entries a of left and b of right, both from tag_sets of the same tags, that share at least `least` tags; with once a < b, else a <> b.

    Such a pair has its first common tag among the first n - least + 1 of either, and is met there alone; the sets travel with these tags, so only pairs that count leave the join.
    """

    def posts(sets: DataFrame) -> DataFrame:
        rows = sets.filter(F.col("n") >= least).select("id", "tags", F.explode(F.slice("items", F.lit(1), F.col("n") - least + 1)).alias("item"))
        return rows.select("id", "tags", F.col("item.tag").alias("tag"), F.col("item.df").alias("df"))

    x, y = tiles(posts(left), posts(right), F.col("df"), "id", block)
    x, y = x.alias("x"), y.alias("y")
    common = F.array_intersect("x.tags", "y.tags")
    apart = F.col("x.id") < F.col("y.id") if once else F.col("x.id") != F.col("y.id")
    met = x.join(y, (F.col("x.tag") == F.col("y.tag")) & (F.col("x._i") == F.col("y._i")) & (F.col("x._j") == F.col("y._j")) & apart & (F.size(common) >= least) & (F.get(common, F.lit(0)) == F.col("x.tag")))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.size(common).cast("long").alias("shared"))


def shared_tag_pairs(tags: DataFrame, least: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b, shared): pairs of entries, a < b, with at least `least` common tags."""
    sets = tag_sets(tags)
    return overlap_pairs(sets, sets, least, once=True, block=block)


def most_related(tags: DataFrame, top: int = 5, block: int = BLOCK) -> DataFrame:
    """(a, b, shared, rank): the `top` entries that share most tags with each entry, at least one; of equals the smaller ids.

    Pairs are looked for by falling thresholds of common tags (32, 8, 2), each time for the entries alone that have not yet found `top` partners:
    whoever has, can't have a better one below the threshold. What is then missing shares one tag, so it stands among the top + 1 smallest ids of
    one of the tags: the others of the ids before it are the entry itself and partners that rank before it.
    """
    sets = tag_sets(tags)
    largest = sets.agg(F.max("n")).first()[0] or 0
    levels, least = [2], 8
    while least <= largest:
        levels.insert(0, least)
        least *= 4
    open_, done = sets, None
    for k, least in enumerate(levels):
        if k == 0:
            half = overlap_pairs(open_, sets, least, once=True, block=block)
            both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
            found = kept(half.select(both.alias("p"), "shared").select("p.a", "p.b", "shared"), "related")
        else:
            found = kept(overlap_pairs(open_, sets, least, block=block), "related")
        settled = found.groupBy("a").agg(F.count("*").alias("c")).filter(F.col("c") >= top).select("a")
        now = found.join(settled, "a", "left_semi") if k + 1 < len(levels) else found
        done = now if done is None else done.unionByName(now)
        open_ = open_.join(settled, open_["id"] == settled["a"], "left_anti")
        if k + 1 < len(levels):
            open_ = kept(open_, "open-sets")
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
    best = done.withColumn("r", best).filter(F.col("r") <= top).groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("s"), "b"))).alias("best"))
    first = F.row_number().over(Window.partitionBy("tag").orderBy("id"))
    heads = sets.select("id", F.explode("tags").alias("tag")).withColumn("r", first).filter(F.col("r") <= top + 1).groupBy("tag").agg(F.collect_list("id").alias("heads"))
    ones = open_.select(F.col("id").alias("a"), F.explode("tags").alias("tag")).join(heads, "tag").groupBy("a").agg(F.flatten(F.collect_list("heads")).alias("heads"))
    both = ones.join(best, "a", "full_outer").select("a", F.coalesce("best", F.array().cast(best.schema["best"].dataType)).alias("best"), F.coalesce("heads", F.array().cast(ones.schema["heads"].dataType)).alias("heads"))
    rest = F.array_sort(F.array_except("heads", F.concat(F.array("a"), F.col("best.b"))))
    partners = F.concat("best", F.transform(rest, lambda x: F.struct(F.lit(-1).cast("long").alias("s"), x.alias("b"))))
    return both.select("a", F.posexplode(F.slice(partners, 1, top)).alias("rank", "p")).select("a", F.col("p.b").alias("b"), (-F.col("p.s")).alias("shared"), (F.col("rank") + 1).alias("rank"))
