"""Failure injection for all edges at once: which pairs of nodes lose their shortest paths with an edge, and how far round they then have to go.

Edges of a shortest path stand at levels, one at each, and every edge between shortest-path nodes of two levels is on one of them; so a pair depends on
an edge if that is the only one of its level. Only these edges are taken out, and of the distances from a start only those are found anew that hang on
the edge: a search touches the nodes behind the edge, not the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import balls, turned
from tessera.plans import Catalog
from tessera.plans.bind import GRAPH, edges, nodes
from tessera.plans.loop import kept

catalog = Catalog()

CASE = ["start", "u", "v"]


def _levels(e: DataFrame, dist: DataFrame) -> DataFrame:
    """(start, src, dst, level): all edges that lie on shortest paths from a start, with the distance of dst."""
    tail = dist.select("start", F.col("node").alias("src"), (F.col("distance") + 1).alias("level"))
    return tail.join(e, ["start", "src"]).join(dist.select("start", F.col("node").alias("dst"), F.col("distance").alias("level")), ["start", "dst", "level"])


def sole_edges(levels: DataFrame, dist: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """(start, target, hops, u, v): edges that are on every shortest path of a pair (start, target)."""
    ends = kept(pairs.join(dist.select("start", F.col("node").alias("target"), F.col("distance").alias("hops")).filter("hops > 0"), ["start", "target"]), "pairs")
    front, sole = None, None
    for level in range(hops, 0, -1):
        here = ends.filter(F.col("hops") == level).select("start", "target", "hops", F.col("target").alias("node"))
        front = here if front is None else here.unionByName(front)
        on = levels.filter(F.col("level") == level).select("start", F.col("dst").alias("node"), "src")
        steps = kept(front.join(on, ["start", "node"]), "steps-back")
        one = steps.groupBy("start", "target", "hops").agg(F.count("*").alias("n"), F.min("src").alias("u"), F.min("node").alias("v")).filter("n = 1").drop("n")
        sole = one if sole is None else sole.unionByName(one)
        front = steps.select("start", "target", "hops", F.col("src").alias("node")).distinct()
    return kept(sole, "sole-edges")


def hanging(levels: DataFrame, cases: DataFrame, hops: int) -> DataFrame:
    """(start, u, v, node): nodes that lose all shortest paths from start with the edge u -> v of a case: v, if that is its only one, and whoever has all shortest-path edges from such nodes."""
    into = kept(levels.groupBy("start", F.col("dst").alias("node")).agg(F.count("*").alias("into")), "edges-into")
    front = kept(cases.select(*CASE, F.col("v").alias("node")).join(into.filter("into = 1").select("start", "node"), ["start", "node"]), "hanging")
    found = front
    for _ in range(1, hops):
        next_ = front.join(levels.select("start", F.col("src").alias("node"), F.col("dst").alias("to")), ["start", "node"])
        next_ = next_.groupBy(*CASE, F.col("to").alias("node")).agg(F.count("*").alias("n")).join(into, ["start", "node"]).filter(F.col("n") == F.col("into"))
        front = kept(next_.select(*CASE, "node"), "hanging")
        found = found.unionByName(front)
    return found.select(*CASE, "node")


def between(e: DataFrame, pairs: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """((start, target, node, ahead, back), (start, target, src, dst)): for each pair the nodes and edges on its walks of at most `hops` edges, with the nodes' distances from start and to target.

    Searches from both ends meet half-way; from where they meet, the walks are followed back to start and on to target.
    """
    half, rest, key = hops - hops // 2, hops // 2, ["start", "target"]
    ahead = balls(e, pairs.select(F.col("start").alias("id")).distinct(), half).select("start", "node", F.col("distance").alias("ahead"))
    back = balls(turned(e), pairs.select(F.col("target").alias("id")).distinct(), rest).select(F.col("start").alias("target"), "node", F.col("distance").alias("back"))
    found = kept(pairs.join(back, "target").join(ahead, ["start", "node"]).filter(F.col("ahead") + F.col("back") <= hops).select(*key, "node", "ahead", "back"), "between")
    for k in range(rest + 1, hops + 1):
        # Farther than `rest` from the target, but near the start.
        step = found.filter(F.col("back") == k - 1).select(*key, F.col("node").alias("dst")).join(e, "dst").select(*key, F.col("src").alias("node")).distinct()
        new = step.join(found, [*key, "node"], "left_anti").join(ahead, ["start", "node"]).filter(F.col("ahead") + k <= hops)
        found = found.unionByName(kept(new.select(*key, "node", "ahead", F.lit(k).alias("back")), "between"))
    for k in range(half + 1, hops + 1):
        step = found.filter(F.col("ahead") == k - 1).select(*key, F.col("node").alias("src")).join(e, "src").select(*key, F.col("dst").alias("node")).distinct()
        new = step.join(found, [*key, "node"], "left_anti").join(back, ["target", "node"]).filter(F.col("back") + k <= hops)
        found = found.unionByName(kept(new.select(*key, "node", F.lit(k).alias("ahead"), "back"), "between"))
    tails, heads = found.select(*key, F.col("node").alias("src"), "ahead"), found.select(*key, F.col("node").alias("dst"), "back")
    return found, tails.join(e, "src").join(heads, [*key, "dst"]).filter(F.col("ahead") + F.col("back") < hops).select(*key, "src", "dst")


def detours(e: DataFrame, pairs: DataFrame, hops: int = 4) -> DataFrame:
    """(start, target, hops, u, v, after): for each pair (start, target) and each edge on all of its shortest paths, the hops without that edge; null beyond `hops`.

    e: (src, dst), repeated edges count once, loops and nulls not at all. Pairs beyond `hops`, of equal nodes or with a null have no rows.
    """
    e = kept(e.select("src", "dst").filter("src <> dst").distinct(), "edges")
    pairs = pairs.select("start", "target").filter("start <> target").distinct()
    # Each pair has a graph of its own, of the edges that its paths may take, so it goes as a start of its own.
    found, own = between(e, pairs, hops)
    key = F.struct("start", "target").alias("start")
    dist = kept(found.select(key, "node", F.col("ahead").alias("distance")), "distances")
    e = kept(own.select(key, "src", "dst"), "pair-edges")
    pairs = pairs.select(key, "target")
    levels = kept(_levels(e, dist), "levels")
    sole = sole_edges(levels, dist, pairs, hops)
    lost = kept(hanging(levels, sole.select(*CASE).distinct(), hops), "hanging-nodes")
    # All other edges into the hanging nodes: from nodes that keep their distance, and from other hanging nodes.
    other = kept(lost.join(e.withColumnRenamed("dst", "node"), ["start", "node"]).filter(~((F.col("src") == F.col("u")) & (F.col("node") == F.col("v")))), "other-edges")
    tails = lost.select(*CASE, F.col("node").alias("src"))
    firm = other.join(tails, [*CASE, "src"], "left_anti").join(dist.select("start", F.col("node").alias("src"), "distance"), ["start", "src"])
    after = kept(firm.groupBy(*CASE, "node").agg((F.min("distance") + 1).alias("after")).filter(F.col("after") <= hops), "detours")
    inner = kept(other.join(tails, [*CASE, "src"], "left_semi"), "inner-edges")
    for _ in range(1, hops):
        via = inner.join(after.withColumnRenamed("node", "src"), [*CASE, "src"]).select(*CASE, "node", (F.col("after") + 1).alias("after")).filter(F.col("after") <= hops)
        after = kept(after.unionByName(via).groupBy(*CASE, "node").agg(F.min("after").alias("after")), "detours")
    return sole.join(after.withColumnRenamed("node", "target"), [*CASE, "target"], "left").select("start.start", "target", "hops", "u", "v", "after")


def failure_injection(e: DataFrame, pairs: DataFrame, hops: int = 4) -> DataFrame:
    """(src, dst, broken, longer, criticality): for every edge, how many of the pairs (start, target) have no path of at most `hops` without it, how many have a longer one, and the
    share of all asked pairs in percent, where a longer path counts half."""
    asked = pairs.select("start", "target").distinct().agg(F.count("*").alias("asked"))  # one row
    hit = detours(e, pairs, hops).groupBy(F.col("u").alias("src"), F.col("v").alias("dst")).agg(F.count_if(F.col("after").isNull()).alias("broken"), F.count_if(F.col("after").isNotNull()).alias("longer"))
    every = e.select("src", "dst").filter("src <> dst").distinct().join(hit, ["src", "dst"], "left").na.fill(0, ["broken", "longer"])
    return every.join(F.broadcast(asked)).select("src", "dst", "broken", "longer", F.round(100 * (F.col("broken") + 0.5 * F.col("longer")) / F.col("asked"), 4).alias("criticality"))


def direct_detours(e: DataFrame, sources: DataFrame, hops: int = 4) -> DataFrame:
    """(src, dst, after): for each edge out of the sources (id), the hops from its one end to the other without it; null beyond `hops`."""
    own = e.select("src", "dst").join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("target"))
    found = detours(e, own, hops).filter("u = start AND v = target")
    return found.select(F.col("start").alias("src"), F.col("target").alias("dst"), "after")


def _asked(s, d) -> DataFrame:
    """From every node whose id is divisible by 100, to two others."""
    return nodes(s, d).filter("id % 100 = 0").select(F.col("id").alias("start"), F.explode(F.array(F.col("id") + 7, F.col("id") + 30)).alias("target"))


_WALKS = """p AS (SELECT id AS s, unnest([id + 7, id + 30]) AS t FROM nodes WHERE id % 100 = 0),
w1 AS (SELECT src AS s, dst AS t, [src || '-' || dst] AS es FROM edges WHERE src % 100 = 0), w2 AS (SELECT s, dst AS t, list_append(es, src || '-' || dst) AS es FROM w1 JOIN edges ON t = src),
w3 AS (SELECT s, dst AS t, list_append(es, src || '-' || dst) AS es FROM w2 JOIN edges ON t = src), w AS (FROM w1 UNION ALL FROM w2 UNION ALL FROM w3)"""
catalog.add("graph_failure_injection", f"""WITH {GRAPH}, {_WALKS}, x AS (SELECT s, t, es, len(es) AS n, min(len(es)) OVER (PARTITION BY s, t) AS hops FROM w JOIN p USING (s, t)),
c AS (SELECT DISTINCT s, t, hops, unnest(es) AS edge FROM x WHERE n = hops), a AS (SELECT s, t, hops, edge, min(n) FILTER (NOT list_contains(es, edge)) AS after FROM c JOIN x USING (s, t, hops) GROUP BY ALL),
h AS (SELECT edge, count(*) FILTER (after IS NULL) AS broken, count(*) FILTER (after > hops) AS longer FROM a GROUP BY edge)
SELECT src, dst, coalesce(broken, 0) AS broken, coalesce(longer, 0) AS longer, round(100 * (coalesce(broken, 0) + 0.5 * coalesce(longer, 0)) / (SELECT count(*) FROM p), 4) AS criticality FROM edges LEFT JOIN h ON edge = src || '-' || dst""")(
    lambda s, d: failure_injection(edges(s, d), _asked(s, d), 3)
)
catalog.add("graph_direct_detours", f"""WITH {GRAPH}, o AS (SELECT src, dst FROM edges WHERE src % 100 = 0), two AS (SELECT DISTINCT o.src, y.dst FROM o JOIN edges y ON o.dst = y.src),
three AS (SELECT DISTINCT x.src AS u, z.dst AS v FROM o x JOIN edges y ON x.dst = y.src JOIN edges z ON y.dst = z.src JOIN o ON o.src = x.src AND o.dst = z.dst WHERE x.dst <> z.dst AND y.dst <> x.src)
SELECT o.src, o.dst, CASE WHEN two.src IS NOT NULL THEN 2 WHEN u IS NOT NULL THEN 3 END AS after FROM o LEFT JOIN two ON o.src = two.src AND o.dst = two.dst LEFT JOIN three ON o.src = u AND o.dst = v""")(
    lambda s, d: direct_detours(edges(s, d), nodes(s, d).filter("id % 100 = 0"), 3)
)
