"""Graph operators as loops of DataFrame joins over edges (src, dst, weight, strength) and nodes (id, domain, tags)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.costs import cheapest
from tessera.operators.lots import coded, components, dealt, lots, rest
from tessera.operators.overlap import BLOCK, shared_tag_pairs
from tessera.operators.quality import with_domains
from tessera.operators.ranks import counted_values, with_summary
from tessera.plans import Catalog, table
from tessera.plans.bind import GRAPH, edges, nodes
from tessera.plans.loop import kept, settled

catalog = Catalog()

#: Bits of nodes times starts, and of edges times starts at a time, of a task that holds a component.
BITS = 1 << 27
#: Tours of a plan that a task makes at once.
TOURS = 512


def reach(e: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance, weight, via): nodes within depth hops of each start, with the heaviest last edge at the least distance, the smallest parent of equals."""
    e = kept(e.select("src", "dst", "weight"), "reach-edges")
    seen = front = kept(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("int").alias("weight"), F.lit(None).cast(e.schema["src"].dataType).alias("via")))
    for k in range(1, depth + 1):
        best = front.select("start", F.col("node").alias("src")).join(e, "src").groupBy("start", F.col("dst").alias("node")).agg(F.max(F.struct("weight", (-F.col("src")).alias("p"))).alias("b"))
        new = best.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(k).alias("distance"), F.col("b.weight").alias("weight"), (-F.col("b.p")).alias("via"))
        front = kept(new)
        seen = seen.unionByName(front)
    return seen


def balls(e: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, distance): nodes within depth hops (or any number) of each start (id) over edges (src, dst); each layer is written once."""
    e = kept(e.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "ball-edges")
    seen = front = kept(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance")).distinct(), "ball")
    for k in count(1) if depth is None else range(1, depth + 1):
        new = front.select("start", F.col("node").alias("src")).join(e, "src").select("start", F.col("dst").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = kept(new.withColumn("distance", F.lit(k)), "ball")
        if depth is None and not front.head(1):
            break
        seen = seen.unionByName(front)
    return seen


def turned(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _starts(s, d, n: int = 1) -> DataFrame:
    return nodes(s, d).filter(F.col("id") < n).select("id")


_REACH2 = "r1 AS (SELECT dst AS node, arg_max(src, (weight, -src)) AS via, max(weight) AS weight FROM e WHERE src = 0 AND dst <> 0 GROUP BY dst), r2 AS (SELECT dst AS node, arg_max(src, (weight, -src)) AS via, max(weight) AS weight FROM e WHERE src IN (SELECT node FROM r1) AND dst <> 0 AND dst NOT IN (SELECT node FROM r1) GROUP BY dst)"
_REACH3 = f"{_REACH2}, r3 AS (SELECT dst AS node, arg_max(src, (weight, -src)) AS via, max(weight) AS weight FROM e WHERE src IN (SELECT node FROM r2) AND dst <> 0 AND dst NOT IN (SELECT node FROM r1) AND dst NOT IN (SELECT node FROM r2) GROUP BY dst)"
catalog.add("graph_neighbours", f"WITH {GRAPH}, e AS (SELECT * FROM edges WHERE weight >= 3), {_REACH2} SELECT node, 1 AS distance, weight, via FROM r1 UNION ALL SELECT node, 2, weight, via FROM r2")(
    lambda s, d: reach(edges(s, d).filter("weight >= 3"), _starts(s, d), 2).filter("distance > 0").select("node", "distance", "weight", "via")
)
catalog.add("graph_impact", f"WITH {GRAPH}, e AS (SELECT dst AS src, src AS dst, weight FROM edges), {_REACH3}, r AS (SELECT node, 1 AS distance, weight FROM r1 UNION ALL SELECT node, 2, weight FROM r2 UNION ALL SELECT node, 3, weight FROM r3) SELECT domain, distance, count(*) AS n, count(*) FILTER (distance = 1 AND weight >= 7) AS critical FROM r JOIN nodes ON node = id GROUP BY 1, 2")(
    lambda s, d: reach(edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), _starts(s, d), 3).filter("distance > 0").join(nodes(s, d), F.col("node") == F.col("id")).groupBy("domain", "distance").agg(F.count("*").alias("n"), F.count_if((F.col("distance") == 1) & (F.col("weight") >= 7)).alias("critical"))
)


def fewest_hops(e: DataFrame, pairs: DataFrame, most: int = 8) -> DataFrame:
    """(src, dst, hops): least number of hops for each asked pair (src, dst); null beyond `most`.

    Searches from both ends meet half-way: the node in the middle of a shortest path is within half of `most` of either end.
    """
    e = kept(e.select("src", "dst"), "hop-edges")
    ahead = balls(e, pairs.select(F.col("src").alias("id")).filter("id IS NOT NULL").distinct(), most - most // 2)
    behind = balls(turned(e), pairs.select(F.col("dst").alias("id")).filter("id IS NOT NULL").distinct(), most // 2)
    met = pairs.select("src", "dst").distinct().join(ahead.select(F.col("start").alias("src"), "node", F.col("distance").alias("a")), "src").join(behind.select(F.col("start").alias("dst"), "node", F.col("distance").alias("b")), ["dst", "node"])
    return pairs.join(met.groupBy("src", "dst").agg(F.min(F.col("a") + F.col("b")).alias("hops")), ["src", "dst"], "left")


def _asked(s, d, factor: int, plus: int) -> DataFrame:
    """The searches: from every node whose id is divisible by 100, to another one each."""
    return nodes(s, d).filter("id % 100 = 0").select(F.col("id").alias("src"), (F.col("id") * factor + plus).alias("dst"))


_HOPS = """r AS (SELECT id AS start, id AS node, 0 AS h FROM nodes WHERE id % 100 = 0 UNION SELECT start, dst, h + 1 FROM r JOIN edges ON src = node WHERE h < {most}),
m AS (SELECT start, node, min(h) AS hops FROM r GROUP BY 1, 2), p AS (SELECT id AS src, id * {factor} + {plus} AS dst FROM nodes WHERE id % 100 = 0)"""
catalog.add("graph_fewest_hops", f"WITH RECURSIVE {GRAPH}, {_HOPS.format(most=4, factor=7, plus=1)} SELECT src, dst, hops FROM p LEFT JOIN m ON start = src AND node = dst")(lambda s, d: fewest_hops(edges(s, d), _asked(s, d, 7, 1), 4))


def _heaviest(e: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops, weight): the fewest hops to each node within depth, and the most weight (w) of a path of so many.

    Level by level: a node first reached at level k is reached from nodes of level k - 1 alone by paths of the fewest hops.
    """
    seen = front = kept(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops"), F.lit(0).cast("long").alias("weight")).distinct(), "stops")
    for k in range(1, depth + 1):
        new = front.join(e, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.max(F.col("weight") + F.col("w")).alias("weight"))
        front = kept(new.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(k).alias("hops"), "weight"), "stops")
        seen = seen.unionByName(front)
    return seen


def stop_paths(e: DataFrame, starts: DataFrame, stops: DataFrame, most: int = 8) -> DataFrame:
    """(src, dst, hops, weight): from each start to each other stop the fewest hops, and the most weight that a path of so many has; none beyond `most`.

    Both ends search half of `most`: a stop farther than that has its shortest paths through nodes at just so many hops from the start.
    """
    e = kept(e.select("src", "dst", F.col("weight").cast("long").alias("w")).filter("src IS NOT NULL AND dst IS NOT NULL"), "stop-edges")
    half = most - most // 2
    ahead = _heaviest(e, starts, half)
    behind = _heaviest(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), stops, most // 2)
    near = ahead.join(stops.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select(F.col("start").alias("src"), F.col("node").alias("dst"), "hops", "weight")
    back = behind.filter("hops > 0").select(F.col("start").alias("dst"), "node", F.col("hops").alias("h"), F.col("weight").alias("w"))
    far = ahead.filter(F.col("hops") == half).join(back, "node").select(F.col("start").alias("src"), "dst", (F.col("hops") + F.col("h")).alias("hops"), (F.col("weight") + F.col("w")).alias("weight"))
    best = near.unionByName(far).filter("src <> dst").groupBy("src", "dst").agg(F.max(F.struct((-F.col("hops")).alias("h"), "weight")).alias("b"))
    return best.select("src", "dst", (-F.col("b.h")).alias("hops"), F.col("b.weight").alias("weight"))


_STOPS = "id % 100 = 0"
catalog.add("graph_stop_paths", f"WITH RECURSIVE {GRAPH}, r AS (SELECT id AS start, id AS node, 0 AS hops, 0::BIGINT AS weight FROM nodes WHERE {_STOPS} UNION ALL SELECT start, dst, hops + 1, max(r.weight + edges.weight)::BIGINT FROM r JOIN edges ON src = node WHERE hops < 4 GROUP BY start, dst, hops) SELECT start AS src, node AS dst, hops, weight FROM r WHERE node % 100 = 0 AND start <> node QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY hops) = 1")(
    lambda s, d: stop_paths(edges(s, d), nodes(s, d).filter(_STOPS).select("id"), nodes(s, d).filter(_STOPS).select("id"), 4)
)


def best_paths(e: DataFrame, start, target, score: Column, hops: int = 3, beam: int = 2_000) -> DataFrame:
    """(path, score, hops): simple paths from start to target with the largest sum of score per number of hops.

    Paths grow only to nodes from which target is as many hops away as are left or fewer, and the last edge comes from the in-edges of target,
    so up to two hops nothing is cut. Beyond, a round of more than `beam` paths fails.
    """
    e = e.select("src", "dst", score.cast("double").alias("s"))
    paths = e.sparkSession.range(1).select(F.array(F.lit(start).cast("long")).alias("path"), F.lit(0.0).alias("score"))
    last, e = e.filter(F.col("dst") == target), e.filter(F.col("dst") != target)
    # near[r]: nodes with a walk of 1 to r edges to target
    near = [None, last.select("src").distinct()]
    for _ in range(2, hops):
        near.append(near[-1].union(e.join(near[-1].select(F.col("src").alias("dst")), "dst", "left_semi").select("src")).distinct())
    found = None

    def grown(paths: DataFrame, e: DataFrame) -> DataFrame:
        longer = paths.join(e, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        return longer.select(F.concat("path", F.array("dst")).alias("path"), (F.col("score") + F.col("s")).alias("score"))

    for k in range(1, hops + 1):
        ended = grown(paths, last).withColumn("hops", F.lit(k))
        found = ended if found is None else found.unionByName(ended)
        if k < hops:
            paths = grown(paths, e.join(near[hops - k].select(F.col("src").alias("dst")), "dst", "left_semi"))
        if k + 1 < hops:
            paths = kept(paths)
            if k > 1 and paths.count() > beam:
                raise RuntimeError(f"more than {beam} paths of {k} hops")
    w = Window.partitionBy("hops").orderBy(F.desc("score"), "path")
    return found.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("path", F.round("score", 6).alias("score"), "hops")


_P2 = "SELECT [a.src, a.dst, b.dst] AS path, {s} AS score, 2 AS hops FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 0 AND b.dst = 5 AND a.dst NOT IN (0, 5)"
_P1 = "SELECT [src, dst] AS path, {s} AS score, 1 AS hops FROM edges WHERE src = 0 AND dst = 5"
for _name, _score, _one, _two in (
    ("graph_best_path_weight", lambda: F.col("weight"), "weight", "a.weight + b.weight"),
    ("graph_best_path_strength", lambda: F.when(F.col("strength") == "strong", 3).when(F.col("strength") == "medium", 2).otherwise(1), "CASE strength WHEN 'strong' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END", "CASE a.strength WHEN 'strong' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + CASE b.strength WHEN 'strong' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"),
):
    catalog.add(_name, f"WITH {GRAPH}, p AS ({_P1.format(s=_one)} UNION ALL {_P2.format(s=_two)}) SELECT path, score::DOUBLE AS score, hops FROM p QUALIFY row_number() OVER (PARTITION BY hops ORDER BY score DESC, path) = 1")(
        lambda s, d, x=_score: best_paths(edges(s, d), 0, 5, x(), 2)
    )


_TIER = "CASE strength WHEN 'strong' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_WALKS = "r AS (SELECT id AS start, id AS node, 0 AS h, {zero} AS c FROM nodes WHERE id % 500 = 0 UNION ALL SELECT start, dst, h + 1, min({plus}) FROM r JOIN edges ON src = node WHERE h < 12 GROUP BY start, dst, h)"
catalog.add("graph_cheapest_reliable", f"WITH RECURSIVE {GRAPH}, {_WALKS.format(zero='0::DOUBLE', plus='c + 1 / greatest(weight, 0.1)')} SELECT start, node, round(min(c), 6) AS cost FROM r GROUP BY 1, 2")(
    lambda s, d: cheapest(edges(s, d), nodes(s, d).filter("id % 500 = 0"), [1 / F.greatest("weight", F.lit(0.1))]).select("start", "node", F.round("cost.c0", 6).alias("cost"))
)
catalog.add("graph_cheapest_strength", f"WITH RECURSIVE {GRAPH}, {_WALKS.format(zero='[0, 0]', plus=f'[c[1] + {_TIER}, c[2] + 10 - weight]')} SELECT start, node, min(c)[1]::DOUBLE AS tiers, min(c)[2]::DOUBLE AS slack FROM r GROUP BY 1, 2")(
    lambda s, d: cheapest(edges(s, d), nodes(s, d).filter("id % 500 = 0"), [F.when(F.col("strength") == "strong", 1).when(F.col("strength") == "medium", 2).otherwise(3), 10 - F.col("weight")]).select("start", "node", F.col("cost.c0").alias("tiers"), F.col("cost.c1").alias("slack"))
)


def nearest_goals(e: DataFrame, goals: DataFrame) -> DataFrame:
    """(start, distance, node): for each node that reaches a goal (id) the fewest hops to one, and the smallest such goal; one search from all goals against the edges."""
    back = kept(e.select("src", "dst").distinct())
    seen = kept(goals.select(F.col("id").alias("start"), F.lit(0).alias("distance"), F.col("id").alias("node")))
    k = 0
    while True:
        front = seen.filter(F.col("distance") == k).select(F.col("start").alias("dst"), "node")
        new = back.join(front, "dst").groupBy(F.col("src").alias("start")).agg(F.min("node").alias("node")).join(seen.select("start"), "start", "left_anti").withColumn("distance", F.lit(k + 1))
        new = kept(new.select(*seen.columns))
        if new.limit(1).count() == 0:
            return seen
        seen, k = kept(seen.unionByName(new)), k + 1


_GOALS = "r AS (SELECT id AS start, id AS node, 0 AS h FROM nodes WHERE domain = '{}' UNION SELECT src, min(node), h + 1 FROM r JOIN edges ON dst = start WHERE h < 8 GROUP BY src, h)"


def hybrid_steps(e: DataFrame, n: DataFrame, target, weights: tuple[float, float, float] = (1.0, 2.0, 1.0)) -> DataFrame:
    """(src, dst, score): weight, strength bonus and tag similarity of dst to the target; of tags, both empty score 5 and one empty 2."""
    goal = n.filter(F.col("id") == target).select(F.col("tags").alias("goal"))
    tags = n.select(F.col("id").alias("dst"), "tags")
    both_empty, one_empty = (F.size("tags") == 0) & (F.size("goal") == 0), (F.size("tags") == 0) | (F.size("goal") == 0)
    near = F.when(both_empty, 5.0).when(one_empty, 2.0).otherwise(10 * t.jaccard(F.col("tags"), F.col("goal")))
    bonus = F.when(F.col("strength") == "strong", 3).when(F.col("strength") == "medium", 1.5).otherwise(0)
    a, b, c = weights
    return e.join(tags, "dst").join(F.broadcast(goal)).select("src", "dst", F.round(a * F.col("weight") + b * bonus + c * near, 6).alias("score"))


_GOAL = "(SELECT tags FROM nodes WHERE id = 5)"
catalog.add("graph_hybrid_scores", f"WITH {GRAPH} SELECT src, dst, round(weight + 2.0 * CASE strength WHEN 'strong' THEN 3 WHEN 'medium' THEN 1.5 ELSE 0 END + 10 * len(list_intersect(tags, {_GOAL})) / len(list_distinct(list_concat(tags, {_GOAL}))), 6)::DOUBLE AS score FROM edges JOIN nodes ON dst = id")(lambda s, d: hybrid_steps(edges(s, d), nodes(s, d), 5))
_MET = "(SELECT min(b.dst) FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = (SELECT min(src) FROM edges) AND b.dst <> a.src)"
_JACC = "len(list_intersect(x.tags, y.tags)) / len(list_distinct(list_concat(x.tags, y.tags)))"
catalog.add("graph_tag_coherent_path", f"""WITH {GRAPH}, w AS (SELECT src, dst, {_JACC} AS s FROM edges JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id), f AS (SELECT min(src) AS a, {_MET} AS b FROM edges),
p AS (SELECT [src, dst] AS path, s AS score, 1 AS hops FROM w, f WHERE src = f.a AND dst = f.b UNION ALL SELECT [p.src, p.dst, q.dst], p.s + q.s, 2 FROM w p JOIN w q ON p.dst = q.src, f WHERE p.src = f.a AND q.dst = f.b AND p.dst NOT IN (f.a, f.b))
SELECT path, round(score, 6)::DOUBLE AS score, hops FROM p QUALIFY row_number() OVER (PARTITION BY hops ORDER BY score DESC, path) = 1""")(lambda s, d: _coherent(s, d))


def _coherent(s, d) -> DataFrame:
    """From the smallest source to the smallest node two hops away, which there always is a path to."""
    e = edges(s, d)
    first = e.agg(F.min("src")).first()[0]
    far = e.filter(F.col("src") == first).alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).filter(F.col("b.dst") != first).agg(F.min("b.dst")).first()[0]
    return best_paths(with_domains(e, nodes(s, d)), first, far, t.jaccard(F.col("src_tags"), F.col("dst_tags")), 2)
catalog.add("graph_nearest_goal", f"WITH RECURSIVE {GRAPH}, {_GOALS.format('Brand#7')} SELECT start, min(h) AS distance, arg_min(node, (h, node)) AS node FROM r GROUP BY start")(
    lambda s, d: nearest_goals(edges(s, d), nodes(s, d).filter("domain = 'Brand#7'"))
)


def suggested_edges(e: DataFrame, n: DataFrame, tag_weight: float = 2.0, bridge: float = 1.5) -> DataFrame:
    """(src, dst, score): two-hop neighbours without an edge, by their best via's mean weight, common tags and a bonus for another domain."""
    two = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).filter(F.col("a.src") != F.col("b.dst")).groupBy(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).agg(F.max((F.col("a.weight") + F.col("b.weight")) / 2).alias("via"))
    two = two.join(e.select("src", "dst"), ["src", "dst"], "left_anti")
    x = with_domains(two, n)
    score = F.col("via") + tag_weight * F.size(F.array_intersect("src_tags", "dst_tags")) + F.when(F.col("src_domain") != F.col("dst_domain"), bridge).otherwise(0.0)
    return x.select("src", "dst", score.alias("score"))


catalog.add("graph_suggested_edges", f"WITH {GRAPH}, h AS (SELECT * FROM edges WHERE weight >= 8), p AS (SELECT a.src, b.dst, max((a.weight + b.weight) / 2) AS via FROM h a JOIN h b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2), q AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.src = p.src AND h.dst = p.dst)) SELECT src, dst, (via + 2.0 * len(list_intersect(a.tags, b.tags)) + CASE WHEN a.domain <> b.domain THEN 1.5 ELSE 0 END)::DOUBLE AS score FROM q JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id")(lambda s, d: suggested_edges(edges(s, d).filter("weight >= 8"), nodes(s, d)))
catalog.add("graph_shared_neighbours", f"WITH {GRAPH} SELECT a.dst AS node, a.weight + b.weight AS weight FROM edges a JOIN edges b ON a.dst = b.dst WHERE a.src = 0 AND b.src = 1")(
    lambda s, d: edges(s, d).filter("src = 0").alias("a").join(edges(s, d).filter("src = 1").alias("b"), F.col("a.dst") == F.col("b.dst")).select(F.col("a.dst").alias("node"), (F.col("a.weight") + F.col("b.weight")).alias("weight"))
)


def shared_pairs(e: DataFrame, n: DataFrame, least: int = 2, block: int = BLOCK) -> DataFrame:
    """(domain, a, b, shared): pairs of nodes of one domain with at least `least` common out-neighbours."""
    tags = e.join(n.select(F.col("id").alias("src"), "domain"), "src").select(F.struct("domain", F.col("src").alias("id")).alias("entry_id"), F.struct("domain", F.col("dst").alias("id")).alias("tag"))
    return shared_tag_pairs(tags, least, block).select("a.domain", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "shared")


catalog.add("graph_most_shared_pairs", f"WITH {GRAPH}, x AS (SELECT src, dst, domain FROM edges JOIN nodes ON src = id) SELECT a.domain, a.src AS a, b.src AS b, count(*) AS shared FROM x a JOIN x b ON a.dst = b.dst AND a.domain = b.domain AND a.src < b.src GROUP BY 1, 2, 3 HAVING count(*) >= 2")(lambda s, d: shared_pairs(edges(s, d), nodes(s, d)))


catalog.add("graph_components")(lambda s, d: components(edges(s, d), nodes(s, d)).groupBy("component").agg(F.count("*").alias("size")))


def _layers(edges: pa.Table, starts: pa.Table) -> pa.Table:
    """Of a lot's edges (lot, block, src, dst; both ways) and the starts (lot, block, id) of a block: start, eccentricity, reached, total. A node's row of bits says which starts reach it."""
    ids, (src, dst, at) = coded(edges.column("src"), edges.column("dst"), starts.column("id"))
    n, width = len(ids), (len(at) + 63) // 64
    seen = np.zeros((n, width * 64), np.uint8)
    seen[at, np.arange(len(at))] = 1
    front = seen = np.packbits(seen, axis=1, bitorder="little").view(np.uint64)
    full = np.bitwise_or.reduce(seen, axis=0)
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    begins = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.empty(0, np.int64)
    sizes, heads = np.diff(begins, append=len(dst)), dst[begins]
    reached, total, farthest = np.ones(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
    most, k = max(1, BITS // 64 // width), 0
    while front.any():
        k += 1
        # Nodes that not all starts have reached, with those of their edges that bring something.
        open_ = np.repeat((seen != full).any(axis=1)[heads], sizes)
        some = np.flatnonzero(open_ & front.any(axis=1)[src])
        new = np.zeros_like(seen)
        for low in range(0, len(some), most):
            e = some[low : low + most]
            to = dst[e]
            own = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            new[to[own]] |= np.bitwise_or.reduceat(front[src[e]], own, axis=0)
        front = new & ~seen
        seen = seen | front
        for low in range(0, n, 4096):
            found = np.unpackbits(front[low : low + 4096].view(np.uint8), axis=1, bitorder="little")[:, : len(at)].sum(axis=0, dtype=np.int64)
            reached, total = reached + found, total + k * found
            farthest[found > 0] = k
    return pa.Table.from_arrays([ids.take(pa.array(at)), pa.array(farthest), pa.array(reached), pa.array(total)], ["start", "eccentricity", "reached", "total"])


def eccentricities(e: DataFrame, n: DataFrame) -> DataFrame:
    """(start, eccentricity, reached, mean): of all nodes, over undirected edges: the most hops to a node that it reaches, how many these are with itself, and their mean hops.

    Components that a task can hold are searched there from 4,096 starts at a time; larger ones by layers of pairs, which grow with the square of the nodes.
    """
    e = e.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    both = kept(e.unionByName(turned(e)).distinct().repartitionByRange("src"), "edges")
    starts = kept(n.select(F.col("id").cast(both.schema["src"].dataType).alias("id")).dropna().distinct(), "starts")
    of = lots(both, starts)
    inner, at = dealt(both, starts, of, BITS, 4_096)
    found = inner.groupBy("lot", "block").cogroup(at.groupBy("lot", "block")).applyInArrow(_layers, f"start {both.schema['src'].dataType.simpleString()}, eccentricity int, reached long, total long")
    beyond = rest(both, starts, of)
    if beyond is not None:
        pairs = balls(*beyond).groupBy("start").agg(F.max("distance").alias("eccentricity"), F.count("*").alias("reached"), F.sum("distance").alias("total"))
        found = found.unionByName(pairs)
    return found.select("start", "eccentricity", "reached", F.round(F.col("total") / F.col("reached"), 6).alias("mean"))


catalog.add("graph_diameter")(lambda s, d: eccentricities(edges(s, d), nodes(s, d)))


def bridges(e: DataFrame, n: DataFrame, depth: int = 60) -> DataFrame:
    """(a, b): undirected edges whose removal disconnects their ends, by cycle-space labels.

    Each edge outside a breadth-first forest gets a random 64-bit label; a tree
    edge's label is the XOR of the labels at the nodes below it, summed level by level. A tree edge of
    label 0 is a bridge (wrongly so with probability 2^-64).
    """
    und = kept(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct())
    both = und.unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b")))
    comp = components(und.select(F.col("a").alias("src"), F.col("b").alias("dst")), n)
    tree = kept(comp.filter("id = component").select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level")))
    level = 0
    while True:
        front = tree.filter(F.col("level") == level).select(F.col("node").alias("a"))
        new = both.join(front, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")).join(tree.select("node"), "node", "left_anti").withColumn("level", F.lit(level + 1))
        grown = kept(tree.unionByName(new.select("node", "parent", "level")))
        if grown.filter(F.col("level") == level + 1).limit(1).count() == 0:
            break
        tree, level = grown, level + 1
        if level > depth:
            raise RuntimeError(f"the forest is deeper than {depth}")
    in_tree = tree.filter("parent IS NOT NULL").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    rest = und.join(in_tree, ["a", "b"], "left_anti").withColumn("label", F.xxhash64("a", "b", F.lit("bridge")))
    ends = rest.select(F.explode(F.array("a", "b")).alias("node"), "label")
    sums = kept(tree.join(ends, "node", "left").groupBy("node", "parent", "level").agg(F.coalesce(F.bit_xor("label"), F.lit(0)).alias("x")))
    for k in range(level, 0, -1):
        up = sums.filter(F.col("level") == k).groupBy(F.col("parent").alias("node")).agg(F.bit_xor("x").alias("u"))
        sums = kept(sums.join(up, "node", "left").select("node", "parent", "level", F.col("x").bitwiseXOR(F.coalesce("u", F.lit(0))).alias("x")))
    return sums.filter("parent IS NOT NULL AND x = 0").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))


catalog.add("graph_bridges")(lambda s, d: bridges(edges(s, d).filter("weight >= 9"), nodes(s, d)))
catalog.add("graph_degree_centrality", f"WITH {GRAPH}, o AS (SELECT src AS id, count(*) AS o FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(*) AS i FROM edges GROUP BY 1) SELECT nodes.id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, round((coalesce(o, 0) + coalesce(i, 0)) / (2.0 * ((SELECT count(*) FROM nodes) - 1)), 8)::DOUBLE AS centrality FROM nodes LEFT JOIN o ON nodes.id = o.id LEFT JOIN i ON nodes.id = i.id")(lambda s, d: degrees(edges(s, d), nodes(s, d)))


def degrees(e: DataFrame, n: DataFrame) -> DataFrame:
    o, i = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")), e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    count = n.agg(F.count("*").alias("c"))
    x = n.select("id").join(o, "id", "left").join(i, "id", "left").na.fill(0, ["o", "i"]).join(F.broadcast(count))
    return x.select("id", F.col("o").alias("out_degree"), F.col("i").alias("in_degree"), F.round((F.col("o") + F.col("i")) / (2.0 * (F.col("c") - 1)), 8).alias("centrality"))


catalog.add("graph_orphans_dead_ends", f"WITH {GRAPH} SELECT id, id NOT IN (SELECT dst FROM edges) AS orphan, id NOT IN (SELECT src FROM edges) AS dead_end FROM nodes WHERE id NOT IN (SELECT dst FROM edges) OR id NOT IN (SELECT src FROM edges)")(
    lambda s, d: degrees(edges(s, d), nodes(s, d)).select("id", (F.col("in_degree") == 0).alias("orphan"), (F.col("out_degree") == 0).alias("dead_end")).filter("orphan OR dead_end")
)


def greedy_walks(e: DataFrame, starts: DataFrame, score: Column, hops: int = 4) -> DataFrame:
    """(start, path): walks that take the best unvisited edge at each step (the smallest target of equals) until none is left or hops are made."""
    e = e.select("src", "dst", score.alias("score"))
    walk = kept(starts.select(F.col("id").alias("start"), F.array("id").alias("path")))
    for _ in range(hops):
        steps = walk.join(e, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).groupBy("start").agg(F.max_by("dst", F.struct("score", -F.col("dst"))).alias("dst"))
        walk = kept(walk.join(steps, "start", "left").select("start", F.when(F.col("dst").isNotNull(), F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path")))
    return walk


catalog.add("graph_greedy_walks")(lambda s, d: greedy_walks(edges(s, d), nodes(s, d).select("id"), F.col("weight")))
def random_walks(e: DataFrame, starts: DataFrame, hops: int = 4, seed: int = 42) -> DataFrame:
    """(start, path): walks that take an edge at random at each step, a visited node as well as another, until a dead end or hops are made.

    The draw is a hash of the seed, the walk, the step and the edge, so reruns agree.
    """
    e = e.select("src", "dst")
    walk = kept(starts.select(F.col("id").alias("start"), F.array("id").alias("path")))
    for k in range(hops):
        front = walk.filter(F.size("path") == k + 1)
        steps = front.join(e, F.element_at("path", -1) == F.col("src")).groupBy("start").agg(F.max_by("dst", F.struct(F.xxhash64(F.lit(seed), F.lit(k), "start", "src", "dst"), "dst")).alias("dst"))
        walk = kept(walk.join(steps, "start", "left").select("start", F.when(F.col("dst").isNotNull(), F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path")))
    return walk


catalog.add("graph_random_walks")(lambda s, d: random_walks(edges(s, d), nodes(s, d).select("id")).select(F.explode("path").alias("node")).groupBy("node").agg(F.count("*").alias("visits")))


def clustering(e: DataFrame) -> DataFrame:
    """(id, degree, coefficient) over undirected edges; triangles are found once, from their end of least degree."""
    und = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    deg = und.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    x = und.join(deg.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    low_first = F.struct("da", "a") < F.struct("db", "b")
    o = x.select(F.when(low_first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low_first, F.col("b")).otherwise(F.col("a")).alias("v"))
    tri = o.alias("p").join(o.alias("q"), (F.col("p.u") == F.col("q.u")) & (F.col("p.v") < F.col("q.v"))).select(F.col("p.u").alias("u"), F.col("p.v").alias("a"), F.col("q.v").alias("b")).join(und, ["a", "b"])
    n = tri.select(F.explode(F.array("u", "a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    return deg.join(n, "id", "left").select("id", "degree", F.round(F.when(F.col("degree") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0), 6).alias("coefficient"))


catalog.add("graph_clustering", f"WITH {GRAPH}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE weight >= 6), bi AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u), d AS (SELECT x AS id, count(*) AS degree FROM bi GROUP BY 1), tr AS (SELECT p.x AS id, count(*) AS t FROM bi p JOIN bi q ON p.x = q.x AND p.y < q.y JOIN u ON u.a = p.y AND u.b = q.y GROUP BY 1) SELECT d.id, degree, round(CASE WHEN degree >= 2 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM d LEFT JOIN tr ON d.id = tr.id")(lambda s, d: clustering(edges(s, d).filter("weight >= 6")))
catalog.add("graph_fanout_reach", f"WITH {GRAPH}, e AS (SELECT DISTINCT src, dst FROM edges WHERE weight >= 8 AND src <> dst), b AS (SELECT DISTINCT a.src, e.dst FROM e a JOIN e ON a.dst = e.src WHERE a.src <> e.dst), c AS (SELECT DISTINCT b.src, e.dst FROM b JOIN e ON b.dst = e.src WHERE b.src <> e.dst), r AS (SELECT src, dst, min(h) AS h FROM (SELECT src, dst, 1 AS h FROM e UNION ALL SELECT src, dst, 2 FROM b UNION ALL SELECT src, dst, 3 FROM c) GROUP BY 1, 2) SELECT src, count(*) FILTER (h = 1) AS one, count(*) FILTER (h <= 2) AS two, count(*) AS three FROM r GROUP BY src")(
    lambda s, d: fanout(edges(s, d).filter("weight >= 8"))
)


def fanout(e: DataFrame) -> DataFrame:
    """(src, one, two, three): distinct nodes within one, two and three hops of each node with edges, itself left out; each hop goes on from the new nodes alone."""
    e = kept(e.select("src", "dst").filter("src <> dst").distinct())
    seen = front = e.withColumn("h", F.lit(1))
    for k in (2, 3):
        ahead = front.select("src", F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), "dst"), "via").filter("src <> dst").select("src", "dst").distinct()
        front = kept(ahead.join(seen, ["src", "dst"], "left_anti").withColumn("h", F.lit(k)))
        seen = seen.unionByName(front)
    return seen.groupBy("src").agg(*[F.count_if(F.col("h") <= k).alias(name) for k, name in enumerate(("one", "two", "three"), 1)])


def cyclic_core(e: DataFrame, n: DataFrame, most: int = 200) -> DataFrame:
    """(id): nodes left when those without incoming or without outgoing edges are peeled off again and again: all nodes on cycles, and between them."""

    def step(now: DataFrame) -> DataFrame:
        live = e.select("src", "dst").join(now.select(F.col("id").alias("src")), "src", "left_semi").join(now.select(F.col("id").alias("dst")), "dst", "left_semi")
        return now.join(live.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(live.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")

    return settled(n.select("id"), step, lambda x: x.agg(F.count("*")), most=most)


catalog.add("graph_cyclic_core")(lambda s, d: cyclic_core(edges(s, d), nodes(s, d)))


def traps(e: DataFrame) -> DataFrame:
    """(node, walks): nodes on the cycles that lowest-weight walks close, with the number of such walks, by pointer doubling.

    Walks that end at a node without out-edges drop out. After as many steps as there are nodes the others stand on their cycles,
    of which they reach every node, as each walk that begins on a cycle goes round it.
    """
    # low: the least of the nodes on the way, which names the cycle of a node on one
    jump = kept(e.groupBy("src").agg(F.min_by("dst", F.struct("weight", "dst")).alias("to")).select(F.col("src").alias("id"), "to", F.col("src").alias("low")))
    for _ in range(jump.count().bit_length()):
        jump = kept(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to", F.least("a.low", "b.low").alias("low")))
    at = jump.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("n")).join(jump.select(F.col("id").alias("node"), "low"), "node")
    return at.join(at.groupBy("low").agg(F.sum("n").alias("walks")), "low").select("node", "walks")


catalog.add("graph_loop_traps")(lambda s, d: traps(edges(s, d)))
catalog.add("graph_domain_chain", f"WITH {GRAPH}, x AS (SELECT src, dst, weight, b.domain FROM edges JOIN nodes b ON dst = b.id), one AS (SELECT n.id AS start, x.dst, x.weight FROM nodes n JOIN x ON n.id = x.src WHERE x.domain = 'Brand#2' QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY x.weight DESC, x.dst) = 1) SELECT start, one.dst AS first, x.dst AS second FROM one LEFT JOIN (SELECT * FROM x WHERE domain = 'Brand#3' QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) = 1) x ON one.dst = x.src")(
    lambda s, d: domain_chain(edges(s, d), nodes(s, d), ["Brand#2", "Brand#3"])
)


def domain_chain(e: DataFrame, n: DataFrame, chain: list[str]) -> DataFrame:
    """(start, first, second, ...): from each node the heaviest edge into each next domain; null from a gap on."""
    x = e.join(n.select(F.col("id").alias("dst"), "domain"), "dst")
    best = lambda c: x.filter(F.col("domain") == c).groupBy("src").agg(F.max_by("dst", F.struct("weight", -F.col("dst"))).alias("to"))
    names = ["first", "second", "third", "fourth"]
    out = n.select(F.col("id").alias("start")).join(best(chain[0]).select(F.col("src").alias("start"), F.col("to").alias("first")), "start")
    for k, c in enumerate(chain[1:], 1):
        out = out.join(best(c).select(F.col("src").alias(names[k - 1]), F.col("to").alias(names[k])), names[k - 1], "left")
    return out.select("start", *names[: len(chain)])


_ENDS = "JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id"
_JAC = "len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags)))"
catalog.add("graph_tag_coherence", f"WITH {GRAPH}, j AS (SELECT strength, {_JAC} AS j, row_number() OVER (PARTITION BY strength ORDER BY {_JAC}) AS r, count(*) OVER (PARTITION BY strength) AS n FROM edges {_ENDS}) SELECT strength, round(avg(j), 6) AS mean, round(max(j) FILTER (r = n // 2 + 1), 6) AS median, round(avg((j = 0)::INT), 6) AS zero FROM j GROUP BY strength")(
    lambda s, d: with_summary(counted_values(with_domains(edges(s, d), nodes(s, d)).select("strength", t.jaccard(F.col("src_tags"), F.col("dst_tags")).alias("j")), "strength", "j"), "strength", "j", {"median": F.floor(F.col("n") / 2)}).select("strength", *[F.round(c, 6).alias(c) for c in ("mean", "median", "zero")])
)
catalog.add("graph_domain_gaps", f"WITH {GRAPH}, l AS (SELECT a.domain AS d1, b.domain AS d2, count(DISTINCT src) AS n FROM edges {_ENDS} GROUP BY 1, 2), s AS (SELECT domain, count(*) AS size FROM nodes GROUP BY 1) SELECT x.domain AS d1, y.domain AS d2, round(coalesce(n, 0) / x.size, 6) AS coverage FROM s x CROSS JOIN s y LEFT JOIN l ON l.d1 = x.domain AND l.d2 = y.domain WHERE coalesce(n, 0) / x.size < 0.3")(
    lambda s, d: (lambda size, link: size.select(F.col("domain").alias("d1"), "size", F.explode("all").alias("d2")).join(link, ["d1", "d2"], "left").select("d1", "d2", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("c")).filter("c < 0.3").select("d1", "d2", F.round("c", 6).alias("coverage")))(
        nodes(s, d).groupBy("domain").agg(F.count("*").alias("size")).join(F.broadcast(nodes(s, d).agg(F.collect_set("domain").alias("all")))),
        with_domains(edges(s, d), nodes(s, d)).groupBy(F.col("src_domain").alias("d1"), F.col("dst_domain").alias("d2")).agg(F.count_distinct("src").alias("n")),
    )
)
catalog.add("graph_edge_audit", f"WITH {GRAPH} SELECT a.src, a.dst, CASE WHEN b.src IS NULL THEN 'one way' ELSE 'uneven' END AS issue FROM edges a LEFT JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.weight >= 5 AND (b.src IS NULL OR abs(a.weight - b.weight) > 5)")(
    lambda s, d: edges(s, d).alias("a").join(edges(s, d).alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")), "left").filter((F.col("a.weight") >= 5) & (F.col("b.src").isNull() | (F.abs(F.col("a.weight") - F.col("b.weight")) > 5))).select("a.src", "a.dst", F.when(F.col("b.src").isNull(), "one way").otherwise("uneven").alias("issue"))
)
catalog.add("graph_skewed_nodes", f"WITH {GRAPH} SELECT src, max(weight) AS most, min(weight) AS least FROM edges GROUP BY src HAVING max(weight) >= 8 AND min(weight) <= 1 AND max(weight) >= 3 * avg(weight)")(
    lambda s, d: edges(s, d).groupBy("src").agg(F.max("weight").alias("most"), F.min("weight").alias("least"), F.avg("weight").alias("a")).filter("most >= 8 AND least <= 1 AND most >= 3 * a").drop("a")
)
catalog.add("graph_strength_coverage", f"WITH {GRAPH} SELECT strength, count(*) AS n, round(count(*) / (SELECT count(*) FROM edges), 6) AS share FROM edges GROUP BY strength")(
    lambda s, d: edges(s, d).groupBy("strength").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
)
def tag_cohesion(e: DataFrame, n: DataFrame) -> DataFrame:
    """(tag, n, cohesion): nodes with each tag, and the edges between two of them as a share of all ordered pairs.

    An edge meets the tags of its ends as arrays, and only those that both have become rows, which are counted where they stand.
    """
    tags = lambda end: n.select(F.col("id").alias(end), F.col("tags").alias(f"{end}_tags"))
    both = e.select("src", "dst").join(tags("src"), "src").join(tags("dst"), "dst").select(F.explode(F.array_intersect("src_tags", "dst_tags")).alias("tag"))
    inside = both.groupBy("tag").agg(F.count("*").alias("k"))
    held = n.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return held.join(inside, "tag", "left").select("tag", "n", F.round(F.coalesce("k", F.lit(0)) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)), 8).alias("cohesion"))


catalog.add("graph_tag_cohesion", f"WITH {GRAPH}, x AS (SELECT id, unnest(tags) AS tag FROM nodes), c AS (SELECT tag, count(*) AS n FROM x GROUP BY tag), i AS (SELECT a.tag, count(*) AS k FROM edges JOIN x a ON src = a.id JOIN x b ON dst = b.id AND a.tag = b.tag GROUP BY 1) SELECT c.tag, n, round(coalesce(k, 0) / nullif(n * (n - 1), 0), 8) AS cohesion FROM c LEFT JOIN i ON c.tag = i.tag")(
    lambda s, d: tag_cohesion(edges(s, d), nodes(s, d))
)
catalog.add("graph_missing_backlinks", f"WITH {GRAPH} SELECT dst AS src, src AS dst, weight FROM edges a WHERE weight >= 9 AND NOT EXISTS (SELECT 1 FROM edges b WHERE b.src = a.dst AND b.dst = a.src)")(
    lambda s, d: edges(s, d).filter("weight >= 9").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight").join(edges(s, d).select("src", "dst"), ["src", "dst"], "left_anti")
)
catalog.add("graph_edge_validity", f"WITH {GRAPH} SELECT src, dst, unnest(list_filter([CASE WHEN weight NOT BETWEEN 1 AND 9 THEN 'weight' END, CASE WHEN len(reasons) < 2 THEN 'few reasons' END, CASE WHEN src = dst THEN 'loop' END], lambda x: x IS NOT NULL)) AS issue FROM edges")(
    lambda s, d: edges(s, d).select("src", "dst", F.explode(F.array_compact(F.array(F.when(~F.col("weight").between(1, 9), "weight"), F.when(F.size("reasons") < 2, "few reasons"), F.when(F.col("src") == F.col("dst"), "loop")))).alias("issue"))
)
catalog.add("graph_from_links", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS target FROM pages) SELECT page_id AS src, target AS dst, count(*)::INT AS weight FROM l GROUP BY 1, 2")(
    lambda s, d: table(s, d, "pages").select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("int").alias("weight"))
)


catalog.add("graph_pair_reachability", f"WITH RECURSIVE {GRAPH}, {_HOPS.format(most=3, factor=13, plus=2)} SELECT hops, count(*) AS pairs FROM p LEFT JOIN m ON start = src AND node = dst GROUP BY 1")(
    lambda s, d: fewest_hops(edges(s, d), _asked(s, d, 13, 2), 3).groupBy("hops").agg(F.count("*").alias("pairs"))
)
catalog.add("graph_resource_hops", f"WITH RECURSIVE {GRAPH}, {_GOALS.format('Brand#3')} SELECT start, min(h) AS hops FROM r GROUP BY start")(
    lambda s, d: nearest_goals(edges(s, d), nodes(s, d).filter("domain = 'Brand#3'")).select("start", F.col("distance").alias("hops"))
)


def ego_profiles(e: DataFrame, centres: DataFrame) -> DataFrame:
    """(centre, size, edges, density, mean_weight) of the nodes within one hop."""
    member = centres.select(F.col("id").alias("centre"), F.col("id").alias("node")).unionByName(e.join(centres.select(F.col("id").alias("src")), "src").select(F.col("src").alias("centre"), F.col("dst").alias("node"))).distinct()
    inner = member.select("centre", F.col("node").alias("src")).join(e, "src").join(member.select("centre", F.col("node").alias("dst")), ["centre", "dst"])
    n = member.groupBy("centre").agg(F.count("*").alias("size"))
    m = inner.groupBy("centre").agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 6).alias("mean_weight"))
    return n.join(m, "centre", "left").select("centre", "size", F.coalesce("edges", F.lit(0)).alias("edges"), F.round(F.coalesce("edges", F.lit(0)) / F.nullif(F.col("size") * (F.col("size") - 1), F.lit(0)), 6).alias("density"), "mean_weight")


catalog.add("graph_ego_profiles", f"WITH {GRAPH}, e AS (SELECT * FROM edges WHERE weight >= 7), m AS (SELECT id AS centre, id AS node FROM nodes UNION SELECT src, dst FROM e), n AS (SELECT centre, count(*) AS size FROM m GROUP BY 1), i AS (SELECT a.centre, count(*) AS k, avg(weight) AS w FROM m a JOIN e ON a.node = e.src JOIN m b ON b.centre = a.centre AND b.node = e.dst GROUP BY 1) SELECT n.centre, size, coalesce(k, 0) AS edges, round(coalesce(k, 0) / nullif(size * (size - 1), 0), 6) AS density, round(w, 6) AS mean_weight FROM n LEFT JOIN i ON n.centre = i.centre")(lambda s, d: ego_profiles(edges(s, d).filter("weight >= 7"), nodes(s, d).select("id")))


def _tours(plan: pa.Table, pairs: pa.Table) -> pa.Table:
    """Of a plan's stops (plan, part, stop, own: a start of this part) and pairs (plan, part, src, dst, hops, weight): plan, start, tour, hops, weight. All tours move at once."""
    if not plan.num_rows:
        return pa.Table.from_arrays([plan.column("plan"), plan.column("stop"), pa.array([], pa.list_(plan.schema.field("stop").type)), *[pa.array([], pa.int64())] * 2], ["plan", "start", "tour", "hops", "weight"])
    stop = plan.column("stop").combine_chunks()
    places = pc.sort_indices(stop)
    stop = stop.take(places)
    own = np.flatnonzero(plan.column("own").combine_chunks().take(places).to_numpy(zero_copy_only=False))
    src, dst = (pc.index_in(pairs.column(c), stop).to_numpy() for c in ("src", "dst"))
    hops, weight = (pairs.column(c).to_numpy() for c in ("hops", "weight"))
    # A stop's next ones by fewest hops, most weight and the stop itself; a tour takes the first that it hasn't visited, and those before it stay visited.
    order = np.lexsort((dst, -weight, hops, src))
    src, dst, hops, weight = src[order].astype(np.int64), dst[order].astype(np.int64), hops[order], weight[order]
    begins, ends = np.searchsorted(src, np.arange(len(stop))), np.searchsorted(src, np.arange(len(stop)), side="right")
    visited = np.zeros((len(own), len(stop)), bool)
    visited[np.arange(len(own)), own] = True
    tours, total, gain = [[k] for k in own], np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    open_, at = np.arange(len(own)), own.copy()
    while len(open_):
        low, high, taken = begins[at], ends[at], np.full(len(open_), -1)
        wanted = np.flatnonzero(low < high)
        while len(wanted):
            seen = visited[open_[wanted], dst[low[wanted]]]
            taken[wanted[~seen]] = low[wanted[~seen]]
            wanted = wanted[seen]
            low[wanted] += 1
            wanted = wanted[low[wanted] < high[wanted]]
        some = taken >= 0
        open_, taken = open_[some], taken[some]
        at = dst[taken]
        visited[open_, at] = True
        total[open_] += hops[taken]
        gain[open_] += weight[taken]
        for tour, k in zip(open_.tolist(), at.tolist()):
            tours[tour].append(k)
    flat = stop.take(pa.array([k for tour in tours for k in tour], pa.int64()))
    tour = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tours)]), pa.int32()), flat)
    return pa.Table.from_arrays([plan.column("plan").combine_chunks().take(pa.array(np.zeros(len(own), np.int64))), stop.take(pa.array(own, pa.int64())), tour, pa.array(total), pa.array(gain)], ["plan", "start", "tour", "hops", "weight"])


def visiting_orders(pairs: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan, start, tour, hops, weight): nearest-neighbour orders of each plan's stops from each start, fewest hops first, then most weight, then the smallest stop.

    pairs: src, dst, hops, weight between stops; plans: plan, stop. A plan's pairs meet up to TOURS of its starts in a task; a plan with unreachable stops ends early.
    """
    plans = kept(plans.select("plan", "stop").filter("stop IS NOT NULL").distinct(), "plans")
    end = lambda name: plans.select(F.col("stop").alias(name), F.col("plan").alias(f"{name}_plan"))
    inner = pairs.filter("src <> dst").join(end("src"), "src").join(end("dst"), "dst").filter("src_plan = dst_plan").groupBy(F.col("src_plan").alias("plan"), "src", "dst").agg(F.min(F.struct("hops", (-F.col("weight")).alias("w"))).alias("b"))
    inner = kept(inner.select("plan", "src", "dst", F.col("b.hops").cast("long").alias("hops"), (-F.col("b.w")).cast("long").alias("weight")), "plan-pairs")
    placed = kept(plans.withColumn("place", F.floor((F.row_number().over(Window.partitionBy("plan").orderBy("stop")) - 1) / TOURS)), "plan-starts")
    placed = placed.withColumn("parts", F.max("place").over(Window.partitionBy("plan")) + 1)
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    stops = placed.select("plan", each, "stop", (F.col("place") == F.col("part")).alias("own"))
    n = plans.sparkSession.sparkContext.defaultParallelism * 16
    inner = inner.join(placed.select("plan", "parts").distinct().toDF("plan", "parts"), "plan").select("plan", each, "src", "dst", "hops", "weight").repartition(n, "plan", "part")
    kinds = {name: plans.schema[name].dataType.simpleString() for name in ("plan", "stop")}
    return stops.repartition(n, "plan", "part").groupBy("plan", "part").cogroup(inner.groupBy("plan", "part")).applyInArrow(_tours, f"plan {kinds['plan']}, start {kinds['stop']}, tour array<{kinds['stop']}>, hops long, weight long")


def best_orders(walks: DataFrame) -> DataFrame:
    """The best start of each plan: most stops, fewest hops, most weight."""
    rank = F.struct(-F.size("tour"), "hops", -F.col("weight"), "start")
    return walks.groupBy("plan").agg(F.min_by(F.struct("tour", "hops", "weight"), rank).alias("b")).select("plan", "b.*")


@catalog.add("graph_visiting_orders")
def _orders(s, d):
    """The plan of a domain is to visit its stops, each stop from the last by the fewest hops and the most weight."""
    stops = nodes(s, d).filter(_STOPS)
    paths = stop_paths(edges(s, d), stops.select("id"), stops.select("id"), 4)
    return best_orders(visiting_orders(paths, stops.select(F.col("domain").alias("plan"), F.col("id").alias("stop"))))


def edge_search(e: DataFrame, n: DataFrame, domain: str | None = None, tags: Sequence[str] = (), reasons_contain: str | None = None, min_weight: int = 0, strength: str | None = None) -> DataFrame:
    """(id, domain, edge_count, max_weight, edges): nodes with the edges that qualify by weight, strength, any tag in their reasons, and a part of these."""
    reasons = F.lower(F.array_join("reasons", " "))
    e = e.filter(F.col("weight") >= min_weight)
    if strength:
        e = e.filter(F.col("strength") == strength)
    if tags:
        e = e.filter(F.greatest(*[reasons.contains(x.lower()).cast("int") for x in tags], F.lit(0)) == 1)
    if reasons_contain:
        e = e.filter(reasons.contains(reasons_contain.lower()))
    if domain:
        n = n.filter(F.col("domain") == domain)
    found = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edge_count"), F.max("weight").alias("max_weight"), F.array_sort(F.collect_list("dst")).alias("edges"))
    return n.select("id", "domain").join(found, "id")


catalog.add("graph_edge_search", f"WITH {GRAPH} SELECT nodes.id, domain, count(*) AS edge_count, max(weight) AS max_weight, list_sort(list(dst)) AS edges FROM nodes JOIN edges ON src = nodes.id WHERE domain = 'Brand#12' AND weight >= 3 AND contains(lower(array_to_string(reasons, ' ')), 'flag') AND (contains(lower(array_to_string(reasons, ' ')), 'flag r') OR contains(lower(array_to_string(reasons, ' ')), 'flag a')) GROUP BY 1, 2")(
    lambda s, d: edge_search(edges(s, d), nodes(s, d), domain="Brand#12", tags=["flag R", "flag A"], reasons_contain="flag", min_weight=3)
)


def longest_chains(e: DataFrame, n: DataFrame, hops: int = 4) -> DataFrame:
    """(domain, length, path): the longest simple path of up to hops edges inside each node class, the first of equals."""
    inner = kept(with_domains(e, n).filter(F.col("src_domain") == F.col("dst_domain")).select(F.col("src_domain").alias("domain"), "src", "dst"))
    paths = kept(inner.select("domain", F.array("src", "dst").alias("path")))
    best = paths
    steps = inner.withColumnRenamed("domain", "_domain")
    for _ in range(1, hops):
        longer = paths.join(steps, (F.col("domain") == F.col("_domain")) & (F.element_at("path", -1) == F.col("src"))).filter(~F.array_contains("path", F.col("dst")))
        paths = kept(longer.select("domain", F.concat("path", F.array("dst")).alias("path")))
        best = best.unionByName(paths)
    top = best.groupBy("domain").agg(F.min(F.struct((-F.size("path")).alias("n"), "path")).alias("b"))
    return top.select("domain", (-F.col("b.n")).alias("length"), F.col("b.path").alias("path"))


catalog.add("graph_longest_chains")(lambda s, d: longest_chains(edges(s, d).filter("weight >= 6"), nodes(s, d), 3))


def tuning_scores(e: DataFrame, n: DataFrame, target, tunings: dict[str, tuple[float, float, float]]) -> DataFrame:
    """(tuning, mean, best): how the edges into each node score under several weightings of the hybrid score."""
    out = None
    for name, weights in tunings.items():
        part = hybrid_steps(e, n, target, weights).agg(F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("best")).select(F.lit(name).alias("tuning"), "mean", "best")
        out = part if out is None else out.unionByName(part)
    return out


catalog.add("graph_tuning_scores")(lambda s, d: tuning_scores(edges(s, d), nodes(s, d), 5, {"weight": (1.0, 0.0, 0.0), "strength": (0.2, 3.0, 0.2), "tags": (0.2, 0.2, 1.0), "even": (1.0, 1.0, 1.0), "mixed": (1.0, 2.0, 1.0)}))


# Failure-aware paths, distances between domains, cycles and topics.


def failure_aware(e: DataFrame, starts: DataFrame, default: float = 0.8, risky: float = 0.5) -> DataFrame:
    """(start, node, cost, reliability, risky_hops): cheapest paths where a hop costs 1 / max(weight, 0.1) * 1 / max(success, 0.05), the most reliable of equals.

    Reliability is the product of the success of the path's hops, `default` where an edge has none; a hop below `risky` is a risky one. Costs and
    logarithms are summed as whole millionths, so equal paths are equal whatever the order of their hops.
    """
    p = F.coalesce("success", F.lit(default))
    million = lambda c: F.round(c * 1_000_000).cast("double")
    costs = [million(1 / F.greatest(F.col("weight"), F.lit(0.1)) / F.greatest(p, F.lit(0.05))), million(-F.log(F.greatest(p, F.lit(0.05)))), (p < risky).cast("int")]
    x = cheapest(e, starts, costs)
    return x.select("start", "node", F.round(F.col("cost.c0") / 1_000_000, 6).alias("cost"), F.round(F.exp(-F.col("cost.c1") / 1_000_000), 6).alias("reliability"), F.col("cost.c2").cast("int").alias("risky_hops"))


def _with_success(s, d) -> DataFrame:
    """Edges with a success of 0.25 if a line of theirs came back, 0.95 if one was kept, else none."""
    return edges(s, d).withColumn("success", F.when(F.array_contains("reasons", "flag R"), 0.25).when(F.array_contains("reasons", "flag A"), 0.95))


_P = "CASE WHEN list_contains(reasons, 'flag R') THEN 0.25 WHEN list_contains(reasons, 'flag A') THEN 0.95 ELSE 0.8 END::DOUBLE"
_FA = f"[c[1] + round(1000000 * (1 / greatest(weight, 0.1) / {_P})), c[2] + round(-1000000 * ln({_P})), c[3] + ({_P} < 0.5)::INT]"
catalog.add("graph_failure_aware", f"WITH RECURSIVE {GRAPH}, {_WALKS.format(zero='[0, 0, 0]::DOUBLE[]', plus=_FA)} SELECT start, node, round(min(c)[1] / 1000000, 6) AS cost, round(exp(-min(c)[2] / 1000000), 6) AS reliability, min(c)[3]::INT AS risky_hops FROM r GROUP BY 1, 2")(
    lambda s, d: failure_aware(_with_success(s, d), nodes(s, d).filter("id % 500 = 0"))
)


def neighbour_sides(e: DataFrame, a, b) -> DataFrame:
    """(node, side, weight): out-neighbours of two nodes, as both, only_a or only_b, with the weights added."""
    x = e.filter(F.col("src").isin(a, b)).groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("n"), F.min("src").alias("m"), F.sum("weight").alias("weight"))
    return x.select("node", F.when(F.col("n") == 2, "both").when(F.col("m") == a, "only_a").otherwise("only_b").alias("side"), "weight")


catalog.add("graph_neighbour_sides", f"WITH {GRAPH} SELECT dst AS node, CASE WHEN count(DISTINCT src) = 2 THEN 'both' WHEN min(src) = 0 THEN 'only_a' ELSE 'only_b' END AS side, sum(weight)::BIGINT AS weight FROM edges WHERE src IN (0, 1) GROUP BY dst")(lambda s, d: neighbour_sides(edges(s, d), 0, 1))


def domain_distances(e: DataFrame, n: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(a, b, pairs, mean): mean hops from the starts in domain a to the nodes of domain b that lie within depth hops."""
    of = n.select("id", "domain")
    x = balls(e, starts, depth).filter("distance > 0").join(of.select(F.col("id").alias("start"), F.col("domain").alias("a")), "start").join(of.select(F.col("id").alias("node"), F.col("domain").alias("b")), "node")
    return x.groupBy("a", "b").agg(F.count("*").alias("pairs"), F.round(F.avg("distance"), 6).alias("mean"))


_BFS = "r AS (SELECT id AS start, id AS node, 0 AS h FROM nodes WHERE id % 100 = 0 UNION SELECT start, dst, h + 1 FROM r JOIN edges ON src = node WHERE h < 3), m AS (SELECT start, node, min(h) AS h FROM r GROUP BY 1, 2)"
catalog.add("graph_domain_distances", f"WITH RECURSIVE {GRAPH}, {_BFS} SELECT a.domain AS a, b.domain AS b, count(*) AS pairs, round(avg(h), 6) AS mean FROM m JOIN nodes a ON start = a.id JOIN nodes b ON node = b.id WHERE h > 0 GROUP BY 1, 2")(
    lambda s, d: domain_distances(edges(s, d), nodes(s, d), nodes(s, d).filter("id % 100 = 0"))
)


def shortest_cycles(e: DataFrame, starts: DataFrame, most: int = 4) -> DataFrame:
    """(start, length): hops of the shortest cycle through each start, of those with one of at most `most` hops."""
    e = kept(e.select("src", "dst"), "cycle-edges")
    loops = e.filter("src = dst").select(F.col("src").alias("start")).join(starts.select(F.col("id").alias("start")), "start", "left_semi").select("start", F.lit(1).alias("length"))
    # The searches along and against the edges meet half-way round.
    ahead, behind = balls(e, starts, most - most // 2), balls(turned(e), starts, most // 2)
    met = ahead.filter("start <> node").join(behind.withColumnRenamed("distance", "back"), ["start", "node"]).select("start", (F.col("distance") + F.col("back")).alias("length"))
    return loops.unionByName(met).groupBy("start").agg(F.min("length").alias("length"))


catalog.add("graph_shortest_cycles", f"WITH RECURSIVE {GRAPH}, {_BFS} SELECT start, min(h) + 1 AS length FROM m JOIN edges ON src = node AND dst = start GROUP BY 1")(lambda s, d: shortest_cycles(edges(s, d), nodes(s, d).filter("id % 100 = 0")))


def unsupported_edges(e: DataFrame, n: DataFrame, least: int = 7) -> DataFrame:
    """(src, dst, issue): edges of weight `least` or more without a common tag, and reasons that the other direction's edge doesn't give."""
    e = kept(e.select("src", "dst", "weight", "reasons"), "audited-edges")
    # Tags travel with the heavy edges alone, and reasons meet without them.
    bare = with_domains(e.filter(F.col("weight") >= least).select("src", "dst"), n.select("id", F.lit(None).cast("string").alias("domain"), "tags")).filter(~F.arrays_overlap("src_tags", "dst_tags"))
    back = e.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("reasons").alias("back"))
    one_sided = e.select("src", "dst", "reasons").join(back, ["src", "dst"]).filter(F.size(F.array_except("reasons", "back")) > 0).select("src", "dst")
    for end in ("src", "dst"):
        one_sided = one_sided.join(n.select(F.col("id").alias(end)), end)
    return bare.select("src", "dst", F.lit("no common tag").alias("issue")).unionByName(one_sided.select("src", "dst", F.lit("one-sided reason").alias("issue")))


catalog.add("graph_unsupported_edges", f"WITH {GRAPH}, x AS (SELECT e.src, e.dst, e.weight, a.tags AS p, b.tags AS q, e.reasons AS r, o.reasons AS back FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id LEFT JOIN edges o ON o.src = e.dst AND o.dst = e.src) SELECT src, dst, 'no common tag' AS issue FROM x WHERE weight >= 7 AND NOT list_has_any(p, q) UNION ALL SELECT src, dst, 'one-sided reason' FROM x WHERE back IS NOT NULL AND NOT list_has_all(back, r)")(
    lambda s, d: unsupported_edges(edges(s, d), nodes(s, d))
)


def topic_clusters(rows: DataFrame, hub_share: float = 0.01) -> DataFrame:
    """(id, topic): rows (id, words) that share a keyword, directly or through others, in one topic named by its smallest id.

    Keywords in more than hub_share of all rows (but at least in three) are hubs and join nothing. A keyword ties its rows to the smallest of them, so the edges are no more than the postings.
    """
    post = rows.select("id", F.explode(F.array_distinct("words")).alias("word"))
    df = post.groupBy("word").agg(F.count("*").alias("df"), F.min("id").alias("first"))
    # A broadcast of one row.
    bound = rows.agg(F.greatest(F.count("*") * hub_share, F.lit(2.0)).alias("most"))
    firsts = df.join(F.broadcast(bound)).filter((F.col("df") > 1) & (F.col("df") <= F.col("most"))).select("word", "first")
    star = post.join(firsts, "word").filter("id <> first").select(F.col("first").alias("src"), F.col("id").alias("dst")).distinct()
    return components(star, rows.select("id")).withColumnRenamed("component", "topic")


@catalog.add("topic_clusters")
def _topics(s, d):
    rows = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), t.keywords(F.col("text"), 4).alias("words"))
    return topic_clusters(rows)
