"""Searches of whole components in tasks, and of those beyond the bounds by rounds."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import costs, graph, lots, paths


def test_costs_along_a_chain_of_more_edges_than_rounds(spark):
    e = spark.createDataFrame([(k, k + 1, 1) for k in range(250)], "src long, dst long, weight int")
    got = costs.cheapest(e, spark.range(1), [F.col("weight")]).collect()
    assert {r["node"]: r["cost"]["c0"] for r in got} == {k: float(k) for k in range(251)}


def some_edges(seed):
    """Four components of about twelve nodes, a large one, and a node by itself (999)."""
    rng = random.Random(seed)
    return [(100 * c + rng.randrange(n), 100 * c + rng.randrange(n), rng.randint(0, 3), rng.randint(0, 9)) for c, n, m in [(0, 12, 25), (1, 12, 25), (2, 12, 25), (3, 12, 25), (5, 60, 150)] for _ in range(m)]


@pytest.mark.parametrize("most_edges, share, cells", [(4_000_000, 100_000, 1 << 21), (100, 20, 64), (0, 20, 64)])
def test_costs_in_lots_and_by_rounds(spark, monkeypatch, most_edges, share, cells):
    monkeypatch.setattr(lots, "LOT_EDGES", most_edges)
    monkeypatch.setattr(lots, "SHARE", share)
    monkeypatch.setattr(costs, "CELLS", cells)
    rows = some_edges(4)
    starts = [0, 3, 101, 205, 301, 303, 500, 501, 530, 999]
    want = {(s, s): (0.0, 0.0) for s in starts}
    for s in starts:
        for _ in range(80):
            for a, b, x, y in rows:
                if (s, a) in want:
                    c = want[s, a]
                    want[s, b] = min(want.get((s, b), (9e9, 0.0)), (c[0] + x, c[1] + y))
    e = spark.createDataFrame(rows, "src long, dst long, a int, b int")
    got = costs.cheapest(e, spark.createDataFrame([(s,) for s in starts], "id long"), [F.col("a"), F.col("b")]).collect()
    assert len(got) == len(want) and {(r["start"], r["node"]): tuple(r["cost"]) for r in got} == want


@pytest.mark.parametrize("most_edges", [4_000_000, 0])
def test_eccentricities_of_all_nodes_however_far(spark, monkeypatch, most_edges):
    monkeypatch.setattr(lots, "LOT_EDGES", most_edges)
    near = {k: set() for k in range(14)}
    chain = [(k, k + 1) for k in range(9)] + [(1, 0), (4, 4), (11, 12), (12, 13)]
    for a, b in chain:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in near:
        seen, front, k = {s: 0}, {s}, 0
        while front:
            k += 1
            front = {b for a in front for b in near[a]} - set(seen)
            seen |= dict.fromkeys(front, k)
        want[s] = (max(seen.values()), len(seen), round(sum(seen.values()) / len(seen), 6))
    got = graph.eccentricities(spark.createDataFrame([*chain, (None, 3)], "src long, dst long"), spark.range(14)).collect()
    assert len(got) == 14 and {r["start"]: (r["eccentricity"], r["reached"], r["mean"]) for r in got} == want


def test_visiting_orders_take_no_job_for_each_stop(spark, monkeypatch):
    monkeypatch.setattr(graph, "TOURS", 7)
    rng = random.Random(2)
    pairs = {(a, b): (rng.randint(1, 3), rng.randint(0, 4)) for a in range(40) for b in range(40) if a != b and rng.random() < 0.3}
    plans = [("p", k) for k in range(30)] + [("q", k) for k in range(30, 40)] + [("one", 50), (None, 60)]
    want = {}
    for plan, start in plans:
        tour, hops, weight = [start], 0, 0
        while steps := [(pairs[tour[-1], b][0], -pairs[tour[-1], b][1], b) for p, b in plans if p == plan and (tour[-1], b) in pairs and b not in tour]:
            h, w, b = min(steps)
            tour, hops, weight = [*tour, b], hops + h, weight - w
        want[plan, start] = (tour, hops, weight)
    spark.sparkContext.setJobGroup("tours", "tours")
    try:
        got = graph.visiting_orders(spark.createDataFrame([(a, b, *x) for (a, b), x in pairs.items()], "src long, dst long, hops int, weight long"), spark.createDataFrame(plans, "plan string, stop long")).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("tours")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == len(want) and {(r["plan"], r["start"]): (r["tour"], r["hops"], r["weight"]) for r in got} == want


@pytest.mark.parametrize("most_edges, cells", [(4_000_000, 1 << 20), (40, 24)])
def test_best_simple_paths_in_lots_and_by_rounds(spark, monkeypatch, most_edges, cells):
    """Eight hops, where the best walks go round cycles and so the first paths don't reach their bounds."""
    monkeypatch.setattr(lots, "LOT_EDGES", most_edges)
    monkeypatch.setattr(lots, "SHARE", 20)
    monkeypatch.setattr(paths, "CELLS", cells)
    monkeypatch.setattr(paths, "AT_ONCE", cells)
    rng = random.Random(6)
    rows = [*{(a, b): (a, b, rng.randint(0, 9)) for c, n, m in [(0, 9, 22), (100, 9, 22), (500, 12, 110)] for _ in range(m) for a, b in [(c + rng.randrange(n), c + rng.randrange(n))]}.values(), (0, 1, 9), (1, 0, 9), (2, 0, None), (None, 3, 9)]
    some = [0, 1, 2, 5, 101, 105, 999] + [500, 507]
    near = {}
    for a, b, w in rows:
        if w is not None and a is not None:
            near.setdefault(a, {})[b] = max(w, near.get(a, {}).get(b, 0))
    want = {}

    def walk(path, score):
        if len(path) > 1 and path[-1] in some:
            want[path[0], path[-1]] = max(score, want.get((path[0], path[-1]), -1))
        if len(path) <= 8:
            for b, w in near.get(path[-1], {}).items():
                if b not in path:
                    walk([*path, b], score + w)

    for s in some:
        if s < 500:
            walk([s], 0)
    e = spark.createDataFrame(rows, "src long, dst long, weight int")
    ends = spark.createDataFrame([(k,) for k in some], "id long")
    got = paths.best_simple_paths(e, ends.filter("id < 500"), ends, F.col("weight"), 8, beam=1).collect()
    assert len(got) == len(want) and {(r["src"], r["dst"]): r["score"] for r in got} == want
    for r in got:
        assert r["path"][0] == r["src"] and r["path"][-1] == r["dst"] and len(set(r["path"])) == r["hops"] + 1 and sum(near[a][b] for a, b in zip(r["path"], r["path"][1:])) == r["score"]


def test_adaptive_paths_of_three_hops_take_few_jobs(spark):
    """Equal to all paths by a plain loop, with bare nodes, null weights and repeated edges; bounds and rounds took more."""
    rng = random.Random(9)
    rows = [*((rng.randrange(12), rng.randrange(12), rng.randint(0, 9), rng.choice(["strong", "medium", "weak"])) for _ in range(45)), (1, 2, None, "weak"), (None, 2, 5, "weak")]
    tags = {k: rng.sample("abcde", rng.randint(0, 4)) for k in range(12)}
    bonus = {"strong": 3.0, "medium": 1.5, "weak": 0.0}

    def like(a, b):
        x, y = set(tags[a]), set(tags[b])
        return 5.0 if not x and not y else 2.0 if not x or not y else 10 * len(x & y) / len(x | y)

    want = {}

    def walk(path, steps, targets):
        if len(path) > 1 and path[-1] in targets:
            for name, (aw, ab, al) in paths.TUNINGS.items():
                score = sum(aw * w + ab * bonus[s] for w, s in steps) + sum(al * like(v, path[-1]) for v in path[1:])
                want[name, path[0], path[-1]] = max(score, want.get((name, path[0], path[-1]), -1.0))
        if len(path) <= 3:
            for a, b, w, s in rows:
                if a == path[-1] and w is not None and b not in path:
                    walk([*path, b], [*steps, (w, s)], targets)

    for start in (0, 1, 2, 3, 4):
        walk([start], [], {2, 3, 4, 5, 6})
    e = spark.createDataFrame(rows, "src long, dst long, weight int, strength string")
    n = spark.createDataFrame(list(tags.items()), "id long, tags array<string>")
    spark.sparkContext.setJobGroup("short", "short")
    try:
        got = paths.adaptive_paths(e, n, spark.range(5), spark.range(2, 7), hops=3).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("short")) < 45
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == len(want) and all(abs(want[r["tuning"], r["src"], r["dst"]] - r["score"]) < 1e-4 for r in got)
