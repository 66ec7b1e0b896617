"""Searches from both ends: their rows against plain loops, and how many rows they write on a graph that grows tenfold with each hop."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import failures, graph, paths


@pytest.fixture
def written(monkeypatch):
    """The rows of each table that a search writes."""
    rows, kept = [], graph.kept

    def counted(df, *name):
        out = kept(df, *name)
        rows.append(out.count())
        return out

    for module in (graph, failures):
        monkeypatch.setattr(module, "kept", counted)
    return rows


def _tree(spark):
    """Each node has ten children: 11,110 edges in four layers."""
    return spark.range(1, 11_111).select(F.floor((F.col("id") - 1) / 10).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1).alias("weight"))


def _pairs(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_fewest_hops_meets_half_way(spark, written):
    got = graph.fewest_hops(_tree(spark), _pairs(spark, [(0, 11_110), (0, 7), (7, 0), (3, 3)], "src long, dst long"), 4).collect()
    assert sorted(map(tuple, got)) == [(0, 7, 1), (0, 11_110, 4), (3, 3, 0), (7, 0, None)]
    assert sum(r for r in written if r != 11_110) < 1_000


def test_stop_paths_meet_half_way(spark, written):
    ids = spark.createDataFrame([(0,), (11_110,)], "id long")
    assert [tuple(r) for r in graph.stop_paths(_tree(spark), ids, ids, 4).collect()] == [(0, 11_110, 4, 4)]
    assert sum(r for r in written if r != 11_110) < 1_000


def test_cycles_meet_half_way(spark, written):
    e = _tree(spark).select("src", "dst").unionByName(spark.createDataFrame([(11_110, 1111), (1111, 0), (5, 5)], "src long, dst long"))
    got = graph.shortest_cycles(e, spark.createDataFrame([(0,), (5,), (9,)], "id long"), 4).collect()
    assert sorted(map(tuple, got)) == [(5, 1)]
    back = e.unionByName(spark.createDataFrame([(11_109 // 10, 0)], "src long, dst long"))
    assert [tuple(r) for r in graph.shortest_cycles(back, spark.createDataFrame([(0,)], "id long"), 4).collect()] == [(0, 4)]
    assert sum(r for r in written if r < 11_000) < 1_500


def test_failures_touch_only_the_pairs_paths(spark, written):
    got = failures.failure_injection(_tree(spark), _pairs(spark, [(0, 11_110)], "start long, target long"), 4)
    assert got.filter("broken = 1").count() == 4
    assert sum(r for r in written if r < 11_000) < 1_000


def _distances(edges, start, most):
    seen, front = {start: (0, 0)}, {start: 0}
    for k in range(1, most + 1):
        new = {}
        for a, b, w in edges:
            if a in front and b not in seen:
                new[b] = max(new.get(b, -1), front[a] + w)
        seen.update({x: (k, w) for x, w in new.items()})
        front = new
    return seen


@pytest.mark.parametrize("seed,most", [(1, 1), (2, 3), (3, 4), (4, 5)])
def test_against_single_searches(spark, seed, most):
    rng = random.Random(seed)
    edges = list({(a, b): (a, b, rng.randint(0, 9)) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(70))}.values())
    e = spark.createDataFrame([*edges, (None, 1, 2), (2, None, 2)], "src long, dst long, weight int")
    far = {s: _distances(edges, s, most) for s in range(30)}
    pairs = [(s, t) for s in range(0, 30, 3) for t in range(30)]
    hops = {(r["src"], r["dst"]): r["hops"] for r in graph.fewest_hops(e, _pairs(spark, pairs, "src long, dst long"), most).collect()}
    assert hops == {(s, t): far[s].get(t, (None,))[0] for s, t in pairs}
    stops = sorted(map(tuple, graph.stop_paths(e, spark.range(0, 30, 3), spark.range(0, 30, 2), most).collect()))
    assert stops == sorted((s, t, *far[s][t]) for s in range(0, 30, 3) for t in range(0, 30, 2) if s != t and t in far[s])
    cycles = {r["start"]: r["length"] for r in graph.shortest_cycles(e, spark.range(30), most).collect()}
    want = {}
    for s in range(30):
        lengths = [far[s][a][0] + 1 for a, b, _ in edges if b == s and a in far[s] and far[s][a][0] + 1 <= most]
        if lengths:
            want[s] = min(lengths)
    assert cycles == want


def test_bounds_stop_at_the_starts(spark, monkeypatch):
    rows, kept = {}, paths.kept

    def counted(df, name="round"):
        out = kept(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(paths, "kept", counted)
    # 1,000 nodes are three hops away from the target, one of them is a start.
    e = _tree(spark).filter("dst <= 1110").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    got = paths.best_simple_paths(e, spark.createDataFrame([(1110,)], "id long"), spark.createDataFrame([(0,)], "id long"), F.col("weight"), 3).collect()
    assert [(r["src"], r["dst"], r["score"], r["path"]) for r in got] == [(1110, 0, 3.0, [1110, 110, 10, 0])]
    assert max(rows["bounds"]) < 200


def test_tag_cohesion_makes_rows_of_common_tags_alone(spark):
    # ends with 30 tags each and one in common; a null tag is common to none
    n = spark.createDataFrame([(i, [f"{i}-{k}" for k in range(29)] + ["all"]) for i in range(4)] + [(4, [None]), (5, [])], "id long, tags array<string>")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 4), (0, 5), (0, 9)], "src long, dst long")
    found = graph.tag_cohesion(e, n)
    got = {r["tag"]: (r["n"], r["cohesion"]) for r in found.collect()}
    assert got["all"] == (4, round(4 / 12, 8)) and got["0-0"] == (1, None) and len(got) == 4 * 29 + 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2  # the nodes' tags once, and the edges' common ones
