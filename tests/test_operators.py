"""Operators that SQL can't state, on small inputs whose results are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import graph, linking
from tessera.streaming import monitors


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight int")


def nodes(spark, n):
    return spark.range(n).select("id", F.lit("d").alias("domain"), F.array(F.lit("t")).alias("tags"))


def test_components_close_over_edges(spark):
    got = graph.components(edges(spark, [(0, 1, 1), (2, 1, 1), (3, 4, 1)]), nodes(spark, 6))
    assert {(r["id"], r["component"]) for r in got.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)}


def test_bridges(spark):
    # two triangles joined by one edge, and a pendant
    e = edges(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1), (5, 6, 1)])
    assert {(r["a"], r["b"]) for r in graph.bridges(e, nodes(spark, 7)).collect()} == {(2, 3), (5, 6)}


def test_best_paths_are_simple(spark):
    e = edges(spark, [(0, 1, 9), (1, 0, 9), (1, 2, 1), (0, 2, 5)])
    got = {r["hops"]: (r["path"], r["score"]) for r in graph.best_paths(e, 0, 2, F.col("weight"), 3).collect()}
    assert got == {1: ([0, 2], 5.0), 2: ([0, 1, 2], 10.0)}


def test_fanout_counts_each_node_once(spark):
    # 0 -> 1 -> 2 -> 3 -> 4, a way back to 0, a short cut, a loop and a repeated edge
    e = edges(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 0, 1), (0, 2, 1), (2, 2, 1), (0, 1, 1)])
    assert {tuple(r) for r in graph.fanout(e).collect()} == {(0, 2, 3, 4), (1, 2, 3, 4), (2, 1, 2, 2), (3, 1, 1, 1)}


def test_cyclic_core(spark):
    e = edges(spark, [(0, 1, 1), (1, 2, 1), (2, 1, 1), (2, 3, 1)])
    assert {r["id"] for r in graph.cyclic_core(e, nodes(spark, 4)).collect()} == {1, 2}


def test_cheapest(spark):
    e = edges(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 5)])
    got = graph.cheapest(e, spark.range(1), [F.col("weight")]).collect()
    assert {(r["node"], r["cost"]["c0"]) for r in got} == {(0, 0.0), (1, 1.0), (2, 2.0)}


def test_cheapest_compares_costs_one_after_the_other(spark):
    # two steps of tier 1 and much slack (2, 1800) before one of tier 3 and none
    e = edges(spark, [(0, 1, 900), (1, 2, 900), (0, 2, 0)])
    tier = F.when(F.col("weight") > 0, 1).otherwise(3)
    got = {r["node"]: tuple(r["cost"]) for r in graph.cheapest(e, spark.range(1), [tier, F.col("weight")]).collect()}
    assert got == {0: (0.0, 0.0), 1: (1.0, 900.0), 2: (2.0, 1800.0)}


def test_cheapest_from_many_starts_and_by_many_edges(spark, monkeypatch):
    """More starts than a row holds, more edges than one of their rows, and rows of a node beyond a batch, against a plain search."""
    import heapq
    import random

    from tessera.operators import costs

    monkeypatch.setattr(costs, "WIDTH", 4)
    monkeypatch.setattr(costs, "EDGES", 3)
    monkeypatch.setattr(costs, "AT_ONCE", 64)
    rng = random.Random(1)
    rows = [(f"n{rng.randint(0, 39)}", f"n{rng.randint(0, 39)}", rng.randint(0, 3), rng.randint(0, 9)) for _ in range(110)] + [("n1", f"n{k}", 3, 1) for k in range(30)] + [(None, "n1", 1, 1), ("n1", None, 1, 1), ("n2", "n3", None, 0)]
    starts = [f"n{k}" for k in range(11)] + ["alone", "n3", None]
    want = {}
    for s in set(starts) - {None}:
        best, heap = {}, [((0.0, 0.0), s)]
        while heap:
            c, node = heapq.heappop(heap)
            if node not in best:
                best[node] = c
                for a, b, x, y in rows:
                    if a == node and b is not None and x is not None:
                        heapq.heappush(heap, ((c[0] + x, c[1] + y), b))
        want |= {(s, node): c for node, c in best.items()}
    e = spark.createDataFrame(rows, "src string, dst string, a int, b int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = graph.cheapest(e, spark.createDataFrame([(s,) for s in starts], "id string"), [F.col("a"), F.col("b")]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {(r["start"], r["node"]): tuple(r["cost"]) for r in got} == want


def test_components_of_long_chains_and_of_edges_beyond_the_nodes(spark):
    """A chain in mixed order is settled in a few rounds; ends that are no nodes join nothing."""
    import random

    order = list(range(120))
    random.Random(3).shuffle(order)
    rows = [(order[k], order[k + 1], 1) for k in range(119) if k != 70] + [(5, 500, 1), (500, 200, 1), (201, 201, 1), (202, 201, 1), (None, 3, 1)]
    e = spark.createDataFrame(rows, "src long, dst long, weight int")
    n = spark.createDataFrame([(i,) for i in [*range(120), 200, 201, 202]], "id long")
    want = {i: min(part) for part in (order[:71], order[71:]) for i in part} | {200: 200, 201: 201, 202: 201}
    assert {r["id"]: r["component"] for r in graph.components(e, n, most=8).collect()} == want


def test_unsupported_edges_carry_tags_for_heavy_edges_alone(spark):
    e = spark.createDataFrame([(0, 1, 9, ["x"]), (1, 0, 2, ["x", "y"]), (0, 2, 6, ["x"]), (0, 3, 9, ["x"]), (3, 0, 1, None), (2, 9, 9, ["x"]), (9, 2, 9, ["y"]), (1, 3, 8, ["x"])], "src long, dst long, weight int, reasons array<string>")
    n = spark.createDataFrame([(0, "d", ["a"]), (1, "d", ["b"]), (2, "d", ["c"]), (3, "d", None)], "id long, domain string, tags array<string>")
    found = graph.unsupported_edges(e, n)
    assert sorted(map(tuple, found.collect())) == [(0, 1, "no common tag"), (1, 0, "one-sided reason")]
    # No step of the plan carries both.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("tags" not in line for line in plan.splitlines() if "reasons" in line)


def test_traps_name_whole_cycles_and_no_dead_ends(spark):
    # 0 -> 1 -> 2 -> 1 closes a cycle; 3 -> 4 ends
    e = edges(spark, [(0, 1, 1), (1, 2, 1), (2, 1, 1), (3, 4, 1)])
    assert {(r["node"], r["walks"]) for r in graph.traps(e).collect()} == {(1, 3), (2, 3)}


def test_stop_paths_take_fewest_hops_then_most_weight(spark):
    e = edges(spark, [(0, 1, 1), (0, 2, 5), (1, 3, 9), (2, 3, 4), (3, 0, 2)])
    ids = spark.range(4)
    got = {(r["src"], r["dst"]): (r["hops"], r["weight"]) for r in graph.stop_paths(e, ids.filter("id = 0"), ids).collect()}
    assert got == {(0, 1): (1, 1), (0, 2): (1, 5), (0, 3): (2, 10)}


def test_random_walks_may_leave_a_node_by_another_edge(spark):
    e = edges(spark, [(0, k, 1) for k in range(1, 9)] + [(k, 0, 1) for k in range(1, 9)])
    paths = [r["path"] for r in graph.random_walks(e, spark.range(9), 8).collect()]
    assert all(len(p) == 9 for p in paths)
    assert len({b for p in paths for a, b in zip(p, p[1:]) if a == 0}) > 3
    assert sorted(paths) == sorted(r["path"] for r in graph.random_walks(e.repartition(3), spark.range(9), 8).collect())


def test_nearest_goals(spark):
    e = edges(spark, [(0, 1, 1), (1, 2, 1), (3, 0, 1), (4, 2, 1), (4, 5, 1)])
    got = {r["start"]: (r["distance"], r["node"]) for r in graph.nearest_goals(e, spark.createDataFrame([(2,), (5,)], "id long")).collect()}
    assert got == {2: (0, 2), 5: (0, 5), 1: (1, 2), 4: (1, 2), 0: (2, 2), 3: (3, 2)}


def test_macd_signal(spark):
    from tessera.operators import series

    closes = [float(10 + (k % 7) * (-1) ** k) for k in range(40)]
    p = spark.createDataFrame([("a", k, c) for k, c in enumerate(closes)], "ticker string, month int, close double")

    def ema(xs, n):
        out = [xs[0]]
        for x in xs[1:]:
            out.append(out[-1] + (x - out[-1]) * 2 / (n + 1))
        return out

    macd = [a - b for a, b in zip(ema(closes, 12), ema(closes, 26))]
    e = series.emas(p, "close", (12, 26)).withColumn("m", F.col("e12") - F.col("e26"))
    got = {r["month"]: r["e9"] for r in series.emas(e, "m", (9,)).collect()}
    assert all(abs(got[k] - x) < 1e-9 for k, x in enumerate(ema(macd, 9)))


def test_nearest_of_each_is_exact(spark):
    import numpy as np

    from tessera.operators.search import nearest_of_each

    v = np.random.default_rng(1).normal(size=(60, 4)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = nearest_of_each(df, df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5, rows=7, asked=2).collect()
    for q in (0, 20, 40):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1)).round(6)
        want = np.lexsort((np.arange(60), d))[:5].tolist()
        assert [r["vec_id"] for r in sorted(got, key=lambda r: (r["distance"], r["vec_id"])) if r["query_id"] == q] == want


def test_prefix_pairs_against_brute_force(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    sets = {i: {int(x) for x in rng.integers(0, 14, rng.integers(1, 12))} for i in range(80)}
    df = spark.createDataFrame([(i, sorted(map(str, x))) for i, x in sets.items()], "id long, items array<string>")
    for level in (0.4, 0.75, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= level * len(sets[a] | sets[b]) - 1e-9}
        assert {(r["a"], r["b"]) for r in linking.prefix_pairs(df, level).collect()} == want


def test_read_records(spark, tmp_path):
    from tessera.sources.records import read_records

    (tmp_path / "a.json").write_text('[{"id": "1", "t": "x"}, {"id": "2"}]')
    (tmp_path / "b.json").write_text('{"findings": [{"id": "3"}], "n": 1}')
    (tmp_path / "c.jsonl").write_text('{"id": "4"}\n\nnot json\n{"id": "5", "t": "y"}\n')
    (tmp_path / "d.json").write_text('{"id": "6"}')
    (tmp_path / "e.json").write_text("")
    got = read_records(spark, f"file://{tmp_path}", "id string, t string")
    assert sorted((r["id"], r["t"]) for r in got.collect()) == [("1", "x"), ("2", None), ("3", None), ("4", None), ("5", "y"), ("6", None)]


def test_greedy_leaders_follow_the_loop(spark):
    # a chain: 1 leads 2; 3 is near 2 only, so it leads; 4 is near 3
    ids, pairs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long"), spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert {(r["id"], r["leader"]) for r in linking.greedy_leaders(ids, pairs).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_merge_fills_blanks(spark):
    rows = spark.createDataFrame([("k", 1, "x", None, ["a"]), ("k", 2, "y", "z", ["b"])], "k string, o int, p string, q string, l array<string>")
    r = linking.merge_records(rows, "k", ["p", "q"], ["l"], F.col("o")).first()
    assert (r["p"], r["q"], r["l"], r["sources"]) == ("y", "z", ["a", "b"], 2)


def test_front_matter(spark):
    head, body = t.front_matter(F.col("x"))
    r = spark.createDataFrame([("---\na: 1\nb: [x, 'y']\n---\ntext",)], "x string").select(head.alias("h"), body.alias("b")).first()
    assert r["h"] == {"a": "1", "b": "[x, 'y']"} and r["b"] == "text"
    assert spark.sql("SELECT '[x, \"y\"]' AS v").select(t.bracket_list(F.col("v")).alias("l")).first()["l"] == ["x", "y"]


def test_rate_limit_counts_admitted_calls_only():
    step, state, got = monitors.rate_limit(2, 10.0), None, []
    for i, at in enumerate((0.0, 1.0, 2.0, 10.5, 11.5)):
        state, out = step(state, {"key": "k", "id": i, "at": at})
        got.append(out[0]["admitted"])
    assert got == [True, True, False, True, True]


def test_breaker_cycle():
    step, state, moves = monitors.breaker(2, 60.0), None, []
    for i, (at, ok) in enumerate(((0, False), (1, False), (2, True), (70, False), (200, True))):
        state, out = step(state, {"key": "k", "id": i, "at": float(at), "ok": ok})
        moves += [(m["before"], m["after"]) for m in out]
    assert moves == [("closed", "open"), ("open", "half_open"), ("half_open", "open"), ("open", "half_open"), ("half_open", "closed")]


@pytest.mark.parametrize("step,schema", [(monitors.rate_limit(2, 10.0), monitors.ADMITTED), (monitors.breaker(2, 5.0), monitors.MOVES)])
def test_stream_equals_batch(spark, tmp_path, step, schema):
    rows = spark.createDataFrame([(f"k{i % 3}", i, float(i), i % 4 == 0) for i in range(60)], "key string, id long, at double, ok boolean")
    for part in range(3):
        rows.filter(F.floor(F.col("id") / 20) == part).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    want = {tuple(r) for r in monitors.ordered(rows, "key", ["at", "id"], step, schema).collect()}
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    name = f"out_{abs(hash(schema)) % 10**6}"
    q = monitors.stateful_stream(stream, "key", ["at", "id"], step, schema).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()} == want


def test_traps_are_all_nodes_of_the_cycles_that_walks_close(spark):
    # a tail of 70 nodes into a cycle of three, a cycle of two behind a heavier way out, and a walk that ends
    tail = [(k, k + 1, 1) for k in range(70)]
    e = edges(spark, [*tail, (70, 71, 1), (71, 72, 1), (72, 70, 1), (72, 90, 2), (80, 81, 1), (81, 80, 1), (91, 92, 1), (92, 93, 1)])
    assert {(r["node"], r["walks"]) for r in graph.traps(e).collect()} == {(70, 73), (71, 73), (72, 73), (80, 2), (81, 2)}


def test_two_hops_of_a_hot_start_are_exact(spark):
    # the best sum begins with the lightest of 60 edges, the beam holds 10
    e = edges(spark, [*[(0, k, 9) for k in range(10, 70)], *[(k, 5, 1) for k in range(10, 40)], (0, 99, 1), (99, 5, 10)])
    assert [(r["path"], r["score"], r["hops"]) for r in graph.best_paths(e, 0, 5, F.col("weight"), 2, beam=10).collect()] == [([0, 99, 5], 11.0, 2)]


def test_a_beam_never_cuts_in_silence(spark):
    e = edges(spark, [*[(0, k, 1) for k in range(10, 14)], *[(k, m, 1) for k in range(10, 14) for m in range(20, 24)], *[(m, 30, 1) for m in range(20, 24)], (30, 5, 1)])
    with pytest.raises(RuntimeError, match="more than 10 paths of 2 hops"):
        graph.best_paths(e, 0, 5, F.col("weight"), 4, beam=10)
    assert [(r["score"], r["hops"]) for r in graph.best_paths(e, 0, 5, F.col("weight"), 4).collect()] == [(4.0, 4)]


def test_longest_chain_behind_many_prefixes(spark):
    # 5,200 shorter paths come before it in the order of ids
    e = edges(spark, [(0, 1, 1), *[(1, k, 1) for k in range(10, 5210)], (9000, 9001, 1), (9001, 9002, 1), (9002, 9003, 1)])
    assert [(r["length"], r["path"]) for r in graph.longest_chains(e, nodes(spark, 9004), 3).collect()] == [(4, [9000, 9001, 9002, 9003])]


def test_page_parts(spark):
    from tessera.operators.catalogue import page_parts

    html = "<html><head><title> A &amp; B </title><script>var x = '<h1>no</h1>';</script></head><body><nav><a href='/skip'>s</a></nav><h1>One <b>two</b></h1><p>Text &lt;here&gt;</p><!-- <h2>gone</h2> --><a href='/x'>link</a><pre>code  1</pre></body></html>"
    r = page_parts(spark.createDataFrame([(1, html), (2, "")], "page_id long, html string")).orderBy("page_id").collect()
    assert (r[0]["title"], r[0]["headings"], r[0]["links"], r[0]["code_blocks"]) == ("A & B", ["One two"], ["/x"], ["code 1"])
    assert r[0]["text"] == "One two Text <here> link code 1"
    assert (r[1]["title"], r[1]["headings"], r[1]["text"]) == ("", [], "")


def test_markdown_section(spark):
    body = "# T\n## Notes\nfirst\nsecond\n## More notes here\nthird\n"
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(t.markdown_section(F.col("b"), "notes")).first()[0] == "first\nsecond"
    assert df.select(t.markdown_section(F.col("b"), "here")).first()[0] == "third"
    assert df.select(t.markdown_section(F.col("b"), "absent")).first()[0] is None


def test_topics_join_rows_through_rare_words(spark):
    rows = spark.createDataFrame(
        [(1, ["bolt", "hub"]), (2, ["bolt", "gear", "hub"]), (3, ["gear", "gear"]), (4, ["hub"]), (5, []), (6, None), (7, ["lone", "hub"]), (8, ["hub"])], "id long, words array<string>"
    )
    got = {r["id"]: r["topic"] for r in graph.topic_clusters(rows, hub_share=0.3).collect()}
    # "hub" stands in five of eight rows and joins nothing
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}


def test_timers_fire_without_a_later_row(spark):
    rows = [(1, 1, "start", 0), (1, 2, "stop", 30), (2, 3, "start", 0), (3, 4, "start", 10), (3, 5, "seen", 70), (4, 6, "start", 90), (5, 7, "start", 0), (5, 8, "stop", 60), (6, 9, "other", 100)]
    m = spark.createDataFrame(rows, "agent_id long, id long, type string, at long").withColumn("ts", F.timestamp_seconds("at"))
    got = {r["id"]: r["status"] for r in monitors.timer_log(m, {"start": 60}, "stop", "seen").collect()}
    # a stop at the very end comes too late
    assert got == {1: "cancelled", 3: "fired", 4: "acknowledged", 6: "active", 7: "fired"}


def test_unanswered_messages_are_retried_then_lost(spark):
    rows = [(1, "t", "sent", 0), (1, "t", "ack", 25), (2, "t", "sent", 0), (3, "t", "sent", 95), (4, "t", "sent", 0), (4, "t", "ack", 90), (5, "t", "other", 100)]
    m = spark.createDataFrame(rows, "agent_id long, team string, type string, at long").withColumn("ts", F.timestamp_seconds("at"))
    r = monitors.ack_statistics(m, "sent", "ack", 10, retries=3).first()
    assert (r["sent"], r["acknowledged"], r["failed"], r["pending"], r["retries"], r["mean_seconds"]) == (4, 1, 2, 1, 8, 25.0)


def test_path_reliability_is_the_product_of_its_hops(spark):
    e = spark.createDataFrame([(0, 1, 10, 0.9), (1, 2, 10, 0.4), (0, 2, 1, 0.9), (2, 3, 5, None)], "src long, dst long, weight int, success double")
    got = {r["node"]: (r["cost"], r["reliability"], r["risky_hops"]) for r in graph.failure_aware(e, spark.range(1)).collect()}
    assert got == {0: (0.0, 1.0, 0), 1: (0.111111, 0.9, 0), 2: (0.361111, 0.36, 1), 3: (0.611111, 0.288, 1)}
