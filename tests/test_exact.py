"""Order statistics, phrase search by positions and failure injection against plain loops."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, failures, positions, ranks


def _values(rng, n):
    return [round(rng.paretovariate(1.0), 2) if rng.random() < 0.7 else 1.5 for _ in range(n)]


def test_percentiles_of_groups_of_any_size(spark):
    rng = random.Random(5)
    groups = {"hot": _values(rng, 5000), "small": _values(rng, 7), "one": [3.0], None: _values(rng, 40), "ties": [2.0] * 90}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("empty", None)]
    got = {r["g"]: r for r in aggregates.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", (0, 50, 99, 100)).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        assert [got[g][f"p{p}"] for p in (0, 50, 99, 100)] == [vs[min(len(vs) * p // 100, len(vs) - 1)] for p in (0, 50, 99, 100)]
        assert (got[g]["n"], got[g]["least"], got[g]["most"]) == (len(vs), vs[0], vs[-1])
        assert math.isclose(got[g]["mean"], sum(vs) / len(vs), abs_tol=1e-6)


def test_one_group_is_many_ranges(spark):
    rows = spark.range(40_000).select(F.lit("all").alias("g"), (F.col("id") * 7919 % 40_009).alias("v")).unionByName(spark.range(40_000).select(F.lit("all").alias("g"), F.lit(5).cast("long").alias("v")))
    counts = ranks.counted_values(rows, "g", "v", 16)
    sizes = sorted(r["count"] for r in counts.groupBy("range").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    values = sorted([i * 7919 % 40_009 for i in range(40_000)] + [5] * 40_000)
    got = ranks.at_ranks(counts, "g", "v", {"low": F.lit(6), "mid": F.floor(F.col("n") / 2), "none": F.col("n")}).first()
    assert (got["n"], got["low"], got["mid"], got["none"]) == (80_000, values[6], values[40_000], None)


def test_no_values(spark):
    assert aggregates.exact_percentiles(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def _stands(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def test_phrases_stand_where_a_scan_finds_them(spark):
    rng = random.Random(2)
    docs = {i: [rng.choice("the the the of a b c d e".split()) for _ in range(rng.randint(0, 60))] for i in range(150)}
    docs[7] = ["the"] * 400
    phrases = {0: ["the"], 1: ["the", "the"], 2: ["the", "of", "the"], 3: ["a", "b"], 4: ["nowhere", "the"], 5: [], 6: None, 7: ["the", "of", "the", "a"], 8: docs[3][:9], 9: ["of", "the"], 10: ["of", "the"]}
    df = spark.createDataFrame([*docs.items(), (999, None)], "id long, words array<string>")
    index = positions.positional_postings(df, "id", F.col("words"))
    got = sorted(map(tuple, positions.phrase_hits(index, spark.createDataFrame(list(phrases.items()), "query int, words array<string>")).collect()))
    want = [(q, i, len(at), at[0]) for q, p in phrases.items() if p for i, w in docs.items() if (at := _stands(w, p))]
    assert got == sorted(want)
    none = spark.createDataFrame([], "query int, words array<string>")
    assert positions.phrase_hits(index, none).count() == 0
    assert positions.phrase_hits(positions.positional_postings(df.filter("id < 0"), "id", F.col("words")), none).count() == 0


def test_phrases_in_one_pass(spark):
    """As from the index: repeated phrases and words, lengths from one to nine, words that no document has, null words, texts and phrases."""
    rng = random.Random(5)
    docs = {i: [rng.choice(["the", "the", "of", "a", "b", None]) for _ in range(rng.randint(0, 60))] for i in range(80)} | {7: ["the"] * 400}
    phrases = {0: ["the"], 1: ["the", "the"], 2: ["the", "of", "the"], 3: ["nowhere", "the"], 4: [], 5: None, 6: ["a", None], 7: ["the"] * 9, 8: ["of", "the"], 9: ["of", "the"]}
    df = spark.createDataFrame([*docs.items(), (999, None)], "id long, words array<string>")
    got = positions.scanned_hits(df, "id", F.col("words"), spark.createDataFrame(list(phrases.items()), "query int, words array<string>")).collect()
    assert sorted(map(tuple, got)) == sorted((q, i, len(at), at[0]) for q, p in phrases.items() if p and None not in p for i, w in docs.items() if (at := _stands(w, p)))
    assert positions.scanned_hits(df, "id", F.col("words"), spark.createDataFrame([], "query int, words array<string>")).count() == 0


def _hops(edges, start, end, hops, without=None):
    seen, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for a, b in edges:
            if a == x and b not in seen and (a, b) != without:
                seen[b] = seen[x] + 1
                todo.append(b)
    return seen[end] if end in seen and seen[end] <= hops else None


@pytest.mark.parametrize("seed,n,m,hops", [(1, 12, 20, 5), (2, 15, 24, 3), (3, 10, 14, 6), (4, 9, 40, 4)])
def test_failures_of_all_edges(spark, seed, n, m, hops):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(25)]
    rows = [*edges, *list(edges)[:3], (None, 1)]
    e, p = spark.createDataFrame(rows, "src long, dst long"), spark.createDataFrame([*pairs, (None, 2)], "start long, target long")
    edges = {(a, b) for a, b in edges if a != b}
    asked = set(pairs) | {(None, 2)}
    want = {}
    for edge in edges:
        broken = longer = 0
        for s, t in set(pairs):
            base = _hops(edges, s, t, hops)
            after = _hops(edges, s, t, hops, edge)
            broken += base is not None and after is None
            longer += base is not None and after is not None and after > base
        want[edge] = (broken, longer, round(100 * (broken + 0.5 * longer) / len(asked), 4))
    got = {(r["src"], r["dst"]): (r["broken"], r["longer"], r["criticality"]) for r in failures.failure_injection(e, p, hops).collect()}
    assert got == want
    if seed == 1:
        direct = {(r["src"], r["dst"]): r["after"] for r in failures.direct_detours(e, spark.range(6), hops).collect()}
        assert direct == {(a, b): _hops(edges, a, b, hops, (a, b)) for a, b in edges if a < 6}


def test_nothing_to_break(spark):
    e, p = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(1, 2)], "start long, target long")
    assert failures.failure_injection(e, p).count() == 0
