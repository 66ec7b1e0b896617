"""Joins that must not make all pairs, against plain loops, with small parts so that each step has work."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalogue, linking, search, sequences


@pytest.mark.parametrize("witnesses, parts", [(1, (4, 1)), (3, (1,))])
def test_one_record_of_another_kind_is_enough(spark, monkeypatch, witnesses, parts):
    monkeypatch.setattr(linking, "WITNESSES", witnesses)
    monkeypatch.setattr(linking, "PARTS", parts)
    rng = random.Random(4)
    rows = [(f"{k}{i}", k, rng.sample([f"w{x}" for x in range(40)], rng.randint(0, 9)), "x" * rng.choice([3, 30])) for k in "abc" for i in range(40)]
    rows += [(f"copy{i}", "a", rows[0][2], "y" * 40) for i in range(5)]
    want = {}
    for i, kind, words, text in rows:
        kinds = len({k for _, k, w, _ in rows if k != kind and len(set(w) & set(words)) >= 4})
        want[i] = (kinds * 0.5, round((0.6 if len(text) < 20 else 1.0) * (1.2 if kinds + 1 >= 3 else 1.0), 4))
    got = linking.corroborated(spark.createDataFrame(rows, "id string, kind string, words array<string>, text string")).collect()
    assert {r["id"]: (r["corroboration"], r["weight"]) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("most", [2, 1_000])
def test_terms_are_counted_where_their_row_is(spark, monkeypatch, most):
    monkeypatch.setattr(search, "SENT_TERMS", most)
    docs = {1: ["a", "b", "a", "c"], 2: ["a", "d"], 3: [], 4: None, 5: ["b", "a", "e"]}
    df = spark.createDataFrame(list(docs.items()), "id long, w array<string>")
    terms = search.term_counts(df, "id", F.col("w"))
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["term"]): (r["tf"], r["length"], r["df"]) for r in search.with_documents(terms, search.term_documents(terms)).collect()}
    assert got == {(i, x): (n, len(w), sum(x in (v or []) for v in docs.values())) for i, w in docs.items() for x, n in Counter(w or []).items()}
    twice = search.term_counts(df.union(df), "id", F.col("w")).collect()
    assert sorted((r["id"], r["term"], r["tf"]) for r in twice) == sorted((i, x, 2 * v[0]) for (i, x), v in got.items())


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(search, "kept", lambda df, name="": written.append(name) or df)
    docs = spark.createDataFrame([(1, "one two two"), (2, "two"), (3, None)], "id long, a string")
    assert [r["id"] for r in search.bm25(docs, "id", {"a": 1.0}, ["two", "one"]).collect()] == [1, 2] and written == ["field-hits"]


@pytest.mark.parametrize("rows, blocks", [(3, 1), (1_000, 4)])
def test_greedy_cosine_groups_equal_the_loop(spark, monkeypatch, rows, blocks):
    monkeypatch.setattr(linking, "VECTOR_ROWS", rows)
    monkeypatch.setattr(linking, "LEAST_BLOCKS", blocks)
    rng = random.Random(3)
    docs = {i: [rng.choice("abcdefghij") for _ in range(rng.randint(1, 5))] for i in range(1, 25)}
    docs |= {i + 50: docs[i][::-1] for i in range(1, 25, 3)}
    df = Counter(w for words in docs.values() for w in set(words))
    vector = {i: {w: n / len(words) * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w, n in Counter(words).items()} for i, words in docs.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vector.items()}
    near = {(a, b) for a, b in itertools.combinations(sorted(docs), 2) if round(sum(x * vector[b].get(w, 0) for w, x in vector[a].items()) / norm[a] / norm[b], 6) >= 0.65}
    leaders = {}
    for i in sorted(docs):
        leaders[i] = next((j for j in sorted(leaders) if leaders[j] == j and (j, i) in near), i)
    given = spark.createDataFrame([*docs.items(), (99, [])], "id long, words array<string>")
    assert {(r["id"], r["leader"]) for r in linking.greedy_cosine_groups(given, 0.65).collect()} == set(leaders.items())


@pytest.mark.parametrize("group", [1, 3])
def test_groups_of_blocks_meet_all_pairs(spark, monkeypatch, group):
    from difflib import SequenceMatcher

    monkeypatch.setattr(sequences, "TILE_BLOCKS", group)
    monkeypatch.setattr(sequences, "BLOCK_ROWS", 2)
    rng = random.Random(6)
    texts = {i: "".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for i in range(40)}
    want = sorted((a, b, r) for a, b in itertools.combinations(texts, 2) if (r := SequenceMatcher(None, texts[a], texts[b]).ratio()) >= 0.7)
    assert sorted(map(tuple, sequences.sequence_ratio_pairs(spark.createDataFrame(list(texts.items()), "id long, text string"), 0.7).collect())) == want


def test_texts_are_rebuilt_after_one_shuffle(spark):
    rows = [(1, {"a": [0, 2], "b": [1]}), (2, {}), (3, {"c": []}), (4, {"x": [1]}), (4, {"y": [0]}), (5, None)]
    got = catalogue.rebuild_text(spark.createDataFrame(rows, "id long, positions map<string,array<int>>"), "id").collect()
    assert sorted(map(tuple, got)) == [(1, "a b a"), (4, "y x")]
    plan = catalogue.catalog.queries["source_inverted_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_cosine_pairs_deal_no_vector_to_every_block(spark, monkeypatch):
    """Vectors lie where they are written, and what is returned are the pairs alone, without a shuffle of vectors by pairs of blocks."""
    monkeypatch.setattr(linking, "VECTOR_ROWS", 3)
    monkeypatch.setattr(linking, "LEAST_BLOCKS", 3)
    docs = spark.createDataFrame([(k, [f"w{k % 4}", f"v{k % 2}"]) for k in range(8)], "id long, words array<string>")
    pairs = linking.cosine_pairs(docs, 0.65)
    assert "Exchange" not in pairs._jdf.queryExecution().toString()
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(k, k + 4) for k in range(4)}
