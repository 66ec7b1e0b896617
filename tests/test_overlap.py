"""Set-overlap joins against all pairs, with a tag on most rows, ties, repeated rows, nulls and small tiles."""

import itertools
import random

import pytest

from tessera.operators import overlap

SCHEMA = "entry_id long, tag string"


def _sets(seed, entries=120, largest=14):
    rng = random.Random(seed)
    sets = {i: {f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(1, largest))} for i in range(entries)}
    for i in range(0, entries, 2):
        sets[i] |= {"hot", "hot too"}  # two tags that half of all entries share
    sets[entries] = {"alone"}
    for i in range(5):  # copies of one large set
        sets[1000 + i] = {f"t{k}" for k in range(40)} | {"hot"}
    return sets


def _rows(sets):
    rows = [(i, t) for i, s in sets.items() for t in sorted(s)]
    return [*rows, *rows[:7], (None, "hot"), (3, None)]


@pytest.mark.parametrize("block", [overlap.BLOCK, 7])
@pytest.mark.parametrize("top", [1, 5])
def test_most_related_equals_all_pairs(spark, block, top):
    sets = _sets(top)
    got = {(r["a"], r["rank"]): (r["b"], r["shared"]) for r in overlap.most_related(spark.createDataFrame(_rows(sets), SCHEMA), top, block).collect()}
    want = {}
    for a in sets:
        best = sorted(((-len(sets[a] & sets[b]), b) for b in sets if b != a and sets[a] & sets[b]))[:top]
        want |= {(a, k): (b, -n) for k, (n, b) in enumerate(best, 1)}
    assert got == want


@pytest.mark.parametrize("least,block", [(1, 7), (2, overlap.BLOCK), (2, 7), (9, 7)])
def test_shared_tag_pairs_equal_all_pairs(spark, least, block):
    sets = _sets(3)
    got = sorted(map(tuple, overlap.shared_tag_pairs(spark.createDataFrame(_rows(sets), SCHEMA), least, block).collect()))
    assert got == sorted((a, b, n) for a, b in itertools.combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) >= least)


def test_nothing_to_join(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert overlap.most_related(nothing).count() == overlap.shared_tag_pairs(nothing).count() == 0
