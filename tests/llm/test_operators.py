"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, jaccard, licenses, linededup, lm, mixing, packing, quality, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, n_lines long"
LINE = "this line stands in more documents than it should do"


def _texts():
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "Ünder", "zeta,", "eta.", "theta", "iota", "kappa", "la", "mu"]
    make = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    texts = [make(int(n)) for n in rng.integers(1, 120, 30)]
    base = make(100).split()
    for k in range(6):  # near copies
        near = list(base)
        near[k * 7] = f"word{k}"
        texts.append(" ".join(near))
    texts += [texts[0], texts[1], f"{LINE}\nown line", *[f"{LINE.upper()}  \nline {i}\n  {LINE}" for i in range(6)]]
    texts += [None, "", " \n\t", "one", "x " * 3000, "under the MIT license, and again under the mit license. CC BY-NC 4.0", make(60) + "\n" + LINE]
    return texts


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "en" if i % 2 else None, ["b", "a", None, "c"][i % 4], None, 0.5, 1, 7) for i, t in enumerate(_texts())]
    return [*found, found[3], found[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_empty_tables(nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (lm.score_corpus(nothing), linededup.line_dedup_digest(nothing), sharding.shard_documents(nothing), toxicity.toxicity(nothing, labels), fingerprints.fingerprint_documents(nothing), mixing.mix_documents(nothing), licenses.scan_licenses(nothing), jaccard.jaccard_components(nothing), quality.quality_rules(nothing), packing.pack_documents(nothing)):
        assert out.count() == 0


def test_lm_base_and_gain(docs, rows):
    got = lm.score_corpus(docs, lm.Settings(own_classes=8, ending_classes=4, head=5, batches=40, shares=2)).collect()
    assert len(got) == len(rows)
    train = collections.Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([w.lower() for w in words(t)] + [b""])
    total, distinct = sum(train.values()), len(train)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        tokens = [w.lower() for w in words(texts[r["doc_id"]])] + [b""]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[w] > 0 for w in tokens), total)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens), rel_tol=1e-6)
        assert r["score"] <= 0


def test_lm_scores_by_hand(docs, rows):
    """Class probabilities of the network, and the words' shares of their classes, worked out per token."""
    s = lm.Settings(own_classes=8, ending_classes=4, head=5, batches=40, shares=2)
    model, _ = lm.train(docs, settings=s)
    again, _ = lm.train(docs.repartition(7), settings=s)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(model.params, again.params))
    train = collections.Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([w.lower() for w in words(t)] + [b""])
    cls = model.classes()
    of = lambda w: cls.own.get(w, cls.by_ending.get(w[-3:], cls.rest))
    total, distinct = collections.Counter(), collections.Counter()
    for w, c in train.items():
        total[of(w)] += c
        distinct[of(w)] += 1
    net = lm.LogBilinear(cls.count, s.dims, np.ones(cls.count), 1)
    net.set(model.params)
    got = {r["doc_id"]: r["score"] for r in lm.score_corpus(docs, s).collect()}
    for i, t, *_ in rows[::3]:
        before, want = [cls.count, cls.count], 0.0
        for w in [x.lower() for x in words(t)] + [b""]:
            scores = net.context(np.array(before[1:]), np.array(before[:1]))[0] @ net.out.T + net.bias
            want += math.log10(np.exp(scores[of(w)] - scores.max()) / np.exp(scores - scores.max()).sum())
            if of(w) >= len(cls.own):
                want += math.log10((train[w] + 0.5) / (total[of(w)] + 0.5 * (distinct[of(w)] + 1)))
            before = [before[1], of(w)]
        assert math.isclose(got[i], want, rel_tol=1e-3, abs_tol=1e-3), i


def test_lm_probabilities_sum_to_one():
    net = lm.LogBilinear(7, 4, np.full(7, 1 / 7), 1)
    p = np.exp(net.log_probs(np.arange(8), np.arange(8)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def lines_by_hand(rows, least=5):
    strip = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(strip(line)) >= 40:
                holders[strip(line)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(holders.get(strip(x), ())) >= least and i < max(holders[strip(x)]))]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def digests(kept):
    return sorted(map(tuple, kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).collect()))


@pytest.mark.parametrize("keys, pairs", [(linededup.BROADCAST_KEYS, linededup.BROADCAST_PAIRS), (0, 0), (linededup.BROADCAST_KEYS, 0)])
def test_line_dedup(docs, rows, keys, pairs):
    assert digests(linededup.dedup_lines(docs.select("doc_id", "text", "n_lines"), broadcast_keys=keys, broadcast_pairs=pairs)) == lines_by_hand(rows)


def test_hot_lines_are_joined_apart(spark, docs, tmp_path):
    index = linededup.LineIndex(spark, f"file://{tmp_path}/lines")
    index.insert(docs)
    asked = linededup.known_lines(docs, index)
    part = lambda hot: sorted((r["doc_id"], sorted(map(bytes, r["keys"]))) for r in linededup.lines_to_drop(asked, index.active, hot).collect())
    assert part(0) == part(6) == part(10**9) and len(part(0)) >= 6
    salted = linededup.lines_to_drop(asked, index.active, 0, broadcast_hot=0, salts=3)
    assert sorted((r["doc_id"], sorted(map(bytes, r["keys"]))) for r in salted.collect()) == part(0)


@pytest.mark.parametrize("keys", [linededup.BROADCAST_KEYS, 0])
def test_deleted_documents_are_forgotten(spark, docs, rows, keys, tmp_path):
    index = linededup.LineIndex(spark, f"file://{tmp_path}/lines", min_docs=4, shard_refs=5)
    others = [f"{k} is a line that only four documents of this kind hold" for k in range(6)]
    more = spark.createDataFrame([(1000 + n, "\n".join(others)) for n in range(4)], "doc_id long, text string")
    everything = docs.select("doc_id", "text").unionByName(more)
    index.insert(docs)
    index.insert(more)
    all_rows = [*rows, *[(r["doc_id"], r["text"]) for r in more.collect()]]
    assert digests(linededup.drop_lines(everything, index, keys)) == lines_by_hand(all_rows, 4)
    key = [linededup.line_key(x.encode(), 40) for x in others]
    known = lambda: linededup.maybe(key, {r["shard"]: linededup.CuckooFilter.from_bytes(bytes(r["filter"])) for r in index.filters.collect()}, index.shards)
    assert len(known()) == 6
    # Without the largest holder, another one keeps the lines; without a second one, no line of these is repeated any more.
    gone = more.filter("doc_id = 1003")
    index.delete(gone)
    assert known() == []
    left = everything.filter("doc_id <> 1003")
    assert digests(linededup.drop_lines(left, index, keys)) == lines_by_hand([r for r in all_rows if r[0] != 1003], 4)
    holders = docs.filter(F.col("text").contains(LINE) | F.col("text").contains(LINE.upper()))
    index.delete(holders.filter("doc_id % 2 = 0"))
    some = {r[0] for r in holders.filter("doc_id % 2 = 0").select("doc_id").collect()}
    assert some
    assert digests(linededup.drop_lines(left.filter(~F.col("doc_id").isin(some)), index, keys)) == lines_by_hand([r for r in all_rows if r[0] != 1003 and r[0] not in some], 4)


def _held(index):
    return {(bytes(r["key"]), r["n_docs"], r["max_doc"]) for r in index.active.collect()}


def test_unknown_deletions_leave_no_debt(spark, tmp_path):
    line = "a line of more than forty characters that five documents hold"
    made = lambda *ids: spark.createDataFrame([(i, line) for i in ids], "doc_id long, text string")
    index = linededup.LineIndex(spark, f"file://{tmp_path}/lines")
    index.delete(made(4))  # an empty index
    index.insert(made(0, 1, 2, 3))
    index.delete(made(4))
    assert _held(index) == set()
    index.insert(made(4))
    key = linededup.line_key(line.encode(), 40)
    assert _held(index) == {(key, 5, 4)}
    index.delete(made(4, 4, 4))  # more often than it stands
    assert _held(index) == set()
    index.insert(made(4))
    assert _held(index) == {(key, 5, 4)}


def test_index_is_opened_again_and_changes_touched_shards_alone(spark, tmp_path):
    folder, lines = f"file://{tmp_path}/lines", [f"line {k:03d} that all five documents of the first half hold" for k in range(60)]
    first = spark.createDataFrame([(i, "\n".join(lines)) for i in range(5)], "doc_id long, text string")
    index = linededup.LineIndex(spark, folder, shard_refs=20)
    index.insert(first)
    assert index.shards == 15 and index.n_active == 60
    other = spark.newSession()
    again = linededup.LineIndex(other, folder, shard_refs=20)
    assert (again.changes, again.shards, again.parts) == (1, 15, index.parts) and _held(again) == _held(index)
    # One line of a new document touches one shard; only that one's files are read and written.
    more = other.createDataFrame([(9, lines[7])], "doc_id long, text string")
    key = linededup.line_key(lines[7].encode(), 40)
    own = zlib.crc32(key) % 15
    again.insert(more)
    assert {s for s, p in again.parts.items() if p != index.parts[s]} == {own}
    assert all(f"dir={own}/" in f for f in again._held("refs", "key binary", {own}).inputFiles())
    assert (key, 6, 9) in _held(again) and len(_held(again)) == 60
    again.delete(more)
    assert _held(linededup.LineIndex(spark, folder)) == _held(index)
    with pytest.raises(ValueError):
        linededup.LineIndex(spark, folder, min_docs=4)
    # Twice as many references deal the shards anew.
    third = linededup.LineIndex(spark, folder, shard_refs=5)
    third.insert(spark.createDataFrame([(20, "\n".join(lines))], "doc_id long, text string"))
    assert third.shards == 72 and {(n, m) for _, n, m in _held(third)} == {(6, 20)} and len(_held(third)) == 60


@pytest.mark.parametrize("keys", [linededup.BROADCAST_KEYS, 0])
def test_rows_without_id_lose_lines_by_their_texts(spark, keys):
    line = "a line of more than forty characters that many documents hold"
    made = [(i, f"{line}\nown {i}") for i in range(5)] + [(None, f"{line}\nnameless {k}") for k in range(3)] + [(None, f"{line}\nnameless 0"), (None, None), (None, "short")]
    got = linededup.dedup_lines(spark.createDataFrame(made, "doc_id long, text string"), broadcast_keys=keys, broadcast_pairs=0 if keys == 0 else 100)
    want = [(i, f"own {i}", 1) for i in range(4)] + [(4, f"{line}\nown 4", 0)] + [(None, f"nameless {k}", 1) for k in (0, 0, 1, 2)] + [(None, "", 0), (None, "short", 0)]
    assert sorted((str(r["doc_id"]), r["text"] or "", r["n_dropped"]) for r in got.collect()) == sorted((str(i), x, n) for i, x, n in want)


def test_cuckoo_filter_has_no_false_negatives():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    f = linededup.CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.contains(keys + np.uint64(1)).mean() < 0.01
    gone = keys[:1000]
    assert all(f.delete(int(k)) for k in gone)
    assert f.contains(keys[1000:]).all() and f.contains(gone).mean() < 0.01


def test_sharding(docs, rows, spark):
    import duckdb

    got = sharding.shard_documents(docs, rows_per_bucket=7).collect()
    assert len(got) == len(rows)
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        b = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 1, zlib.crc32(b), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    want = {(a, c, d) for a, _, c, d in con.sql(sharding.shards_only_sql()).fetchall()}
    assert {(r["doc_id"], r["shard"], r["grown_shard"]) for r in got} == want


def test_growth_moves_rows_into_the_new_shard_alone(spark):
    tree = sharding.base_tree()
    for _ in range(3):
        bigger = sharding.grow(tree)
        new = max(s.number for racks in bigger.values() for shards in racks.values() for s in shards)
        x = spark.range(3000).select(sharding.shard_column(F.col("id"), tree).alias("a"), sharding.shard_column(F.col("id"), bigger).alias("b"))
        moved = x.filter("a <> b")
        assert moved.filter(F.col("b") != new).count() == 0 and abs(moved.count() / 3000 - 1 / (new + 1)) < 0.05
        tree = bigger


def test_toxicity_tolerates_gaps(spark):
    rng = np.random.default_rng(5)
    syl = ["ba", "lo", "ri", "mu", "te", "no", "ka", "si"]
    word = lambda: "".join(syl[i] for i in rng.integers(0, 8, 3))
    texts = [" ".join(word() for _ in range(30)) for _ in range(240)]
    toxic = [int(i % 3 == 0) for i in range(240)]
    texts = [t + (" you wretchq and grumblx" if y else "") for t, y in zip(texts, toxic)]
    model = toxicity.fit(texts, toxic)
    clean = " ".join(word() for _ in range(30))
    p = toxicity.Scorer(model).scores(list((clean, clean + " wretchq grumblx", clean + " w.r.e.t.c.h.q gruzmblx wretchqs", "")))
    assert p[0] < 0.3 and p[1] > 0.3 and p[2] > 0.3 and p[3] < 0.3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(240) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_subsequence_kernel_by_hand():
    # car and cat share the gapped pairs c-a only: decay^4 with order 2
    a, b = toxicity._codes(["car"], -1), toxicity._codes(["cat"], -2)
    assert math.isclose(float(toxicity.subsequence_kernel(a, b, 2, 0.5)[0]), 0.5**4, rel_tol=1e-6)


def kernel_by_hand(a, b, order, decay):
    """All pairs of equal subsequences, weighted by their spans."""
    import itertools

    parts = lambda w: [("".join(w[i] for i in at), decay ** (at[-1] - at[0] + 1)) for at in itertools.combinations(range(len(w)), order)]
    return sum(p * q for x, p in parts(a) for y, q in parts(b) if x == y)


def test_toxicity_landmarks_are_not_a_languages_own():
    """A language with more toxic labels than another one: only its toxic stem is a mark, not fragments that stand by chance in more of its toxic documents."""
    rng = np.random.default_rng(3)

    def document(syllables, stem, usual):
        words = {f"^{''.join(syllables[i] for i in rng.integers(0, len(syllables), 3))}$" for _ in range(int(rng.integers(20, 60)))}
        return words | {f"^{u}$" for u in usual if rng.random() < 0.9} | ({f"^{stem}{syllables[i]}$" for i in rng.integers(0, len(syllables), 2)} if stem else set())

    one, two = ["ba", "lo", "ri", "mu", "te", "no", "ka", "si"], [a + b for a in "cdfghjkl" for b in "aeiou"]
    bad = [document(one, "wretchq", ["thon", "ofa"]) for _ in range(30)] + [document(two, "snarfl", ["loso", "uela"]) for _ in range(90)]
    good = [document(one, "", ["thon", "ofa"]) for _ in range(300)] + [document(two, "", ["loso", "uela"]) for _ in range(45)]
    marks = toxicity.pick_landmarks(bad, good, 24)
    assert any("wretchq" in m for m in marks) and any("snarfl" in m for m in marks)
    assert all("wretchq" in m or "snarfl" in m for m in marks)


def test_toxicity_scores_by_hand():
    """Kernels, margins and scores of a fitted model, from their definitions."""
    rng = np.random.default_rng(9)
    word = lambda: "".join("baloritenk"[i] for i in rng.integers(0, 10, 5))
    texts = [" ".join(word() for _ in range(12)) + ("." if i % 2 else "\n") + " ".join(word() for _ in range(50)) + (" snarfle" if i % 4 == 0 else "") for i in range(120)]
    s = toxicity.Settings()
    model = toxicity.fit(texts, [int(i % 4 == 0) for i in range(120)], s)
    marks = ["".join(chr(c) for c in row if c >= 0) for row in model.kernels.marks]
    assert any("snarfle" in m for m in marks)

    def margin(w):
        w, k = f"^{w}$", []
        for m in marks:
            pairs = sum({m[i : i + 2] for i in range(len(m) - 1)}.__contains__(w[i] + w[i + g]) for g in (1, 2) for i in range(len(w) - g))
            norm = math.sqrt(kernel_by_hand(w, w, s.order, s.decay) * kernel_by_hand(m, m, s.order, s.decay))
            k.append(kernel_by_hand(w, m, s.order, s.decay) / norm if pairs >= 2 else 0.0)
        return float(np.dot(k, model.weights) + model.bias)

    for text in [*texts[:6], "snarfle", "snarxfle and more", "", "one"]:
        worst = []
        for line in text.lower().split("\n"):
            sentences = [[]]
            for w in line.split():
                sentences[-1].append(w)
                if w[-1] in ".!?" or len(sentences[-1]) == 40:
                    sentences.append([])
            worst += [max(margin(w.strip(".")) for w in x) for x in sentences if x]
        top = np.clip((sorted(worst, reverse=True) + [toxicity.FLOOR] * 3)[:3], toxicity.FLOOR, -toxicity.FLOOR)
        z = np.dot(np.cumsum(top) / [1, 2, 3], model.logistic[:3]) + model.logistic[3]
        assert math.isclose(toxicity.Scorer(model).scores([text])[0], 1 / (1 + math.exp(-z)), rel_tol=1e-3, abs_tol=1e-4)


def test_a_machine_is_trained_on_few_labels():
    texts = ["you are a grumblewort today", "what a grumblewort that is", "a fine day it was", "rain in the morning", "trees along the road"]
    model = toxicity.fit(texts, [1, 1, 0, 0, 0])
    p = toxicity.Scorer(model).scores(["such a grumblewort here", "such a fine morning here"])
    assert model.kernels is not None and p[0] > p[1]


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    byid = sorted(rows, key=lambda r: r[0])
    want = collections.Counter()
    for k, (i, t, *_) in enumerate(byid):
        t, nxt = t or "", byid[(k + 1) % len(byid)][1] or ""
        n = len(t)
        want[i, n, hashlib.sha256((t[: n - n // 4] + nxt[: n // 4]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = collections.defaultdict(set)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        by_text[texts[r["doc_id"]] or ""].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(f) == 1 for f in by_text.values())
    assert by_text[""] == {""}


def test_sketches_merge_and_contain(spark):
    rng = np.random.default_rng(4)
    words_ = [f"w{i}" for i in rng.integers(0, 5000, 3000)]
    cut = 1500
    a, b, both = " ".join(words_[: cut + 4]), " ".join(words_[cut:]), " ".join(words_)
    r = spark.createDataFrame([(a, b, both)], "a string, b string, both string").select(
        fingerprints.merge(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("m"),
        fingerprints.sketch(F.col("both")).alias("s"),
        fingerprints.containment(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("both"))).alias("c"),
        fingerprints.containment(fingerprints.sketch(F.col("both")), fingerprints.sketch(F.col("a"))).alias("d"),
        fingerprints.containment(fingerprints.sketch(F.lit("")), fingerprints.sketch(F.col("a"))).alias("e"),
    ).first()
    assert r["m"] == r["s"] and r["c"] == 1.0 and abs(r["d"] - 0.5) < 0.1 and r["e"] == 1.0


def test_mixing(docs, rows):
    got = mixing.mix_documents(docs, rows_per_bucket=5).collect()
    assert len(got) == len(rows)
    total = sum(len(words(t)) for _, t, *_ in rows)
    assert sum(r["taken"] for r in got) == total
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 64 * 4
        assert own[0]["target"] <= 3 * own[0]["source_size"] + 1e-9
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix_documents(docs.repartition(5), rows_per_bucket=9).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))


def test_targets_share_what_a_source_cannot_use(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(s).collect()}
    assert got["b"] == 30 and math.isclose(got["a"], 1480 / 4) and math.isclose(got["c"], 1480 * 3 / 4)


def test_licenses(docs, rows):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        hits = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(","))


def test_matching_statistics_by_hand():
    a = licenses.SuffixAutomaton([[1, 2, 3, 4], [3, 4, 5]])
    assert [(end, n) for end, n, _ in a.matches([9, 2, 3, 4, 5, 1, 2], 0, 2)] == [(4, 3), (5, 3), (7, 2)]
    s = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES, licenses.Rules())
    text = b"x y This program is free software: you can redistribute it and/or alter it under the terms of the GNU General Public License as published by the Free Software Foundation z"
    n, base, _, _, _, labels, score, spans = s.scan(text)
    twice = s.scan(text + b" and once more: " + text)[7]
    assert [x[0] for x in twice] == ["gpl", "gpl"] and twice[0][2] <= twice[1][1]
    assert "gpl" in labels and base == 0 and 0.6 <= score <= 1 and spans[0][0] == "gpl"


def components_by_hand(rows):
    sets, par = {}, {}
    for i, t, *_ in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        par[i] = i

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                par[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("tile", [jaccard.TILE, 300])
def test_jaccard_components(docs, rows, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_by_hand(rows)


def test_signature_tree_spans_all_links():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        for k in range(int(rng.integers(1, 9))):
            x = base.copy()
            x[: int(rng.integers(0, 14))] = rng.integers(0, 2**63, 1)[0]
            sets.append(np.unique(x))
    par = list(range(len(sets)))

    def root(p, x):
        while p[x] != x:
            x = p[x]
        return x

    plain = [set(s.tolist()) for s in sets]
    for a in range(len(sets)):
        for b in range(a):
            both = len(plain[a] & plain[b])
            if 100 * both >= 75 * (len(plain[a]) + len(plain[b]) - both):
                par[root(par, a)] = root(par, b)
    mine = list(range(len(sets)))
    for a, b in jaccard.tree_links(sets):
        mine[root(mine, a)] = root(mine, b)
    part = lambda p: {frozenset(i for i in range(len(sets)) if root(p, i) == r) for r in map(lambda x: root(p, x), range(len(sets)))}
    assert part(par) == part(mine)


def test_quality_counts(docs, rows):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    for r in got:
        t = texts[r["doc_id"]]
        w = [x.decode() for x in words(t)]
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, rows_per_bucket=5).collect()
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x, *_ in rows}
    covered = collections.Counter()
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
    times = collections.Counter(r[0] for r in rows)
    assert all(covered[i] == times[i] * len(ids[i]) for i in ids)
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    short = 0
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
        short += end < 1024
    assert short <= 1


def test_word_encoder_equals_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ("", " ", "a", " a b", "a  b", "a \n b\n\nc ", "tab\tx y", "<|endoftext|>", " <|endoftext|> <|endoftext|>a", "see <|endoftext|> here", "a\n<|endoftext|>\n", "naïve café, it's 12345 <|endoftext|> ok", "don't  stop　now 東京 都", "x  y", "trailing "):
        assert e.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids, text
