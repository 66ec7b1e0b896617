"""Byte-pair coding against the tokenizers library; phrase mining and ranked search against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, phrases, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, score double, id long, word string"
EXTRA = (None, 5, 9, 0.5, 7, "w")
TABLE = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, *EXTRA[:1], *EXTRA[1:]) for i, t, lang in rows], SCHEMA).repartition(3)


def odd_texts():
    rng = random.Random(5)
    bits = ["a", "B", "'s", "'", "!", "é", "Σ", "İ", "ß", "日", "本", "\x1c", "\x85", "\xa0", " ", "  ", "\n", "<|endoftext|>", "<|EndOfText|>", "<", "́", "1", "²", "x" * 70, "qzxj", "😀", "�", "ا", "​"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [None, "", " \n", "one", *texts, texts[0], texts[0], "ab" * 3000, "日本語" * 2000, "word " * 50_000]


# --- byte-pair coding ---------------------------------------------------------------------------


def test_codec_as_the_library_has_it(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, t, None) for i, t in enumerate(odd_texts())] + [(3, "one", "x"), (None, "no id", None)]
    docs = frame(spark, rows)
    got = sorted(map(tuple, bpe.codec_digest(docs).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs).collect()}
    assert ids[2] == [] and ids[0] == [] and ids[4] == library.encode(rows[4][1], add_special_tokens=False).ids


def test_codec_on_the_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.codec_digest(docs).collect()}
    want = {r["doc_id"]: hashlib.sha256(np.array(library.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in docs.collect()}
    assert got == want


def test_code_points():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    points = [chr(x) for x in range(1, 0x110000) if not 0xD800 <= x < 0xE000]
    texts = ["".join(points[k : k + 2000]) for k in (*range(0, 40_000, 2000), *range(40_000, len(points), 34_000))] + [" ".join(points[k : k + 2000]) for k in range(0, 0x3000, 2000)]
    for text, ids in zip(texts, own.encode_all([t.encode() for t in texts])):
        assert library.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_no_token_spans_a_cut():
    """Cuts stand only where no token has the two bytes side by side, and long words are merged as short ones are."""
    import public_tokenizers

    own = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    parts, counts = own.fragments([b"qzjx", b"the", b"a", "日本".encode()])
    assert [b"".join(p for p, _ in parts[a:b]) for a, b in zip(np.cumsum([0, *counts]), np.cumsum(counts))] == [b"qzjx", b"the", b"a", "日本".encode()]
    assert [e for _, e in parts][counts[0] - 1] and counts[0] > 1 and counts[1] == 1
    rng = random.Random(1)
    for _ in range(200):
        part = bytes(rng.choice(b"abcdeinorst") for _ in range(rng.randint(1, 48)))
        symbols = own.middle[np.frombuffer(part, np.uint8)].tolist()
        assert np.frombuffer(own._merged([(part, False)])[0], "<u4").tolist() == own._merged_by_heap(symbols)


# --- phrases --------------------------------------------------------------------------------------


def brute_phrases(rows, least, share, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in (1, 2, 3, 4):
                for k in range(len(words) - size + 1):
                    f[lang, tuple(words[k : k + size])] += 1
    found = collections.defaultdict(list)
    frequent = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    held = collections.defaultdict(int)
    for (lang, p), a in frequent.items():
        for size in range(2, len(p)):
            for k in range(len(p) - size + 1):
                held[lang, p[k : k + size]] = max(held[lang, p[k : k + size]], a)
    for (lang, p), a in frequent.items():
        if 100 * held[lang, p] < share * a:
            score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return [(lang, k, p.decode(), -a, l, r, n[lang], -score) for lang, own in found.items() for k, (score, a, p, l, r) in enumerate(sorted(own)[:top], 1)]


def phrase_rows():
    rng = np.random.default_rng(2)
    words = ["alpha", "Beta", "gamma", "délta", "the", "of", "x\x01", "über"]
    make = lambda n: "".join(words[i] + [" ", "\t ", ", ", ".\n", " "][int(rng.integers(0, 5))] for i in rng.integers(0, len(words), n))
    rows = [(i, make(int(n)), ["en", None, "und", "de"][i % 4]) for i, n in enumerate(rng.integers(0, 90, 60))]
    rows += [(100 + i, "the same old story again", "en") for i in range(25)] + [(7, "twice twice twice", "xx")] * 9
    return [*rows, (200, None, "en"), (201, "", None), (202, "of the " * 40_000, "en"), (203, "z" * 100_000, "de"), (None, "the old the old", None)]


def test_phrases_by_brute_force(spark):
    rows, least, top = phrase_rows(), 6, 7
    got = phrases.mine_phrases(frame(spark, rows), least=least, top=top).collect()
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(brute_phrases(rows, least, 80, top))


def test_phrases_with_a_full_filter_and_clashing_ids(spark, monkeypatch):
    """A filter in which every bit is set prunes nothing and loses nothing; a seed under which two words share an id is given up."""
    rows, count = phrase_rows(), phrases.count_words
    monkeypatch.setattr(phrases, "frequent_filter", lambda hashes: ("full", b"\xff" * 8192))
    monkeypatch.setattr(phrases, "count_words", lambda docs, seed: count(docs, seed).withColumn("clash", F.lit(seed < 2)))
    got = phrases.mine_phrases(frame(spark, rows), least=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == sorted(brute_phrases(rows, 3, 80, 2000))


def test_clashes_are_seen(spark):
    rows = spark.createDataFrame([(1, "a", "en"), (2, "b", "en")], "doc_id long, text string, lang string")
    assert not phrases.count_words(rows, 0).filter("clash").count()


def test_filter_has_what_was_put_in(spark):
    hashes = np.unique(np.random.default_rng(1).integers(1, 2**63 - 1, 3000))
    _, bits = phrases.frequent_filter(spark.createDataFrame([(int(h),) for h in hashes], "id long"), 1 << 18)
    found = phrases.Frequent(np.frombuffer(bits, np.uint8))
    others = np.random.default_rng(2).integers(1, 2**63 - 1, 3000)
    assert len(bits) <= 1 << 15 and found.has(hashes).all() and found.has(others).mean() < 0.05


# --- ranked search ---------------------------------------------------------------------------------


def brute_search(docs, items, k):
    terms = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + (75 * sum(c.values()) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is not None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def search_rows():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)] + ["Ünder", "the", "THE", "it's", "x_y", "日本"]
    odds = 1 / np.arange(1, len(words) + 1)
    make = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    docs = [(i, make(int(n))) for i, n in enumerate(rng.integers(0, 80, 300))]
    docs += [(400 + i, docs[5][1]) for i in range(30)] + [docs[8], docs[8], (None, docs[9][1]), (500, None), (501, ""), (502, "w3 " * 60_000), (503, "w" * 200_000)]
    items = [(i, make(int(n))) for i, n in enumerate(rng.integers(0, 40, 25))] + [(50, docs[5][1]), (51, None), (52, "unheard"), (53, "w" * 200_000), (54, "w59 w59 w58"), (None, "w7 the")]
    return docs, items


@pytest.mark.parametrize("least, k, query_bytes", [(2048, 10, 1 << 22), (70, 3, 70_000)])
def test_search_by_brute_force(spark, monkeypatch, least, k, query_bytes):
    docs, items = search_rows()
    monkeypatch.setattr(ranked, "SEGMENT_DOCS", least)
    monkeypatch.setattr(ranked, "QUERY_BYTES", query_bytes)
    table = frame(spark, [(i, t, "en") for i, t in docs])
    asked = spark.createDataFrame([(i, t, 3, 4, 0.5) for i, t in items], "item_id long, text string, rank int, doc_id long, score double")
    got = sorted(map(tuple, ranked.search_documents(table, asked, k).collect()), key=str)
    assert got == sorted(brute_search(docs, items, k), key=str)


def test_search_skips_blocks():
    """Blocks that can't reach the k-th best score are not scored."""
    docs = [b"common rare" if k == 70 else b"common " * (1 + k % 3) for k in range(640)]
    numbers = {b"common": 0, b"rare": 1}
    n = np.array([len(d.split()) for d in docs], np.int64)
    at = np.array([*range(640), 70], "<i4")
    tf = np.array([d.split().count(b"common") for d in docs] + [1], "<i4")
    row = {"doc_ids": list(range(640)), "terms": b"common rare", "n": n.tobytes(), "df": np.array([640, 1], "<i4").tobytes(), "at": at.tobytes(), "tf": tf.tobytes()}
    segment, best = ranked.Segment(row, 640, int(n.sum())), ranked.Best(1)
    scored = []
    add = best.add
    best.add = lambda scores, docs, ids: (scored.append(len(scores)), add(scores, docs, ids))
    segment.search([(t, 50_000 if t == b"rare" else 1) for t in numbers], best)
    assert best.rows[0][2] == 70 and sum(scored) == 64
    assert b"rare" in segment.short and b"common" in segment.long


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert bpe.codec_digest(nothing).count() == phrases.mine_phrases(nothing).count() == ranked.search_documents(nothing, some).count() == 0
    docs = frame(spark, [(1, "a b", "en")])
    assert ranked.search_documents(docs, some.limit(0)).count() == 0
    assert ranked.search_documents(frame(spark, [(1, None, "en"), (2, "...", None)]), some).count() == 0
