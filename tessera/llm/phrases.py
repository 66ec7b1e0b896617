"""Phrase collocations by stripes: each prefix keys an associative counter of its next words.

A task counts the stripes of its texts in arrays and sends them, summed by prefix, to the part of the key space they belong to; there
the stripes of one prefix are added elementwise. A merged stripe gives the extensions of its prefix (prefix and next word, with their
count), the prefix's total (all that follows it, ends of pieces and rare words too, kept under 0) and its largest extension, which tells
whether a longer phrase subsumes the prefix. Three rounds read the texts: single words (the stripe of the empty prefix), words by their
predecessor, and the third and fourth word by those before.

A phrase is at most as frequent as each part of it, so a round extends only what was frequent before; the rest can't be part of any
candidate. What was frequent goes to the tasks as a bit filter of stated size (FILTER_BITS at most): where
that is too small for a corpus, more is counted than needs be, and nothing is lost.

Words are held as 63-bit hashes of language and word; the first round, which has all words, makes sure that no two share one, or takes the
next seed. A stripe is dealt to up to SPLIT parts by its next words, so that the stripe of a word with any share of all rows
doesn't meet in one task; tasks send sums, never occurrences.

Defined cases: null and empty texts have no words; a null language is `und`, together with rows that say so; repeated rows count as often
as they stand; an empty table gives an empty result; further columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import KEPT_IN_WORKERS, parallelism, python_path, release, slices, trim, written

LEAST, SHARE, TOP = 30, 80, 2000
#: Bits of the largest filter of frequent phrases (16 MB), and bits for each phrase where fewer will do.
FILTER_BITS, BITS_EACH = 1 << 27, 24
#: Words that a task counts at a time; parts that one prefix may be dealt to; words of the corpus for each part.
WORDS_AT_ONCE, SPLIT, WORDS_PER_PART = 2_000_000, 8, 1_000_000
#: Bytes of text that are turned into Python words at a time, if they are of more than one document.
BYTES_AT_ONCE = 1 << 22

#: A-Z become lower case, separators of pieces full stops, tabs spaces.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9 + b" ")
_STRIPES = "part long, width int, prefixes binary, nexts binary, counts binary"


def _mixed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes, for filters and parts alone."""
    x = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ then.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Frequent:
    """A set of hashes as bits: what was put in is in; others may be by chance."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mixed(hashes, np.zeros(1, np.uint64))
        return (h & np.uint64(size - 1)).astype(np.int64), (h >> np.uint64(33) & np.uint64(size - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes, len(self.bits) * 8):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


_FILTERS: dict[str, Frequent] = {}
KEPT_IN_WORKERS.append(_FILTERS)


def _received(sent) -> Frequent:
    """The filter of a broadcast."""
    name, bits = sent.value
    if name not in _FILTERS:
        release(_FILTERS)
        _FILTERS[name] = Frequent(np.frombuffer(bits, np.uint8))
    return _FILTERS[name]


def frequent_filter(hashes: DataFrame, most_bits: int = FILTER_BITS) -> tuple[str, bytes]:
    """Name and bits of a filter of a column of hashes; never more than most_bits, whatever their number."""
    size = min(most_bits, max(1 << 16, 1 << (max(1, hashes.count()) * BITS_EACH - 1).bit_length()))
    chunk = size // 64

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(Frequent.places(batch.column(0).to_numpy(), size)))
            words, first = np.unique(at >> 6, return_index=True)
            if len(at):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], ["at", "bits"])

    def packed(rows: pa.Table) -> pa.Table:
        own, at = np.zeros(chunk // 64, np.uint64), rows.column("at").to_numpy()
        own[at % (chunk // 64)] = rows.column("bits").to_numpy().view(np.uint64)
        return pa.Table.from_arrays([pa.array([int(at[0]) // (chunk // 64)], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["chunk", "bits"])

    words = hashes.mapInArrow(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    chunks = words.groupBy(F.expr(f"at div {chunk // 64}").alias("k")).applyInArrow(packed, "chunk long, bits binary")
    found = {r["chunk"]: r["bits"] for r in chunks.collect()}  # at most 64 rows, together most_bits / 8 bytes
    bits = b"".join(found.get(k, bytes(chunk // 8)) for k in range(64))
    return hashlib.md5(bits).hexdigest(), bits


class Numbers(dict):
    """Words of one language by number; a new word takes the next number of all languages."""

    def __init__(self, counts: Counts) -> None:
        super().__init__({b".": 0})
        self.counts = counts

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.counts.known
        self.counts.known += 1
        return found


class Counts:
    """Texts as runs of word numbers, 0 between pieces, until take()."""

    def __init__(self, seed: int) -> None:
        self.seed, self.numbers, self.known, self.runs, self.count = seed, {}, 1, [], 0

    def add(self, lang: bytes, texts: list[bytes]) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = Numbers(self)
        # No other ASCII white space than the space is left, so split() cuts at spaces alone.
        tokens = b"\n".join([*texts, b""]).translate(_FOLD).replace(b".", b" . ").split()
        self.runs.append(np.fromiter(map(self.numbers[lang].__getitem__, tokens), np.int32, len(tokens)))
        self.count += len(tokens)

    def take(self, named: bool) -> tuple[dict[bytes, Numbers], np.ndarray, np.ndarray]:
        """The languages' words by number (if named), the words' hashes by number, and all runs end to end; then starts anew."""
        import xxhash

        of, seed, hashes = xxhash.xxh3_64_intdigest, self.seed, np.zeros(self.known, np.int64)
        for lang, numbers in self.numbers.items():
            key = lang + b"\0"
            own = np.fromiter((of(key + word, seed) for word in numbers), np.uint64, len(numbers)) >> np.uint64(1)
            hashes[np.fromiter(numbers.values(), np.int64, len(numbers))] = np.maximum(own.astype(np.int64), 1)
        hashes[0] = 0
        words, runs = self.numbers if named else {}, np.concatenate([np.zeros(1, np.int32), *self.runs, np.zeros(3, np.int32)])
        self.__init__(seed)
        return words, hashes, runs


def _counted(batches: Iterator[pa.RecordBatch], seed: int, named: bool = False) -> Iterator[tuple[dict[bytes, Numbers], np.ndarray, np.ndarray]]:
    counts = Counts(seed)
    for batch in slices(batches, 128):
        by: dict[bytes, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = by.setdefault(lang, [])
            own.append(text)
            if sum(map(len, own)) > BYTES_AT_ONCE:
                counts.add(lang, by.pop(lang))
        for lang, texts in by.items():
            counts.add(lang, texts)
        if counts.count >= WORDS_AT_ONCE:
            yield counts.take(named)
            trim()
    if counts.count:
        yield counts.take(named)
    trim()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def count_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """id, lang, word, f of all words; clash is true where two words share an id."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, hashes, runs in _counted(batches, seed, named=True):
            counts = np.bincount(runs, minlength=len(hashes)).astype(np.int64)
            for lang, numbers in words.items():
                own, at = [*numbers][1:], np.fromiter(numbers.values(), np.int64, len(numbers))[1:]  # without the break, which comes first
                for low in range(0, len(own), 50_000):
                    some, where = own[low : low + 50_000], at[low : low + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[where]), pa.array([lang] * len(some), pa.binary()), pa.array(some, pa.binary()), pa.array(counts[where])], ["id", "lang", "word", "f"])

    rows = _texts(docs).mapInArrow(counted, "id long, lang binary, word binary, f long")
    rows = rows.repartition("id").groupBy("id", "lang", "word").agg(F.sum("f").alias("f"))  # one shuffle serves the sum and the window
    rows = rows.withColumn("clash", F.count("*").over(Window.partitionBy("id")) > 1)
    return rows.select("id", F.col("lang").cast("string"), F.col("word").cast("string"), "f", "clash")


def _stripe_rows(prefixes: list[np.ndarray], nexts: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """One row for each part that the stripes go to: the part's entries, sorted by prefix."""
    mixed = np.zeros(len(nexts), np.uint64)
    for column in prefixes:
        mixed = _mixed(mixed, column)
    part = (_mixed(mixed, nexts % SPLIT) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)] if len(order) else [0]
    for low, high in zip(bounds, bounds[1:]):
        rows = order[low:high]
        blobs = [np.stack([p[rows] for p in prefixes], axis=1).tobytes(), nexts[rows].tobytes(), counts[rows].astype(np.int64).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([int(part[rows[0]])], pa.int64()), pa.array([len(prefixes)], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], ["part", "width", "prefixes", "nexts", "counts"])


def _next_rows(hashes: np.ndarray, runs: np.ndarray, frequent: Frequent, parts: int) -> Iterator[pa.RecordBatch]:
    good = frequent.has(hashes)
    good[0] = False
    ok = good[runs]
    totals = np.bincount(runs[ok], minlength=len(hashes))
    own = np.flatnonzero(totals)
    pairs, counts = np.unique(runs[:-1][ok[:-1] & ok[1:]].astype(np.int64) * len(hashes) + runs[1:][ok[:-1] & ok[1:]], return_counts=True)
    first, then = pairs // len(hashes), pairs % len(hashes)
    yield from _stripe_rows([hashes[np.concatenate([own, first])]], np.concatenate([np.zeros(len(own), np.int64), hashes[then]]), np.concatenate([totals[own], counts]), parts)


def _next_words(docs: DataFrame, seed: int, words: tuple[str, bytes], parts: int) -> DataFrame:
    """Stripes of single frequent words, in parts; under 0 the word's own count."""
    sent = docs.sparkSession.sparkContext.broadcast(words)  # FILTER_BITS at most

    def striped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _received(sent)
        for _, hashes, runs in _counted(batches, seed):
            yield from _next_rows(hashes, runs, frequent, parts)

    return _texts(docs).mapInArrow(striped, _STRIPES)


def _longer_rows(hashes: np.ndarray, runs: np.ndarray, frequent_words: Frequent, frequent_pairs: Frequent, parts: int) -> Iterator[pa.RecordBatch]:
    good, size = frequent_words.has(hashes), len(hashes)
    good[0] = False
    ok = good[runs]
    at = np.flatnonzero(ok[:-1] & ok[1:])
    found, pair = np.unique(runs[at].astype(np.int64) * size + runs[at + 1], return_inverse=True)
    first, second = found // size, found % size
    kept = frequent_pairs.has(_mixed(hashes[first], hashes[second]))
    linked = np.zeros(len(runs) + 2, bool)  # does a frequent pair begin here?
    linked[at] = kept[pair]
    pair_at = np.full(len(runs), -1, np.int64)
    pair_at[at] = pair
    start = np.flatnonzero(linked)
    totals = np.bincount(pair_at[start], minlength=len(found))
    own = np.flatnonzero(totals)
    start = start[linked[start + 1]]
    triples, triple, counts = np.unique(pair_at[start] * size + runs[start + 2], return_inverse=True, return_counts=True)
    head, third = triples // size, triples % size
    pick = np.concatenate([own, head])
    yield from _stripe_rows([hashes[first[pick]], hashes[second[pick]]], np.concatenate([np.zeros(len(own), np.int64), hashes[third]]), np.concatenate([totals[own], counts]), parts)
    on = linked[start + 2]
    fours, four_counts = np.unique(triple[on].astype(np.int64) * size + runs[start[on] + 3], return_counts=True)
    pick = np.concatenate([np.arange(len(triples)), fours // size])
    yield from _stripe_rows([hashes[first[head[pick]]], hashes[second[head[pick]]], hashes[third[pick]]], np.concatenate([np.zeros(len(triples), np.int64), hashes[fours % size]]), np.concatenate([counts, four_counts]), parts)


def _longer_stripes(docs: DataFrame, seed: int, words: tuple[str, bytes], pairs: tuple[str, bytes], parts: int) -> DataFrame:
    """Stripes of prefixes of two and three words, all of whose neighbours are frequent pairs, in parts; under 0 the prefix's own count."""
    sent_words, sent_pairs = (docs.sparkSession.sparkContext.broadcast(x) for x in (words, pairs))

    def striped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, frequent_pairs = _received(sent_words), _received(sent_pairs)
        for _, hashes, runs in _counted(batches, seed):
            yield from _longer_rows(hashes, runs, frequent_words, frequent_pairs, parts)

    return _texts(docs).mapInArrow(striped, _STRIPES)


def merged_stripes(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes added elementwise: prefix, nexts and counts (arrays of the entries of at least `least`), total (null where another part of the stripe has it, or below `least`), best (the largest entry, or null)."""

    def merged(rows: pa.Table) -> pa.Table:
        trim()
        width = rows.column("width")[0].as_py()
        prefixes, nexts, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("prefixes", "nexts", "counts"))
        prefixes = prefixes.reshape(-1, width)
        order = np.lexsort([nexts, *prefixes.T[::-1]])
        prefixes, nexts, counts = prefixes[order], nexts[order], counts[order]
        changed = np.ones(len(nexts), bool)
        changed[1:] = (prefixes[1:] != prefixes[:-1]).any(axis=1) | (nexts[1:] != nexts[:-1])
        starts = np.flatnonzero(changed)
        prefixes, nexts, counts = prefixes[starts], nexts[starts], np.add.reduceat(counts, starts)
        prefixes, nexts, counts = (x[counts >= least] for x in (prefixes, nexts, counts))
        if not len(nexts):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        head = np.ones(len(nexts), bool)
        head[1:] = (prefixes[1:] != prefixes[:-1]).any(axis=1)
        at, entry = np.flatnonzero(head), nexts != 0  # 0 sorts first
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(entry.astype(np.int64), at))]), pa.int32())
        best = np.maximum.reduceat(np.where(entry, counts, 0), at)
        flat = pa.array(np.ascontiguousarray(prefixes[at]).ravel())
        columns = [
            pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), flat),
            *[pa.ListArray.from_arrays(offsets, pa.array(x[entry])) for x in (nexts, counts)],
            pa.array(counts[at], mask=entry[at]),
            pa.array(best, mask=best == 0),
        ]
        return pa.Table.from_arrays(columns, names)

    names = ["prefix", "nexts", "counts", "total", "best"]
    kinds = [pa.list_(pa.int64())] * 3 + [pa.int64()] * 2
    return stripes.groupBy("width", "part").applyInArrow(merged, "prefix array<long>, nexts array<long>, counts array<long>, total long, best long")


def _exact_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """All words with ids that no two share, and the ids' seed."""
    for seed in range(100):
        words = written(count_words(docs, seed), "words", "zstd")
        if not words.filter("clash").head(1):
            return words.drop("clash"), seed
    raise RuntimeError("no seed keeps the words apart")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language by score and a, with rank; ties are still without their place. Ranges of rows are counted, none gathers a language."""
    parts = parallelism(found.sparkSession)
    ranged = found.repartitionByRange(parts, "lang", F.desc("score"), F.desc("a")).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("lang", "range").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).filter(F.col("start") < top)
    return ranged.join(starts.drop("count"), ["lang", "range"])


def mine_phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to four words."""
    spark = docs.sparkSession
    python_path(spark)
    words, seed = _exact_words(docs)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = sum(r["n"] for r in sizes.select(F.sum("n").alias("n")).collect() if r["n"])
    parts = max(parallelism(spark), -(-total // WORDS_PER_PART))
    frequent = words.filter(F.col("f") >= least)
    word_filter = frequent_filter(frequent.select("id"))
    ones = written(merged_stripes(_next_words(docs, seed, word_filter, parts), least), "stripes")
    pair_filter = frequent_filter(_pair_hashes(ones))
    longer = written(merged_stripes(_longer_stripes(docs, seed, word_filter, pair_filter, parts), least), "stripes")
    stripes = ones.unionByName(longer)

    entries = stripes.select("prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    candidates = entries.select(F.concat("prefix", F.array("e.nexts")).alias("phrase"), F.col("e.counts").alias("a"))
    totals = stripes.filter("total IS NOT NULL").select("prefix", "total")
    right = stripes.filter("best IS NOT NULL").groupBy(F.col("prefix").alias("phrase")).agg(F.max("best").alias("longer"))
    left = candidates.filter(F.size("phrase") > 2).groupBy(F.slice("phrase", 2, 3).alias("phrase")).agg(F.max("a").alias("longer"))
    longest = right.unionByName(left).filter(F.size("phrase") > 1).groupBy("phrase").agg(F.max("longer").alias("longer"))
    alone = candidates.join(longest, "phrase", "left").filter(F.expr(f"longer IS NULL OR cast(longer AS decimal(38, 0)) * 100 < cast(a AS decimal(38, 0)) * {share}")).drop("longer")

    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)))
    cuts = cuts.withColumn("first", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("rest", F.slice("phrase", F.col("k") + 1, F.size("phrase")))
    cuts = cuts.join(totals.select(F.col("prefix").alias("first"), F.col("total").alias("l")), "first").join(totals.select(F.col("prefix").alias("rest"), F.col("total").alias("r")), "rest")
    cuts = cuts.withColumn("score", F.expr("cast(a AS decimal(24, 0)) * cast(2000000 AS decimal(10, 0)) div cast(l + r AS decimal(24, 0))").cast("long"))
    scored = cuts.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("phrase", "a", "cut.l", "cut.r", "cut.score", F.col("phrase")[0].alias("id"))
    scored = scored.join(frequent.select("id", "lang"), "id").drop("id")

    first = written(_ranked(scored, top), "ranked")
    spelt = first.select("phrase", F.posexplode("phrase").alias("at", "id")).join(frequent.select("id", "word"), "id")
    spelt = spelt.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    place = Window.partitionBy("lang", "range").orderBy(F.desc("score"), F.desc("a"), "text")
    out = first.join(spelt, "phrase").withColumn("rank", F.col("start") + F.row_number().over(place)).filter(F.col("rank") <= top)
    return out.join(sizes, "lang").select("lang", F.col("rank").cast("long"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")


def _pair_hashes(ones: DataFrame) -> DataFrame:
    """The filter's hashes of all frequent pairs of words."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, then = (batch.column(c).to_numpy() for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(first, then).view(np.int64))], ["id"])

    return ones.select(F.col("prefix")[0].alias("first"), F.explode("nexts").alias("then")).mapInArrow(hashes, "id long")


PHRASES_SQL = r"""WITH pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM pieces),
runs AS (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM sized),
f AS (SELECT lang, size, w[i : i + size - 1] AS p, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
longer AS (SELECT lang, p, max(f) AS longer FROM (
    SELECT lang, p[1 : size - 1] AS p, f FROM f WHERE size > 2 UNION ALL SELECT lang, p[2 : size] AS p, f FROM f WHERE size > 2
    UNION ALL SELECT lang, unnest([p[1:2], p[2:3], p[3:4]]) AS p, f FROM f WHERE size = 4) GROUP BY ALL),
alone AS (SELECT f.lang, f.size, f.p, f.f AS a FROM f LEFT JOIN longer USING (lang, p) WHERE f.size > 1 AND (longer.longer IS NULL OR 100 * longer.longer < 80 * f.f)),
cuts AS (SELECT lang, size, p, a, unnest(generate_series(1, size - 1)) AS k FROM alone),
scored AS (SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1 : c.size]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, score FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
