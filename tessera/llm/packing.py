"""Packing into token windows by non-negative least squares over length combinations.

Whole windows are cut from the front of each document; the remaining tails have
lengths below the window, so their histogram is bounded by it. The driver
enumerates shallow combinations of lengths that fill a window exactly, solves
for the repeat counts that explain the histogram best (non-negative least
squares, by coordinate descent), rounds them down, and takes exact pairs from
what is left. Tails that no combination takes are laid end to end and cut at the window;
only the last of these windows has padding.

Tails find their place by their rank among tails of equal length; ranks are taken
in hash buckets and shifted by the counts of earlier buckets, so one length may
hold any share of the rows.

Defined cases: a null or empty text is the end token alone; rows that repeat a doc_id are packed
one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import KEPT_IN_WORKERS, id_text, python_path, release, slices, written

WINDOW = 1024
#: White space other than the plain space and newline; a text that has any is encoded whole.
_RARE_SPACE = re.compile("[" + "".join(map(chr, [9, 11, 12, 13, *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")


#: A text that this vocabulary's tokenizers read as one token wherever it stands, whatever surrounds it.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256


class WordEncoder(dict):
    """Token ids of texts by a byte-level BPE vocabulary, kept by word (with the space before it) as little-endian uint16.

    A text is cut at each END_OF_TEXT, which is a token of its own. No piece of the vocabulary's pattern spans a single space that stands between two
    non-spaces, so the ids of a part without other white space than these are those of its words in turn.
    """

    KEPT = 250_000

    def __init__(self, ranks_file: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self._whole(" " + word)
        if len(word) <= 40:
            self[word] = ids
        return ids

    def _part(self, text: str) -> bytes:
        if not text or "  " in text or "\n " in text or " \n" in text or _RARE_SPACE.search(text):
            return self._whole(text)
        if len(self) > self.KEPT:
            self.clear()
        first, *words = text.split(" ")
        return b"".join([self._whole(first), *[self[w] for w in words]])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(np.uint16(END_OF_TEXT_ID).tobytes().join(map(self._part, text.split(END_OF_TEXT))), "<u2")


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}
KEPT_IN_WORKERS.append(_ENCODERS)


def _encoder(files: tuple[str, str]) -> WordEncoder:
    release(_ENCODERS)
    if files not in _ENCODERS:
        _ENCODERS[files] = WordEncoder(*files)
    return _ENCODERS[files]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_documents(docs: DataFrame, window: int, files: tuple[str, str], end_id: int) -> DataFrame:
    """Pieces of at most window tokens: doc_id, start, length, ids_crc32, doc_tokens, and the ids of pieces below the window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(files)
        for batch in slices(batches):
            who, start, length, crc, total, tail = [], [], [], [], [], []
            for i, text in id_text(batch):
                ids = np.append(encoder.ids(text.decode("utf-8", "replace")), np.uint16(end_id))
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    who.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(_crc(part))
                    total.append(len(ids))
                    tail.append(part.tobytes() if len(part) < window else None)
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([pa.array(who, batch.schema.field(0).type), *longs, pa.array(tail, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tail"])

    python_path(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, tail binary")


def combinations(lengths: list[int], counts: np.ndarray, window: int, common: int = 64) -> list[tuple[int, ...]]:
    """Length combinations that fill the window: all pairs, and triples and quadruples that start from the commonest lengths."""
    have = set(lengths)
    found = {(a, window - a) for a in lengths if a <= window - a and window - a in have}
    top = sorted(sorted(lengths, key=lambda n: (-counts[n], n))[:common])
    for i, a in enumerate(top):
        for b in top[i:]:
            if (c := window - a - b) in have:
                found.add(tuple(sorted((a, b, c))))
    few = sorted(sorted(lengths, key=lambda n: (-counts[n], n))[: common // 4])
    for i, a in enumerate(few):
        for j, b in enumerate(few[i:], i):
            for c in few[j:]:
                if (d := window - a - b - c) in have:
                    found.add(tuple(sorted((a, b, c, d))))
    return sorted(found)


def non_negative_counts(combos: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, A[n, j] being how often combination j has length n."""
    x = np.zeros(len(combos))
    left = counts.astype(float).tolist()
    columns = []
    for combo in combos:
        times: dict[int, int] = {}
        for n in combo:
            times[n] = times.get(n, 0) + 1
        columns.append((list(times.items()), float(sum(t * t for t in times.values()))))
    for _ in range(sweeps):
        moved = 0.0
        for j, (column, norm) in enumerate(columns):
            step = max(-x[j], sum(t * left[n] for n, t in column) / norm)
            if step:
                x[j] += step
                moved += abs(step)
                for n, t in column:
                    left[n] -= t * step
        if moved <= 1e-3 * max(1.0, x.sum()):
            break
    return x


def plan_windows(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats): solved, rounded down to what the histogram holds, then exact pairs from the rest."""
    lengths = [int(n) for n in np.flatnonzero(counts)]
    combos = combinations(lengths, counts, window)
    left, plan = counts.copy(), []

    def take(combo: tuple[int, ...], most: int) -> None:
        fits = min([most, *(int(left[n]) // combo.count(n) for n in set(combo))])
        if fits > 0:
            for n in combo:
                left[n] -= fits
            plan.append((combo, fits))

    x = non_negative_counts(combos, counts)
    for j in sorted(range(len(combos)), key=lambda j: (-x[j], combos[j])):
        take(combos[j], int(x[j] + 1e-6))
    for combo in combos:
        if len(combo) == 2:
            take(combo, int(counts.sum()))
    return plan


def _ranked(rows: DataFrame, by: list[str], order: list[str], rows_per_bucket: int, count: int) -> DataFrame:
    """rows with rank: 0, 1, ... among rows of equal `by`, whatever share of the rows these are."""
    buckets = max(1, -(-count // rows_per_bucket))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    n = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)) - 1)
    return rows.join(n, [*by, "_b"]).withColumn("rank", F.col("_start") + F.col("_r")).drop("_b", "_r", "_start")


def pack_documents(docs: DataFrame, window: int = WINDOW, ranks_file: str | None = None, end_id: int = 0, rows_per_bucket: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    spark = docs.sparkSession
    files = (ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    pieces = written(cut_documents(docs, window, files, end_id), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most window rows
        histogram[r["length"]] = r["count"]
    full = int(histogram[window])
    tails = histogram.copy()
    tails[window] = 0
    slots, sequences, used = [], 0, np.zeros(window + 1, np.int64)
    for combo, repeats in plan_windows(tails, window):
        offset = 0
        for n in combo:
            slots.append((n, int(used[n]), int(used[n]) + repeats, sequences, offset))
            used[n] += repeats
            offset += n
        sequences += repeats
    slots.append((window, 0, full, sequences, 0))
    used[window] = full
    sequences += full
    table = spark.createDataFrame(slots, "length long, low long, high long, first long, offset long")
    key = ["doc_id", "start", "doc_tokens", "ids_crc32"]
    placed = _ranked(pieces.drop("tail"), ["length"], key, rows_per_bucket, int(histogram.sum()))
    table = F.broadcast(table.alias("t"))  # a few rows per combination: bounded by the window, not by the data
    placed = placed.alias("p").join(table, (F.col("p.length") == F.col("t.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    placed = placed.select("doc_id", "start", "p.length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("offset"))
    placed = written(placed, "placed")
    fitting = placed.filter("sequence_id IS NOT NULL")
    spare = _residual(placed.filter("sequence_id IS NULL").drop("sequence_id", "offset"), pieces, window, sequences, rows_per_bucket, int((histogram - used).sum()))
    return fitting.unionByName(spare)


def _residual(spare: DataFrame, pieces: DataFrame, window: int, first_sequence: int, rows_per_bucket: int, count: int) -> DataFrame:
    """The tails that no combination takes, end to end, cut at the window."""
    key = ["doc_id", "start", "doc_tokens", "ids_crc32"]
    # Rows that repeat a document are alike; numbering them keeps the join one to one.
    copies = Window.partitionBy(*key).orderBy("length")
    buckets = max(1, -(-count // rows_per_bucket))
    spare = spare.withColumn("copy", F.row_number().over(copies)).withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    sums = spare.groupBy("_b").agg(F.sum("length").alias("_n"))
    sums = sums.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.sum("length").over(Window.partitionBy("_b").orderBy(*key, "copy").rowsBetween(Window.unboundedPreceding, -1))
    spare = spare.withColumn("_own", F.coalesce(own, F.lit(0))).join(sums, "_b").withColumn("at", F.col("_start") + F.col("_own"))
    held = pieces.filter(F.col("length") < window).withColumn("copy", F.row_number().over(copies)).select(*key, "copy", "tail")
    spare = spare.alias("s").join(held.alias("h"), [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*key, "copy"]])
    spare = spare.select(*[f"s.{c}" for c in key], "s.length", "at", "tail")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for who, start, total, _, length, at, tail in zip(*(c.to_pylist() for c in batch.columns)):
                ids, done = np.frombuffer(tail, "<u2"), 0
                while done < length:
                    n = min(length - done, window - (at + done) % window)
                    rows.append((who, start + done, n, _crc(ids[done : done + n]), total, first_sequence + (at + done) // window, (at + done) % window))
                    done += n
            columns = list(zip(*rows)) or [()] * 7
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = spare.schema["doc_id"].dataType.simpleString()
    return spare.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
