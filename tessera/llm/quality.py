"""Quality rules by tokeniser fertility.

Public vocabularies encode each document; characters per token (of a
byte-level and of a piece vocabulary), the share of byte-fallback tokens and the
entropy of the tokens, against the most that as many tokens could have, are held
against rejection bands of the document's language. A band reaches some
interquartile ranges below the first and above the third quartile of all documents of
that language which pass the base rules, is never narrower than a floor, and is
wider for short texts, by sqrt(1 + 100 / words).
Where lang is null, the script of most letters (ASCII or not) stands in for it.

Defined cases: null and empty texts have no words and fail the base rules; a
language of one document can't reject it; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEPT_IN_WORKERS, python_path, release, slices, written

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_STARTS = bytes(range(0x80, 0xC0))
#: Words whose measures a worker keeps at a time.
KEPT_WORDS = 200_000
#: At most so many languages' bands are sent to all workers; more meet their documents by a shuffled join.
BROADCAST_LANGUAGES = 10_000
#: By measure: interquartile ranges that the band reaches below the first and above the third quartile, and its least reach. Text
#: that a vocabulary breaks up more than its language's is the sign of junk, so the first band is narrow on that side.
BANDS = {"chars_per_piece": (2.2, 8.0, 0.08), "chars_per_byte_token": (8.0, 8.0, 0.3), "fallback_share": (8.0, 8.0, 0.05), "entropy_share": (8.0, 8.0, 0.05)}


class WordMeasures:
    """Token counts and tokens of words, measured once per word."""

    def __init__(self, piece_model: str, byte_ranks: str, pattern: str) -> None:
        import base64

        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        with open(byte_ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.fresh: list[bytes] = []
        self.n_bytes = np.zeros(0, np.int32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.tokens = np.zeros(0, np.int32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """A number for each word; new words wait for measure()."""
        number, fresh = self.number, self.fresh
        out = [number.get(w, -1) for w in words]
        if -1 in out:
            for i, x in enumerate(out):
                if x < 0:
                    w = words[i]
                    if (k := number.get(w)) is None:
                        k = number[w] = len(number)
                        fresh.append(w)
                    out[i] = k
        return np.array(out, np.int64)

    def measure(self) -> None:
        if not self.fresh:
            return
        texts = [w.decode("utf-8", "replace") for w in self.fresh]
        encoded = self.pieces.encode(texts, num_threads=1)
        size = np.fromiter(map(len, encoded), np.int32, len(encoded))
        begin = len(self.tokens) + np.concatenate([[0], np.cumsum(size[:-1], dtype=np.int64)])
        self.tokens = np.concatenate([self.tokens, np.fromiter((t for e in encoded for t in e), np.int32, int(size.sum()))])
        self.start, self.size = np.concatenate([self.start, begin]), np.concatenate([self.size, size])
        self.n_bytes = np.concatenate([self.n_bytes, np.fromiter((len(self.bytes.encode_ordinary(" " + t)) for t in texts), np.int32, len(texts))])
        self.fresh.clear()

    def tokens_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)
        return self.tokens[at]


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 20:
        codes = ((ids[:-2] << 20) + ids[1:-1] << 20) + ids[2:]
    else:  # pairs get numbers of their own first, so that a code fits 63 bits whatever the number of distinct words
        width = int(ids.max()) + 1
        codes = np.unique(ids[:-1] * width + ids[1:], return_inverse=True)[1][:-1] * width + ids[2:]
    order = np.argsort(codes)
    same = np.diff(codes[order]) == 0
    twice = np.zeros(len(codes), bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(codes)] |= twice
    return int(covered.sum())


_LOADED: dict[tuple, WordMeasures] = {}
KEPT_IN_WORKERS.append(_LOADED)


def _loaded(files: tuple) -> WordMeasures:
    release(_LOADED)
    if files not in _LOADED:
        _LOADED[files] = WordMeasures(*files)
    return _LOADED[files]


_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("chars_per_piece", pa.float64()), ("chars_per_byte_token", pa.float64()), ("fallback_share", pa.float64()), ("entropy_share", pa.float64())]


def _measures(text: bytes, ids: np.ndarray, words: WordMeasures) -> tuple:
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    chars = len(text.translate(None, _SPACE + _NOT_STARTS))
    base = (len(ids), chars, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids))
    if not len(ids):
        return (*base, None, None, None, None)
    tokens = words.tokens_of(ids)
    if not len(tokens):
        return (*base, None, chars / max(1, int(words.n_bytes[ids].sum())), 0.0, None)
    ordered = np.sort(tokens)
    ends = np.flatnonzero(np.diff(ordered, append=-1))
    counts = np.diff(ends, prepend=-1)
    entropy = np.log2(len(tokens)) - float((counts * np.log2(counts)).sum()) / len(tokens)
    return (*base, chars / len(tokens), chars / int(words.n_bytes[ids].sum()), float(words.fallback[tokens].mean()), entropy / np.log2(max(2, len(tokens))))


def measure_documents(docs: DataFrame, piece_model: str | None = None, byte_ranks: str | None = None) -> DataFrame:
    """doc_id, lang_key, the base counts and the tokeniser measures of each row; the vocabularies default to the public ones."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    files = (piece_model or public_tokenizers.path("piece_bpe_32k.model"), byte_ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded(files)
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            if len(words.number) > KEPT_WORDS:
                words.clear()
            ids = [words.ids(t.split()) for t in texts]
            words.measure()
            rows = [_measures(t, i, words) for t, i in zip(texts, ids)]
            langs = [x if x is not None else "ascii" if len(t.translate(None, bytes(range(0x80, 0x100)))) * 2 > len(t) else "other" for x, t in zip(batch.column(1).to_pylist(), texts)]
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), *columns], ["doc_id", "lang_key", *[n for n, _ in _FIELDS]])

    python_path(docs.sparkSession)
    kinds = ", ".join(f"{n} {'long' if k == pa.int64() else 'double'}" for n, k in _FIELDS)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", lang.alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_key string, {kinds}")


def quality_rules(docs: DataFrame, bands_of: dict[str, tuple[float, float, float]] = BANDS) -> DataFrame:
    """Counts, base_failed, measures, band_failed and kept of each row of docs."""
    m = measure_documents(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    m = written(m, "fertility")
    quartiles = [F.percentile_approx(name, [0.25, 0.75], 10_000).alias(f"{name}_q") for name in bands_of]
    bands = written(m.filter("NOT base_failed").groupBy("lang_key").agg(*quartiles), "bands")
    if bands.count() <= BROADCAST_LANGUAGES:
        bands = F.broadcast(bands)
    outside = F.lit(False)
    for name, (below, above, floor) in bands_of.items():
        low, high = F.col(f"{name}_q")[0], F.col(f"{name}_q")[1]
        # the measures of a short text scatter more
        reach = lambda times: F.greatest(times * (high - low), F.lit(floor)) * F.sqrt(1 + 100 / F.greatest("n_words", F.lit(1)))  # noqa: B023, E731
        outside |= F.coalesce((F.col(name) < low - reach(below)) | (F.col(name) > high + reach(above)), F.lit(False))
    return m.join(bands, "lang_key", "left").withColumn("band_failed", outside).select(
        "doc_id", *[n for n, _ in _FIELDS], "base_failed", "band_failed", (~F.col("base_failed") & ~F.col("band_failed")).alias("kept")
    )
