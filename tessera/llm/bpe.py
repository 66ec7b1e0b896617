"""Encoding and decoding by a public byte-pair vocabulary, cut at forced boundaries.

A merge yields a token of the vocabulary, so no merge ever spans two neighbouring bytes that no token holds side by side. Such pairs
mark certain cuts: the bytes of a word are cut there, each fragment is encoded by itself, and the ids are laid end to end. Pairs at the
end of a word are looked up apart, as its last byte carries the end mark. Fragments and short words recur and are kept by worker.

Texts are read in one pass without a shuffle; nothing is broadcast but the path of the vocabulary file, which every worker opens.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded one by one; an empty table
gives an empty result; further columns are ignored. A word of any length takes time in proportion to it, times its logarithm.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEPT_IN_WORKERS, id_text, python_path, release, slices

#: Characters that the pattern and the lower case treat alike in every Unicode version and that no normal form changes; words of others go by the file's own rules.
_PLAIN = re.compile(r"[!-~À-įı-ɏ]*")
#: Fragments of more bytes than this are merged one by one, by a heap.
_SHORT = 48
#: The rank of a pair that is not merged.
_NONE = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind: itself where printable, else the next letter from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(0x100 + k): b for k, b in enumerate(hidden)}}


class Codec(dict):
    """encode() and decode() of one vocabulary file; as a dict, it holds the ids of what stands between ASCII white space (little-endian uint32)."""

    KEPT, LONGEST = 400_000, 40

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, split = told["model"], told["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or told["decoder"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"{path} is not a plain byte-pair vocabulary without a decoder")
        self.mark = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError(f"{path} has special tokens that are not matched as they stand")
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(split["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        letters = byte_letters()
        self.to_bytes = {ord(c): chr(b) for c, b in letters.items()}
        letter_of = {b: c for c, b in letters.items()}
        vocab: dict[str, int] = model["vocab"]
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.middle = np.array([vocab[letter_of[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letter_of[b] + self.mark] for b in range(256)], np.int32)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        #: The merges again, as arrays: pairs in order with their ranks, and the token that each rank yields.
        codes = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self.codes, self.code_ranks = codes[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.into = np.zeros(len(merges), np.int32)
        for rank, token in self.merges.values():
            self.into[rank] = token
        #: [is the second byte a word's last][first byte * 256 + second byte]: does any token hold the pair?
        self.held = np.zeros((2, 65536), bool)
        for name in vocab:
            ends = bool(self.mark) and name.endswith(self.mark) and name != self.mark
            body = [letters[c] for c in (name[: -len(self.mark)] if ends else name)]
            for k, (a, b) in enumerate(zip(body, body[1:]), 2):
                self.held[int(ends and k == len(body)), a * 256 + b] = True
        if not self.mark:
            self.held[1] = self.held[0]
        self.known: dict[bytes, bytes] = {}

    def fragments(self, words: list[bytes]) -> tuple[list[tuple[bytes, bool]], list[int]]:
        """The fragments of all words in turn, each with whether it ends its word, and how many each word has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        codes = data[:-1].astype(np.int32) << 8 | data[1:]
        cut = ~self.held[0][codes]
        last = ends[np.diff(ends, prepend=0) > 1] - 2
        cut[last] = ~self.held[1][codes[last]]
        cut[ends[:-1] - 1] = True
        at = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(data)]])
        closing = np.zeros(len(data) + 1, bool)
        closing[ends] = True
        whole, bounds = data.tobytes(), at.tolist()
        counts = np.searchsorted(at[1:], ends, side="right")
        return [(whole[x:y], e) for x, y, e in zip(bounds, bounds[1:], closing[at[1:]].tolist())], np.diff(counts, prepend=0).tolist()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Token ids of words (little-endian uint32): their fragments are merged together, each but once."""
        parts, counts = self.fragments(words)
        known: dict[tuple[bytes, bool], bytes] = {}
        short = sorted({p for p in parts if len(p[0]) <= _SHORT}, key=lambda p: len(p[0]))
        for at in range(0, len(short), 4096):
            known.update(zip(short[at : at + 4096], self._merged(short[at : at + 4096])))
        for part, ends in {p for p in parts if len(p[0]) > _SHORT}:
            symbols = self.middle[np.frombuffer(part, np.uint8)].tolist()
            if ends:
                symbols[-1] = int(self.final[part[-1]])
            known[part, ends] = np.array(self._merged_by_heap(symbols), "<u4").tobytes()
        found, at = [], 0
        for n in counts:
            found.append(known[parts[at]] if n == 1 else b"".join([known[p] for p in parts[at : at + n]]))
            at += n
        return found

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens among the merges, _NONE where there is no merge."""
        codes = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.code_ranks[at], _NONE)

    def _merged(self, parts: list[tuple[bytes, bool]]) -> list[bytes]:
        """All merges of short fragments, one merge of every fragment at a time: the lowest rank, of these the leftmost."""
        sizes = np.array([len(p) for p, _ in parts])
        wide, ends = int(sizes.max()), np.cumsum(sizes)
        data = np.frombuffer(b"".join([p for p, _ in parts]), np.uint8)
        symbols = self.middle[data]
        last = ends[np.array([e for _, e in parts])] - 1
        symbols[last] = self.final[data[last]]
        state = np.full((len(parts), wide), -1, np.int32)
        state[np.repeat(np.arange(len(parts)), sizes), np.arange(len(data)) - np.repeat(ends - sizes, sizes)] = symbols
        ranks = np.where(state[:, 1:] >= 0, self._ranks(state[:, :-1], np.maximum(state[:, 1:], 0)), _NONE) if wide > 1 else np.full((len(parts), 1), _NONE)
        rows, done, columns = np.arange(len(parts)), [b""] * len(parts), np.arange(wide)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            for k in np.flatnonzero(best == _NONE).tolist():
                left = state[k]
                done[rows[k]] = left[left >= 0].astype("<u4").tobytes()
            going = best < _NONE
            state, ranks, rows, at, best = state[going], ranks[going], rows[going], at[going], best[going]
            if not len(rows):
                break
            each = np.arange(len(rows))
            state[each, at] = self.into[best]
            state = np.take_along_axis(state, np.minimum(columns + (columns > at[:, None]), wide - 1), 1)
            state[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), wide - 2), 1)
            ranks[:, -1] = _NONE
            right = state[each, np.minimum(at + 1, wide - 1)]
            ranks[each, np.minimum(at, wide - 2)] = np.where(right >= 0, self._ranks(state[each, at], np.maximum(right, 0)), _NONE)
            inside = np.flatnonzero(at > 0)
            ranks[inside, at[inside] - 1] = self._ranks(state[inside, at[inside] - 1], state[inside, at[inside]])
        return done

    def _merged_by_heap(self, symbols: list[int]) -> list[int]:
        """The same merges of one long fragment. The heap holds rank << 32 | position; entries that no longer fit are passed over."""
        merges, n = self.merges, len(symbols)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [found[0] << 32 | k for k, pair in enumerate(zip(symbols, symbols[1:])) if (found := merges.get(pair))]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            at = top & 0xFFFFFFFF
            if symbols[at] < 0 or (right := after[at]) >= n:
                continue
            found = merges.get((symbols[at], symbols[right]))
            if not found or found[0] != top >> 32:
                continue
            symbols[at], symbols[right] = found[1], -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
                if more := merges.get((found[1], symbols[after[at]])):
                    heapq.heappush(heap, more[0] << 32 | at)
            if (left := before[at]) >= 0 and (more := merges.get((symbols[left], found[1]))):
                heapq.heappush(heap, more[0] << 32 | left)
        return [s for s in symbols if s >= 0]

    def _words(self, chunk: bytes) -> list[bytes]:
        """The words of the pattern in what stands between white space."""
        if chunk.isalpha():  # bytes.isalpha() knows ASCII letters alone
            return [chunk.lower()]
        if chunk[:-1].isalpha() and chunk[-1:] in b".,;:!?":
            return [chunk[:-1].lower(), chunk[-1:]]
        text = chunk.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            return [w.encode() for w in self.pattern.findall(text.lower())]
        parts = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [w.translate(self.to_bytes).encode("latin-1") for w, _ in parts]

    def learn(self, chunks: set[bytes]) -> None:
        """Work out the ids of what stands between white space: the new words of all chunks together."""
        words = {c: self._words(c) for c in chunks if c not in self}
        new = list({w for ws in words.values() for w in ws if w not in self.known})
        if new:
            self.known.update(zip(new, self._ids(new)))
        known = self.known
        for chunk, ws in words.items():
            self[chunk] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])
        for word in new:
            if len(word) > self.LONGEST:
                del known[word]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Token ids of UTF-8 texts, special tokens in them included."""
        for kept in (self, self.known):
            if len(kept) > self.KEPT:
                kept.clear()
        split, chunks = [], set()
        for data in texts:
            # bytes.split() cuts at ASCII white space, which no word spans.
            if self.at_special is None or b"<" not in data:
                found = [data.split()]
            else:
                found = [self.special[p] if k % 2 else p.encode().split() for k, p in enumerate(self.at_special.split(data.decode("utf-8", "replace")))]
            for x in found:
                if isinstance(x, list):
                    chunks.update(x)
            split.append(found)
        self.learn(chunks)
        ids = [np.frombuffer(b"".join(b"".join(map(self.__getitem__, x)) if isinstance(x, list) else np.array([x], "<u4").tobytes() for x in found), "<u4") for found in split]
        for chunk in chunks:
            if len(chunk) > self.LONGEST:
                del self[chunk]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' names joined by spaces, as a file without a decoder has it; special tokens are kept."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_CODECS: dict[str, Codec] = {}
KEPT_IN_WORKERS.append(_CODECS)


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, kept in this process."""
    release(_CODECS)
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    return _through(docs, vocabulary, "ids array<int>", lambda c, ids: [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)))])


def codec_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and then decoded from its ids."""

    def digests(c: Codec, ids: list[np.ndarray]) -> list[pa.Array]:
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        ]

    return _through(docs, vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _through(docs: DataFrame, vocabulary: str | None, columns: str, made) -> DataFrame:
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            who, texts = zip(*id_text(batch))
            yield pa.RecordBatch.from_arrays([pa.array(who, batch.schema.field(0).type), *made(c, c.encode_all(list(texts)))], names)

    python_path(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(coded, f"doc_id {kind}, {columns}")
