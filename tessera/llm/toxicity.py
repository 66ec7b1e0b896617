"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel counts the common, possibly gapped, character subsequences of two
strings, each weighted by decay to the power of its spans (Lodhi et al. 2002), and is normalised;
inserted characters and gaps lower it only by degrees. A long gap leaves next to nothing of a subsequence's
weight, so a sentence meets a landmark, which is one string, in one of its strings: a sentence's margin is that of its worst string.

Landmarks are strings that labelled toxic documents have far more often than clean ones, some strings
of clean documents, and those of them that a first machine finds nearest to toxic ones. A string's features are its kernels with the landmarks, whitened
by their own kernel matrix (Nyström); a linear support vector machine with squared hinge loss is trained on
the labelled documents' sentences, as sets of strings (multiple-instance learning): every string of a clean sentence is
negative, and a toxic sentence has at least one positive string. Which sentences of a toxic document are toxic, and by which string,
is first taken from the landmarks, then from the machine itself in further fits: its sentences on the toxic side, and its worst one.
Landmarks with inserted characters are positive strings too. A document's score is a logistic function of the margins of its three worst sentences, fitted on all
sampled labels.

Sentences end at line breaks and after words that end in . ! or ?, and after 40 words at the latest. Strings are
white-space separated words in lower case, punctuation at the ends taken off, between two marks of their ends; runs of four or
more single letters count as one more string, joined, and a string with other characters inside is read without them as well. Strings longer than 40 characters are read in overlapping parts.

Training takes at most `train_toxic` and `train_clean` labelled documents, those of
the smallest hashes, and of each at most `train_sentences` sentences, those of the smallest hashes; scoring reads whole texts.
Defined cases: null and empty texts get the score of a document without any suspicious sentence; labels of a repeated doc_id
count as toxic if one of them does; with no toxic or no clean label at all,
every score is the share of toxic labels (0 if there are none); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import KEPT_IN_WORKERS, hash52, plain, python_path, release, slices, trim

_ENDS = ".,;:!?\"'()[]{}<>*#$%&|-_~`/\\"
_SPACED = re.compile(r"\b\w(?: \w){3,}\b")
_NO_LETTER = re.compile(r"[\W\d_]+")
THRESHOLD = 0.3
#: Margins of sentences are taken as lying between this and its opposite.
FLOOR = -1.5


@dataclass(frozen=True)
class Settings:
    order: int = 3
    decay: float = 0.6
    landmarks: int = 32
    clean_landmarks: int = 8
    near_landmarks: int = 16
    train_toxic: int = 600
    train_clean: int = 1200
    train_sentences: int = 400
    sentence: int = 40
    part: int = 40
    cost: float = 10.0
    rounds: int = 5
    disturbed: float = 4.0
    kept_words: int = 200_000
    seed: int = 5


# The kernel.


def _codes(words: list[str], pad: int) -> np.ndarray:
    """A row of character codes per word, padded at the end."""
    width = max(map(len, words), default=1) or 1
    flat = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int32)
    flat[np.arange(width) >= np.fromiter(map(len, words), np.int64, len(words))[:, None]] = pad
    return flat


def subsequence_kernel(a: np.ndarray, b: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Kernels of strings as arrays of character codes (last axis; the others broadcast), padded with codes that the other side lacks."""
    shape = np.broadcast_shapes(a.shape[:-1], b.shape[:-1])
    n, m = a.shape[-1], b.shape[-1]
    one, nought = np.ones(shape, np.float32), np.zeros(shape, np.float32)
    # prefix[i][k]: weight of common subsequences of length i that end before here, drawn out to here
    prefix = [[one] * (m + 1)] + [[nought] * (m + 1) for _ in range(order - 1)]
    total = np.zeros(shape, np.float32)
    square = np.float32(decay * decay)
    lam = np.float32(decay)
    for j in range(n):
        same = [(a[..., j] == b[..., k]) * square for k in range(m)]
        grown = [prefix[0]]
        for i in range(1, order):
            row, drawn = [nought], nought
            for k in range(m):
                drawn = lam * drawn + same[k] * prefix[i - 1][k]
                row.append(lam * prefix[i][k + 1] + drawn)
            grown.append(row)
        for k in range(m):
            total += same[k] * prefix[order - 1][k]
        prefix = grown
    return total


# Sentences.


class Sentences:
    """Sentences of texts as numbers of their words, which are the keys of `number` in order."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.number: dict[str, int] = {}
        self.chars = 0
        self._ends = np.zeros(0, bool)

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """The words' numbers, where sentences begin among them, how many sentences each text has, and the words that are new."""
        number, fresh, ids, lines, owner = self.number, [], [], [], []
        for place, text in enumerate(texts):
            for line in text.lower().split("\n"):
                words = line.split()
                words += [x.replace(" ", "") for x in _SPACED.findall(line)]
                if not words:
                    continue
                lines.append(len(ids))
                owner.append(place)
                for w in words:
                    if (k := number.get(w)) is None:
                        k = number[w] = len(number)
                        fresh.append(w)
                        self.chars += len(w)
                    ids.append(k)
        if fresh:
            self._ends = np.concatenate([self._ends, [w.endswith((".", "!", "?")) for w in fresh]])
        at = np.array(ids, np.int64)
        if not len(at):
            return at, at, np.zeros(len(texts), np.int64), fresh
        begins = np.zeros(len(at), bool)
        begins[lines] = True
        begins[1:] |= self._ends[at[:-1]]
        starts = np.flatnonzero(begins)
        starts = np.flatnonzero((np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) % self.longest == 0)
        line_of = np.searchsorted(lines, starts, side="right") - 1
        return at, starts, np.bincount(np.array(owner)[line_of], minlength=len(texts)), fresh


# Training, on the driver, over the bounded sample.


def _bare(word: str) -> str:
    return f"^{word.strip(_ENDS)}$"


def _grams(word: str, part: int) -> set[str]:
    return {word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1)} if len(word) <= part else set()


def usual_shares(toxic: list[set[str]], clean: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
    """How often documents with the usual words of each toxic and clean document are toxic: the median over its words that one clean document in 50 has.

    Labels are not as often toxic in one language or kind of text as in another; that alone makes no fragment of it a mark.
    """
    good, bad = Counter(w for words in clean for w in words), Counter(w for words in toxic for w in words)
    base = len(toxic) / (len(toxic) + len(clean))
    # Shares of words with few documents are drawn to the share of all.
    share = {w: (bad[w] + 5 * base) / (bad[w] + n + 5) for w, n in good.items() if n >= max(3, len(clean) // 50)}
    found = [np.array([np.median(x) if (x := [share[w] for w in words if w in share]) else base for words in sets]).clip(base, 0.9) for sets in (toxic, clean)]
    return found[0], found[1]


def pick_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int, part: int = 40) -> list[str]:
    """Strings that set toxic documents apart, from the documents' sets of words.

    Fragments that toxic documents have by far more often than their usual words and chance would have it are taken
    greedily by the documents they explain, and prolonged to what their words have in common. With too few labels for any to pass, those
    of least chance are taken.
    """
    df: Counter = Counter()
    for words in toxic:
        df.update({g for w in words for g in _grams(w, part)})
    least = max(min(2, len(toxic)), min(3, len(toxic) // 4), len(toxic) // 50)
    df = {g: n for g, n in df.items() if n >= least}
    candidates = set(df)
    clean_df: Counter = Counter()
    # Of a fragment's documents the sums of ln(share) and ln(1 - share) that their usual words lead to expect.
    yes, no = dict.fromkeys(candidates, 0.0), dict.fromkeys(candidates, 0.0)
    usual_toxic, usual_clean = usual_shares(toxic, clean)
    for sets, shares, counts in ((toxic, usual_toxic, Counter()), (clean, usual_clean, clean_df)):
        for words, share in zip(sets, shares):
            held = {g for w in words for g in _grams(w, part) if g in candidates}
            counts.update(held)
            log_yes, log_no = float(np.log(share)), float(np.log(1 - share))
            for g in held:
                yes[g] += log_yes
                no[g] += log_no

    def surprise(g: str) -> float:
        n, q = df[g] + clean_df[g], (df[g] - 0.01) / (df[g] + clean_df[g])
        return q * (n * np.log(q) - yes[g]) + (1 - q) * (n * np.log(1 - q) - no[g]) if q > np.exp(yes[g] / n) else 0.0

    def often(g: str) -> bool:
        return df[g] / len(toxic) >= 4 * clean_df[g] / len(clean)

    chance = {g: surprise(g) for g in candidates if often(g)}
    best = [g for g in chance if chance[g] > np.log(100 * len(candidates))]
    if not best:
        best = sorted(chance, key=lambda g: (-chance[g], -len(g), g))[:most]
        most = max(1, min(most, len(toxic) // 2))
    best = sorted(best, key=lambda g: (-chance[g], -len(g), g))[:4000]
    holders: dict[str, list[tuple[int, str]]] = defaultdict(list)
    chosen = set(best)
    for number, words in enumerate(toxic):
        for w in words:
            for g in _grams(w, part) & chosen:
                holders[g].append((number, w))
    everything = set().union(*toxic)
    marks: list[str] = []
    explained: set[str] = set()
    while len(marks) < most and holders:
        gain = {g: len({d for d, w in at if w not in explained}) for g, at in holders.items()}
        gain = {g: n for g, n in gain.items() if n >= max(least, df[g] / 2)}  # the others' words are explained for the most part
        if not gain:
            break
        g = max(gain, key=lambda g: (chance[g] * gain[g] / df[g], len(g.strip("^$")), g))
        words = Counter(w for _, w in holders[g] if w not in explained)
        holders.pop(g)
        mark = _common(words, g)
        explained |= set(words) | {w for w in everything if mark in w}
        if mark not in marks and len(mark.strip("^$")) > 2:
            marks.append(mark)
    return marks


def _common(words: Counter, core: str) -> str:
    """core, prolonged by the characters that four fifths of the words have beside it."""
    for step in (1, -1):
        while True:
            beside: Counter = Counter()
            for w, n in words.items():
                at = w.find(core)
                if at >= 0:
                    k = at + len(core) if step > 0 else at - 1
                    beside[w[k] if 0 <= k < len(w) else ""] += n
            if not beside:
                return core
            c, n = beside.most_common(1)[0]
            if not c or n < 0.8 * sum(beside.values()):
                break
            core = core + c if step > 0 else c + core
    return core


def _disturbed(marks: list[str], rng: np.random.Generator) -> list[str]:
    """Landmarks with characters inserted or letters spaced out."""
    found = []
    letters = "abcdefghijklmnopqrstuvwxyz.*-_1"
    for mark in (m.strip("^$") for m in marks):
        found += [".".join(mark), "-".join(mark), "*".join(mark)]
        for _ in range(8):
            w = mark
            for _ in range(int(rng.integers(1, 3))):
                at = int(rng.integers(1, len(w)))
                w = w[:at] + letters[int(rng.integers(len(letters)))] + w[at:]
            found.append(w)
    return found


class Kernels:
    """Normalised subsequence kernels of words with landmarks.

    They are worked out where two pairs of characters that stand side by side in the landmark stand in the word with
    at most one character between them; elsewhere next to nothing is left of a kernel, and it is taken as 0.
    """

    PAIRS = 1 << 14

    def __init__(self, marks: list[str], settings: Settings) -> None:
        self.s, self.count = settings, len(marks)
        self.marks = _codes(marks, -2)
        self.own = np.sqrt(np.maximum(subsequence_kernel(self.marks, np.where(self.marks == -2, -4, self.marks), settings.order, settings.decay), 1e-12))
        self.held = np.zeros((self.PAIRS, len(marks)), np.uint8)  # which pairs of characters, by hash, a landmark has
        self.held[self._pair(self.marks[:, :-1], self.marks[:, 1:]), np.arange(len(marks))[:, None]] = 1
        self.held[self.PAIRS - 1] = 0
        self.gram = self._kernels(_codes(marks, -1)).astype(np.float64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of pairs of characters; padding has one of its own."""
        return np.where((a < 0) | (b < 0), self.PAIRS - 1, (a * 7919 + b * 31) % (self.PAIRS - 1))

    def _kernels(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.count), np.float32)
        if codes.shape[1] < self.s.order:
            return out
        common = np.zeros(out.shape, np.uint8)
        for gap in (1, 2):
            for at in self._pair(codes[:, :-gap], codes[:, gap:]).T:
                common += self.held[at]
        rows, columns = np.nonzero(common >= 2)
        for low in range(0, len(rows), 16384):
            r, c = rows[low : low + 16384], columns[low : low + 16384]
            used, at = np.unique(r, return_inverse=True)
            own = codes[used]
            norm = np.sqrt(np.maximum(subsequence_kernel(own, np.where(own == -1, -3, own), self.s.order, self.s.decay), 1e-12))
            out[r, c] = subsequence_kernel(own[at], self.marks[c], self.s.order, self.s.decay) / norm[at] / self.own[c]
        return out

    def of(self, words: list[str]) -> np.ndarray:
        """A row per word: the best kernels of its parts with each landmark."""
        part, step = self.s.part, self.s.part // 2
        number: dict[str, int] = {}  # of each different part
        uses, owner = [], []
        for i, word in enumerate(words):
            w = _bare(word)
            for read in (w,) if w[1:-1].isalpha() else (w, f"^{_NO_LETTER.sub('', w)}$"):
                for at in range(0, max(1, len(read) - step), step) if len(read) > part else (0,):
                    uses.append(number.setdefault(read[at : at + part], len(number)))
                    owner.append(i)
        parts = list(number)
        found = np.zeros((len(parts), self.count), np.float32)
        order = np.argsort([len(p) for p in parts], kind="stable")
        for at in range(0, len(order), 4096):
            block = order[at : at + 4096]
            found[block] = self._kernels(_codes([parts[i] for i in block], -1))
        owner, uses = np.array(owner, np.int64), np.array(uses, np.int64)
        if len(uses) == len(words):
            return found[uses]
        return np.maximum.reduceat(found[uses], np.flatnonzero(np.diff(owner, prepend=-1)))


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, of a linear machine with squared hinge loss, by Newton steps on the margin's violators."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = np.flatnonzero(y * (x @ w[:-1].astype(np.float32) + np.float32(w[-1])) < 1)
        left, right = ridge.copy(), np.zeros(len(w))
        for low in range(0, len(inside), 8192):  # so many violators at a time
            at = inside[low : low + 8192]
            xs = np.hstack([x[at], np.ones((len(at), 1))]).astype(np.float64)
            left += (xs * cost[at, None]).T @ xs
            right += xs.T @ (cost[at] * y[at])
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights, none below 0, of a logistic model with a small ridge, and its bias: a larger margin never makes a document likelier to be clean."""
    used = np.ones(x.shape[1], bool)
    while True:
        xs = np.hstack([x[:, used], np.ones((len(x), 1))]).astype(np.float64)
        ridge = np.array([0.05] * used.sum() + [1e-6])
        w = np.zeros(xs.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(xs @ w).clip(-30, 30)))
            step = np.linalg.solve((xs * (p * (1 - p) + 1e-6)[:, None]).T @ xs + np.diag(ridge), xs.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[:-1][used], out[-1] = w[:-1], w[-1]
            return out
        used[np.flatnonzero(used)[w[:-1].argmin()]] = False


def worst_three(margins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The means of the one, two and three largest margins of each document, whose sentences follow each other; absent ones are FLOOR."""
    out = np.full((len(counts), 3), FLOOR)
    ends = np.cumsum(counts)
    for row, end, n in zip(out, ends, counts):
        m = margins[end - n : end]
        top = np.sort(np.partition(m, n - 3)[-3:] if n > 3 else m)[::-1]
        row[: len(top)] = top
    return out.clip(FLOOR, -FLOOR).cumsum(axis=1) / [1, 2, 3]


@dataclass
class Model:
    kernels: Kernels | None
    weights: np.ndarray  # of a string's kernels, whitening included
    bias: float
    logistic: np.ndarray  # weights of what worst_three has, and the bias
    constant: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        return (self.kernels.of(words) @ self.weights + self.bias).astype(np.float32)

    def scores(self, worst: np.ndarray) -> np.ndarray:
        """Probabilities from rows of worst_three."""
        z = worst @ self.logistic[:-1] + self.logistic[-1]
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


class Scorer:
    """Scores of texts; a word's margin is worked out once while it is kept."""

    def __init__(self, model: Model, settings: Settings = Settings()) -> None:
        self.model, self.s = model, settings
        self.clear()

    def clear(self) -> None:
        self.sentences, self.margin = Sentences(self.s.sentence), np.zeros(0, np.float32)
        self.of_bare: dict[str, float] = {}  # words differ by the punctuation at their ends more often than not

    def _margins(self, words: list[str]) -> np.ndarray:
        bare = list(map(_bare, words))
        new = list({w: None for w in bare if w not in self.of_bare})
        if new:
            self.of_bare.update(zip(new, self.model.margins(new).tolist()))
        return np.array([self.of_bare[w] for w in bare], np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.kernels is None:
            return np.full(len(texts), self.model.constant)
        if max(len(self.margin), self.sentences.chars // 15) > self.s.kept_words:
            self.clear()
        at, starts, counts, fresh = self.sentences.cut(texts)
        if fresh:
            self.margin = np.concatenate([self.margin, self._margins(fresh)])
        worst = np.maximum.reduceat(self.margin[at], starts) if len(at) else np.zeros(0, np.float32)
        return self.model.scores(worst_three(worst, counts))


def fit(texts: list[str], toxic: list[int], settings: Settings = Settings()) -> Model:
    """The model of labelled texts."""
    s = settings
    y = np.array(toxic)
    if not (y == 1).any() or not (y == 0).any():
        return Model(None, np.zeros(0), 0.0, np.zeros(4), float((y == 1).mean()) if len(y) else 0.0)
    cut = Sentences(s.sentence)
    at, starts, counts, _ = cut.cut(texts)
    sizes, owner = np.diff(starts, append=len(at)), np.repeat(np.arange(len(texts)), counts)
    # Of each document the sentences of the smallest hashes: all of them but in very long ones.
    place = np.array([zlib.crc32(at[a : a + n].tobytes()) for a, n in zip(starts, sizes)])
    order = np.lexsort((place, owner))
    kept = np.zeros(len(starts), bool)
    kept[order] = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts) < s.train_sentences
    at, owner, sizes = at[np.repeat(kept, sizes)], owner[kept], sizes[kept]
    counts, starts = np.bincount(owner, minlength=len(texts)), np.cumsum(sizes) - sizes
    strings = list(cut.number)
    bare = [_bare(w) for w in strings]
    sets = [{bare[i] for i in part} for part in np.split(at, np.searchsorted(np.repeat(owner, sizes), np.arange(1, len(texts))))]
    bad, good = [w for w, k in zip(sets, y) if k], [w for w, k in zip(sets, y) if not k]
    marks = pick_landmarks(bad, good, s.landmarks - s.clean_landmarks, s.part)
    benign = sorted({w for words in good for w in words if 6 <= len(w) <= 12}, key=lambda w: (zlib.crc32(w.encode()), w))[: s.clean_landmarks]
    del sets, bad, good
    toxic_marks = len(marks)
    marks = list(dict.fromkeys([*marks, *benign])) or ["^$"]
    used, at = np.unique(at, return_inverse=True)
    bad_sentence = y[owner] == 1
    clean_times = np.bincount(at, weights=np.repeat(~bad_sentence, sizes), minlength=len(used))
    clean = np.flatnonzero(clean_times)
    disturbed = _disturbed(marks[:toxic_marks], np.random.default_rng(s.seed))
    kernels = Kernels(marks, s)
    k, more = kernels.of([strings[i] for i in used]), kernels.of(disturbed)
    margin = k[:, :toxic_marks].max(axis=1) - 0.8 if toxic_marks else k[:, 0]
    for last in (False, True):
        values, vectors = np.linalg.eigh(kernels.gram)
        keep = values > 1e-4
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        x, x_more, before = k @ whiten.astype(np.float32), more @ whiten.astype(np.float32), None
        for _ in range(s.rounds):
            worst = np.maximum.reduceat(margin[at], starts) if len(at) else np.zeros(0)
            most = np.full(len(texts), -np.inf)
            np.maximum.at(most, owner, worst)
            chosen = bad_sentence & ((worst > 0) | (worst == most[owner]))
            told = np.repeat(chosen, sizes) & (margin[at] == np.repeat(worst, sizes))
            times = np.bincount(at[told], minlength=len(used))
            if before is not None and (times == before).all():
                break
            before, positive = times, np.flatnonzero(times)
            # A string may be told by toxic sentences and stand in clean ones too: it is on both sides then.
            xs, ys = np.vstack([x[positive], x_more, x[clean]]), np.concatenate([np.ones(len(positive) + len(more)), -np.ones(len(clean))])
            cost = np.concatenate([times[positive].clip(max=100), np.full(len(more), s.disturbed), clean_times[clean].clip(max=100)]) * s.cost
            w = squared_hinge(xs, ys, cost)
            del xs
            margin = x @ w[:-1] + w[-1]
        if not last:  # once more, with the clean strings that came nearest as landmarks
            near = [_bare(strings[used[i]]) for i in clean[np.lexsort((clean, -margin[clean]))][: 8 * s.near_landmarks]]
            marks += [m for m in dict.fromkeys(near) if len(m) <= s.part and m not in marks][: s.near_landmarks]
            kernels = Kernels(marks, s)
            k, more = kernels.of([strings[i] for i in used]), kernels.of(disturbed)
    worst = worst_three(np.maximum.reduceat(margin[at], starts) if len(at) else np.zeros(0), counts)
    return Model(kernels, (whiten @ w[:-1]).astype(np.float32), float(w[-1]), logistic(worst, y))


# Jobs.


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of a bounded sample of labelled documents whose fold isn't 2."""
    s = settings
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).withColumn("place", hash52(F.col("doc_id"), F.lit("toxic")))
    part = lambda flag, most: known.filter(f"toxic = {flag}").orderBy("place", "doc_id").limit(most)
    sample = F.broadcast(part(1, s.train_toxic).unionByName(part(0, s.train_clean)))  # bounded by the settings
    rows = docs.select("doc_id", plain(F.col("text")).alias("text")).join(sample, "doc_id").select("doc_id", "toxic", "text", "place")
    # Rows that repeat a doc_id may be many; the bound holds for rows.
    rows = rows.orderBy("place", "doc_id", F.xxhash64("text")).limit(s.train_toxic + s.train_clean).collect()
    model = fit([r["text"] for r in rows], [int(r["toxic"]) for r in rows], s)
    del rows
    trim()
    return model


_WORKERS: dict[str, Scorer] = {}
KEPT_IN_WORKERS.append(_WORKERS)


def _scorer(key: str, model: Model, settings: Settings) -> Scorer:
    release(_WORKERS)
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Scorer(model, settings)
    return _WORKERS[key]


def score_rows(docs: DataFrame, model: Model, kept: Sequence[str] = ("doc_id",), settings: Settings = Settings()) -> DataFrame:
    """The columns `kept` of docs, as they are, plus held_out, score, predicted; none of them may have one of these names."""
    spark = docs.sparkSession
    given = docs.select("doc_id", "text", *[c for c in kept if c not in ("doc_id", "text")])
    at = [given.columns.index(c) for c in kept]
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, sent.value, settings)
        for batch in slices(batches):
            held = [fold(i) == 2 for i in batch.column(0).to_pylist()]
            scores = scorer.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in at], pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], [*kept, "held_out", "score", "predicted"])

    python_path(spark)
    new = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return given.mapInArrow(score, T.StructType([*[given.schema[c] for c in kept], *new]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    return score_rows(docs, train(docs, labels))
