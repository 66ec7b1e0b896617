"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Words belong to classes: each of the commonest words is a class of its own,
the others share a class with the words of the same ending. The model
predicts a token's class from the classes of the two tokens before it: the
context vector is the sum of their embeddings, each through a matrix of its
position; its products with the output embeddings, plus biases, give the scores. Training contrasts observed
classes with noise drawn from their frequencies; data are the counts of all
class trigrams of the training documents. A round takes stochastic gradients in passes over each share's trigrams, every one
with its count, the shares in parallel, and averages the shares' parameters. Shares hang on the trigrams alone.

A token's log-probability is that of its class, normalised over all
classes by batched matrix products, plus that of the word in its class: (c + 0.5) /
(N_class + 0.5 * (V_class + 1)), where the half stands for a word that training never saw.

Counts of the `head` commonest words (a bounded table) are sent to all workers; the other
words of a document meet their counts by a join.

Defined cases: a null or empty text has one token, its end; repeated rows get
the same score each; with no training documents at all, counts are 0 and every class is
as likely as its share of them allows (one class); an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEPT_IN_WORKERS, SLICE, id_text, python_path, release, slices, written

END = b""  # no word is empty


@dataclass(frozen=True)
class Settings:
    own_classes: int = 160
    ending_classes: int = 64
    ending_bytes: int = 3
    head: int = 100_000
    dims: int = 32
    noise: int = 64
    rounds: int = 4
    batch: int = 1024
    batches: int = 300
    shares: int = 8
    rate: float = 0.08
    seed: int = 17


def fold(doc_id: int | None, of: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of


class Classes(dict):
    """Class numbers of words, kept by word: the commonest words have their own, others one by ending, the last for rare endings."""

    KEPT = 200_000

    def __init__(self, own: list[bytes], endings: list[bytes], ending_bytes: int) -> None:
        self.n_own, self.by_ending, self.ending_bytes = len(own), {e: len(own) + i for i, e in enumerate(endings)}, ending_bytes
        self.rest = len(own) + len(endings)
        self.count = self.rest + 1
        self.own = {w: i for i, w in enumerate(own)}

    def __missing__(self, word: bytes) -> int:
        if (found := self.own.get(word)) is None:
            found = self.by_ending.get(word[-self.ending_bytes :], self.rest)
        self[word] = found
        return found

    def of(self, words: list[bytes]) -> list[int]:
        if len(self) > self.KEPT:
            self.clear()
        return [self[w] for w in words]


class LogBilinear:
    """Scores of a class from the two classes before it; class number `count` stands before the first token."""

    def __init__(self, count: int, dims: int, shares: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.count = count
        self.embed = rng.normal(0, 0.1, (count + 1, dims)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (count, dims)).astype(np.float32)
        self.position = np.stack([np.eye(dims), 0.5 * np.eye(dims)]).astype(np.float32)
        self.bias = np.log(shares).astype(np.float32)
        self.shares = shares

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.out, self.position, self.bias]

    def set(self, arrays: list[np.ndarray]) -> None:
        self.embed, self.out, self.position, self.bias = (a.astype(np.float32) for a in arrays)

    def context(self, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        return self.embed[before] @ self.position[0] + self.embed[before2] @ self.position[1]

    def log_probs(self, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        """Natural logarithms of all classes' probabilities, a row per context."""
        scores = self.context(before, before2) @ self.out.T + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def train(self, rows: np.ndarray, weights: np.ndarray, s: Settings, seed: int) -> None:
        """Noise-contrastive steps (Adagrad) in passes over all rows (before2, before, class) with their weights, until there were settings.batches at least."""
        rng = np.random.default_rng(seed)
        noise_through = np.cumsum(self.shares)
        log_noise = np.log(s.noise * self.shares).astype(np.float32)
        params = self.arrays()
        square = [np.full(p.shape, 1e-3, np.float32) for p in params]
        # A row of a count above the mean stands as often as it has means, so that no part weighs more than the mean.
        mean = max(1.0, float(weights.mean()))
        times = np.ceil(weights / mean).astype(np.int64)
        items, share = np.repeat(np.arange(len(rows)), times), (weights / times / mean).astype(np.float32)
        done, order = 0, items[:0]
        while done < s.batches or len(order):
            if not len(order):
                order = rng.permutation(items)
            pick, order = order[: s.batch], order[s.batch :]
            done += 1
            two, one, target = rows[pick].T
            noise = np.searchsorted(noise_through, rng.random(s.noise) * noise_through[-1]).clip(max=self.count - 1)
            part = share[pick] / share[pick].sum()
            e1, e2 = self.embed[one], self.embed[two]
            h = e1 @ self.position[0] + e2 @ self.position[1]
            true = (h * self.out[target]).sum(axis=1) + self.bias[target] - log_noise[target]
            false = h @ self.out[noise].T + self.bias[noise] - log_noise[noise]
            g_true = (1 - 1 / (1 + np.exp(-true.clip(-30, 30)))) * part
            g_false = -1 / (1 + np.exp(-false.clip(-30, 30))) * part[:, None]
            g_h = g_true[:, None] * self.out[target] + g_false @ self.out[noise]
            g = [np.zeros_like(p) for p in params]
            np.add.at(g[0], one, g_h @ self.position[0].T)
            np.add.at(g[0], two, g_h @ self.position[1].T)
            np.add.at(g[1], target, g_true[:, None] * h)
            np.add.at(g[1], noise, g_false.T @ h)
            g[2][0], g[2][1] = e1.T @ g_h, e2.T @ g_h
            np.add.at(g[3], target, g_true)
            np.add.at(g[3], noise, g_false.sum(axis=0))
            for p, d, q in zip(params, g, square):
                q += d * d
                p += s.rate * d / np.sqrt(q)


@dataclass
class Model:
    settings: Settings
    own: list[bytes]
    endings: list[bytes]
    head: list[bytes]
    head_counts: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray  # counts of the words of each class
    class_distinct: np.ndarray
    params: list[np.ndarray]

    def classes(self) -> Classes:
        return Classes(self.own, self.endings, self.settings.ending_bytes)

    @property
    def base_floor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def class_floor(self) -> np.ndarray:
        return self.class_total + 0.5 * (self.class_distinct + 1)


def count_words(docs: DataFrame, keeps) -> DataFrame:
    """(word, c): counts of all tokens, ends included, of the documents whose id keeps() accepts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "c"])
            found.clear()
            return batch

        release()
        for batch in slices(batches):
            for i, text in id_text(batch):
                if keeps(i):
                    found.update(text.lower().split())
                    found[END] += 1
            if len(found) > 200_000:
                yield out()
        yield out()

    python_path(docs.sparkSession)
    parts = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(count, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def count_trigrams(docs: DataFrame, keeps, classes: Classes) -> DataFrame:
    """(code, n): counts of class trigrams; code = (before2 * (count + 1) + before) * (count + 1) + class."""
    base = classes.count + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, 4 * SLICE):
            tokens: list[int] = []
            for i, text in id_text(batch):
                if keeps(i):
                    tokens += (base - 1, base - 1)
                    tokens += classes.of(text.lower().split())
                    tokens.append(classes[END])
            t = np.array(tokens, np.int64)
            code = (t[:-2] * base + t[1:-1]) * base + t[2:]
            code, n = np.unique(code[t[2:] != base - 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    python_path(docs.sparkSession)
    parts = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(count, "code long, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, keeps=lambda i: fold(i, 5) != 1, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model and the counts (word, c) of all training words."""
    s, spark = settings, docs.sparkSession
    words = written(count_words(docs, keeps), "word-counts")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.desc("c"), "word").limit(s.head).toArrow()  # at most settings.head rows
    head, head_counts = [bytes(w) for w in top.column("word").to_pylist()], top.column("c").to_numpy()
    own = head[: s.own_classes]
    if END not in own:
        own.append(END)
    rare = words.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w in own], "word binary")), "word", "left_anti")
    by_ending = rare.groupBy(F.expr(f"substring(word, -{s.ending_bytes}, {s.ending_bytes})").alias("ending")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    common = by_ending.orderBy(F.desc("c"), "ending").limit(s.ending_classes).collect()  # at most settings.ending_classes rows
    endings = [bytes(r["ending"]) for r in common]
    own_total = {w: int(c) for w, c in zip(head, head_counts)}
    if END not in own_total and (ends := words.filter(F.octet_length("word") == 0).first()):
        own_total[END] = ends["c"]
    class_total = [own_total.get(w, 0) for w in own] + [r["c"] for r in common]
    class_distinct = [int(w in own_total) for w in own] + [r["v"] for r in common]
    class_total.append(total - sum(class_total))
    class_distinct.append(distinct - sum(class_distinct))
    model = Model(s, own, endings, head, head_counts, total, distinct, np.array(class_total, float), np.array(class_distinct, float), [])

    classes = model.classes()
    shares = (model.class_total + 0.5) / (total + 0.5 * classes.count)
    net = LogBilinear(classes.count, s.dims, shares, s.seed)
    if total:
        grams = written(count_trigrams(docs, keeps, classes).withColumn("share", F.pmod(F.xxhash64("code"), F.lit(s.shares)).cast("int")), "trigrams")
        for number in range(s.rounds):
            net.set(_round(grams, net, s, number))
    model.params = net.arrays()
    return model, words


def _round(grams: DataFrame, net: LogBilinear, s: Settings, number: int) -> list[np.ndarray]:
    """Parameters after a round on each share of the trigram counts, averaged by the shares' counts; a row per share, of fixed size, comes back."""
    sizes = [a.size for a in net.arrays()]
    shapes = [a.shape for a in net.arrays()]
    base = net.count + 1
    sent = grams.sparkSession.sparkContext.broadcast(net)

    def fitted(share: int, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(code)
        code, n = code[order], n[order]
        own = LogBilinear.__new__(LogBilinear)
        own.__dict__.update(sent.value.__dict__)
        own.set([a.copy() for a in own.arrays()])
        own.train(np.stack([code // (base * base), code // base % base, code % base], axis=1), n, s, (s.seed * 1009 + number) * 1009 + share)
        return pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([np.concatenate([a.ravel() for a in own.arrays()]).tobytes()], pa.binary()), pa.array([int(n.sum())], pa.int64())], ["share", "p", "n"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, held = None, []
        for batch in batches:
            share, code, n = (batch.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.diff(share, prepend=-1))
            for low, high in zip(starts, [*starts[1:], len(share)]):
                if share[low] != now:
                    if held:
                        yield fitted(int(now), *map(np.concatenate, zip(*held)))
                    now, held = share[low], []
                held.append((code[low:high], n[low:high]))
        if held:
            yield fitted(int(now), *map(np.concatenate, zip(*held)))

    # The shares hang on the codes alone, not on files or partitions; each has at most (classes + 1)^3 / shares codes.
    dealt = grams.select("share", "code", "n").repartition(s.shares, "share").sortWithinPartitions("share")
    rows = dealt.mapInArrow(step, "share int, p binary, n long").collect()  # at most settings.shares rows
    rows = sorted(rows, key=lambda r: r["share"])
    mean = sum(np.frombuffer(r["p"], np.float32).astype(np.float64) * r["n"] for r in rows) / sum(r["n"] for r in rows)
    return [part.reshape(shape) for part, shape in zip(np.split(mean, np.cumsum(sizes)[:-1]), shapes)]


class _Scorer:
    """A worker's tables: log10 probabilities of all classes in all contexts, and of the head's words in their classes."""

    def __init__(self, model: Model) -> None:
        self.classes = model.classes()
        count = self.count = self.classes.count
        net = LogBilinear.__new__(LogBilinear)
        net.count = count
        net.set(model.params)
        base = count + 1
        self.table = np.empty((base * base, count), np.float32)
        ones = np.arange(base)
        for two in range(base):
            self.table[two * base : (two + 1) * base] = net.log_probs(ones, np.full(base, two)) / np.log(10)
        self.number = {w: i for i, w in enumerate(model.head)}
        self.head_class = np.array(self.classes.of(model.head) or [0])
        counts = np.asarray(model.head_counts if len(model.head) else [0], float)
        self.head_base = np.log10((counts + 0.5) / model.base_floor)
        self.head_word = np.where(self.head_class < self.classes.n_own, 0.0, np.log10((counts + 0.5) / model.class_floor()[self.head_class]))

    def document(self, text: bytes) -> tuple[int, int, float, float, Counter]:
        """n_tokens, known ones among the head, their base score, score without the other words' share, and the other words."""
        words = text.lower().split()
        words.append(END)
        number = self.number
        ids = np.array([number.get(w, -1) for w in words])
        known = ids >= 0
        cls = np.where(known, self.head_class[ids], 0)
        other = [words[i] for i in np.flatnonzero(~known)]
        cls[~known] = [self.classes[w] for w in other]
        if len(self.classes) > Classes.KEPT:
            self.classes.clear()
        padded = np.concatenate([[self.count, self.count], cls])
        by_class = self.table[padded[:-2] * (self.count + 1) + padded[1:-1], cls].sum(dtype=np.float64)
        at = ids[known]
        return len(words), int(known.sum()), float(self.head_base[at].sum()), float(by_class + self.head_word[at].sum()), Counter(other)


_SCORERS: dict[str, _Scorer] = {}
KEPT_IN_WORKERS.append(_SCORERS)


def _scorer(key: str, sent) -> _Scorer:
    release(_SCORERS)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = _Scorer(sent.value)
    return _SCORERS[key]


def score_documents(docs: DataFrame, model: Model, words: DataFrame, held_out=lambda i: fold(i, 5) == 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, sent)
        uid = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            uids, flags, rows, rest, times, ends = [], [], [], [], [], [0]
            for i, text in id_text(batch):
                n, known, base, value, other = scorer.document(text)
                uids.append(uid)
                uid += 1
                flags.append(held_out(i))
                rows.append((n, known, base, value))
                rest += other.keys()
                times += other.values()
                ends.append(len(rest))
            longs = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]
            doubles = [pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3)]
            flat = [pa.array(rest, pa.binary()), pa.array(times, pa.int64()), pa.array(scorer.classes.of(rest), pa.int32())]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["word", "n", "class"]))
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), batch.column(0), pa.array(flags, pa.bool_()), *longs, *doubles, lists], ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "value", "rest"])

    python_path(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(score, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, value double, rest array<struct<word: binary, n: bigint, class: int>>")
    parts = written(parts, "head-scores")
    rest = parts.select("uid", F.inline("rest"))
    floors = F.array(*[F.lit(float(x)) for x in model.class_floor()])
    n_own = len(model.own)
    found = rest.join(words, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    in_class = F.when(F.col("class") < n_own, F.lit(0.0)).otherwise(F.log10((F.col("c") + 0.5) / F.element_at(floors, F.col("class") + 1)))
    more = found.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(model.base_floor))).alias("more_base"),
        F.sum(F.col("n") * in_class).alias("more"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return parts.drop("rest").join(more, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("known", "more_known").cast("long").alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        plus("value", "more").alias("score"),
    )


def score_corpus(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the documents of folds other than 1 of 5 and score all."""
    model, words = train(docs, settings=settings)
    return score_documents(docs, model, words)
