"""Exact n-gram Jaccard self-join by signature trees, and its components.

1. Documents of equal shingle sets form a class (a 128-bit digest of the sorted set);
   from here on each class stands for all its copies.
2. Of a set A that is linked with another, at most |A| - ceil(t |A|) shingles are missing there. The first 35 percent
   of each set in the order of the hashes meet by shingle; a class with more shingles among these that no other class posts is linked with nothing and goes.
3. Two sets of similarity t or more share one of the first |A| - ceil(t |A|) + 1
   shingles of each, in any order that all sets follow (prefix filter). The shingles of the classes that are left
   are counted over all of these, batch by batch, and their prefixes are taken with the rarest first. Those that one class
   holds alone can't be shared, so only the prefix's others are posted: nothing at all for a class a quarter of which is its own.
4. Classes that share a posted shingle are chained to one of them, and the
   components of these chains are blocks: no link leaves a block, and no pairs are made.
5. Each block meets in one task with its whole sets; blocks beyond `tile` shingles are dealt
   in chunks, every two of which meet. There a signature tree (nodes
   hold OR-combined bitmaps, size ranges and least bit counts) is traversed against itself:
   node pairs are left where sizes or bitmaps rule out the similarity, or where
   all their documents are linked already. Surviving pairs are counted exactly.
6. Links found (enough to span each component) give components by alternating
   large-star and small-star steps.

Nothing that grows with the documents is broadcast or collected; in steps 2 and 3 a batch sends a shingle once, however many of its documents hold it.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; shingles are 64-bit hashes of five words; fewer
words are one shingle. Defined cases: null texts and texts without
words have no shingles, are linked with nothing and are their own
component; copies and repeated rows are linked; null ids join the component of their text (whose id is null
only if all its ids are); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEPT_IN_WORKERS, id_text, parallelism, python_path, release, slices, written

SHINGLE = 5
PERCENT = 75
#: Share of a set that meets the others' first, in percent.
FIRST = 35
#: Shingles per chunk of a block (8 bytes each).
TILE = 4_000_000
#: At most so many classes (a few numbers each) are sent to all workers to pick their documents.
BROADCAST_CLASSES = 500_000

_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Hashes of words, computed once per word."""

    KEPT = 250_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hash = np.zeros(0, np.uint64)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.number) > self.KEPT:
            self.clear()
        number, fresh, out = self.number, [], []
        for text in texts:
            words = text.lower().split()
            ids = [number.get(w, -1) for w in words]
            if -1 in ids:
                for i, x in enumerate(ids):
                    if x < 0:
                        w = words[i]
                        if (k := number.get(w)) is None:
                            k = number[w] = len(number)
                            fresh.append(w)
                        ids[i] = k
            out.append(np.array(ids, np.int64))
        if fresh:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
            self.hash = np.concatenate([self.hash, h])
        return out

    def shingles(self, ids: np.ndarray, width: int = SHINGLE) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        if not len(ids):
            return np.zeros(0, np.uint64)
        w = self.hash[ids]
        width = min(width, len(ids))
        n = len(ids) - width + 1
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h += w[k : k + n] * _POWERS[k]
        h = np.sort(_mix(h))
        new = np.ones(n, bool)
        new[1:] = h[1:] != h[:-1]
        return h[new]


_WORDS: dict[str, Words] = {}
KEPT_IN_WORKERS.append(_WORDS)


def _words() -> Words:
    release(_WORDS)
    return _WORDS.setdefault("words", Words())


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _keep(n: int, percent: int) -> int:
    """Length of a prefix."""
    return n - -(-n * percent // 100) + 1 if n else 0


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of equal key, which follow each other."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now:
                if held:
                    yield now, held
                now, held = row[key], []
            held.append(row)
    if held:
        yield now, held


def _u8(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint64)


def _by_block(block: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Each block's parts of the arrays, as bytes."""
    order = np.argsort(block, kind="stable")
    used, starts = np.unique(block[order], return_index=True)
    for b, low, high in zip(used.tolist(), starts, [*starts[1:], len(order)]):
        yield b, [a[order[low:high]].tobytes() for a in arrays]


def shingle_sets(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, digest of the set, and first (its first shingles by hash, as bytes) of each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words()
        for batch in slices(batches):
            size, digest, first = [], [], []
            for ids in words.ids([t for _, t in id_text(batch)]):
                h = words.shingles(ids)
                size.append(len(h))
                digest.append(_digest(h) if len(h) else None)
                first.append(h[: max(_keep(len(h), percent), -(-len(h) * FIRST // 100))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(first, pa.binary())], ["doc_id", "n", "digest", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(read, f"doc_id {kind}, n long, digest binary, first binary")


_NOBODY = 0xFFFF


def near_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(cid): the classes (cid, n, first) that may be linked: enough of their first shingles are posted by other classes too.

    Classes post in batches, a shingle once per batch; shingles' blocks tell each batch which of its shingles other batches have.
    """
    spark = sets.sparkSession
    parts = parallelism(spark)
    blocks = 2 * parts
    schema = "block int, batch long, h binary, at binary, cid binary, need binary"
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 4096):
            firsts = batch.column(2).to_pylist()
            size = np.array([len(p) // 8 for p in firsts])
            need = size - np.array([_keep(n, percent) - 1 for n in batch.column(1).to_pylist()])
            h, at = _u8(firsts), np.repeat(np.arange(len(size)), size)
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(starts, append=len(h))
            need -= np.bincount(at[np.repeat(times > 1, times)], minlength=len(size))
            at = np.where(times > 1, _NOBODY, at[starts]).astype("<u2")
            h = h[starts]
            rows = [(number % blocks, number, None, None, batch.column(0).to_numpy().tobytes(), need.astype("<i4").tobytes())]
            rows += [(b, number, *x, None, None) for b, x in _by_block(h % np.uint64(blocks), h, at)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "batch", "h", "at", "cid", "need"])
            number += 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b, rows in _groups(batches, "block"):
            posts = [r for r in rows if r["h"] is not None]
            h = _u8([r["h"] for r in posts])
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            shared = np.zeros(len(h), bool)
            shared[order[1:][same]] = True
            shared[order[:-1][same]] = True
            out, low = [(b, r["batch"], None, None, r["cid"], r["need"]) for r in rows if r["h"] is None], 0
            for r in posts:
                at = np.frombuffer(r["at"], "<u2")
                at = at[shared[low : low + len(at)] & (at != _NOBODY)]
                low += len(r["at"]) // 2
                if len(at):
                    out.append((b, r["batch"], None, at.tobytes(), None, None))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "batch", "h", "at", "cid", "need"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for _, rows in _groups(batches, "batch"):
            own = next(r for r in rows if r["cid"] is not None)
            need = np.frombuffer(own["need"], "<i4")
            told = np.frombuffer(b"".join(r["at"] for r in rows if r["at"] is not None), "<u2")
            near = np.bincount(told, minlength=len(need)) >= need
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(own["cid"], np.int64)[near])], ["cid"])

    sent = sets.select("cid", "n", "first").mapInArrow(post, schema).repartition(parts, "block").sortWithinPartitions("block").mapInArrow(meet, schema)
    return sent.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(tell, "cid long")


def class_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, batch, h): the whole sets of the classes (cid, rep, digest), read from their documents' texts; batches number rows that follow each other."""
    wanted = classes.select(F.col("rep").alias("_rep"), "cid", "digest")
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    picked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("doc_id", "text", "cid", "digest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, number, held = _words(), TaskContext.get().partitionId() << 33, 0
        for batch in slices(batches):
            rows = []
            for ids, cid, digest in zip(words.ids([t for _, t in id_text(batch)]), *(batch.column(k).to_pylist() for k in (2, 3))):
                h = words.shingles(ids)
                if _digest(h) == digest:  # else another text under the same doc_id
                    rows.append((cid, number, h.tobytes()))
                    held += len(h)
                    if held > TILE // 4:
                        number, held = number + 1, 0
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["cid", "batch", "h"])

    return picked.mapInArrow(read, "cid long, batch long, h binary")


def posted(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, prefix): what the classes (cid, batch, h) post, the rarest shingles first, those of one class alone left out.

    Each batch of classes asks the shingles' blocks for the counts of its
    shingles; only those of two classes or more come back.
    """
    spark = sets.sparkSession
    parts = parallelism(spark)
    blocks = 2 * parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for number, rows in _groups(batches, "batch"):
            h, n = np.unique(_u8([r["h"] for r in rows]), return_counts=True)
            found = [(b, number, *x) for b, x in _by_block(h % np.uint64(blocks), h, n.astype("<u4"))]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["block", "batch", "h", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for _, rows in _groups(batches, "block"):
            h, n = _u8([r["h"] for r in rows]), np.frombuffer(b"".join(r["n"] for r in rows), "<u4")
            key, at = np.unique(h, return_inverse=True)
            total = np.bincount(at, weights=n).astype("<u4")[at]
            found, low = [], 0
            for r in rows:
                high = low + len(r["h"]) // 8
                more = np.flatnonzero(total[low:high] > 1) + low
                if len(more):
                    found.append((r["batch"], h[more].tobytes(), total[more].tobytes()))
                low = high
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["batch", "h", "n"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for _, rows in _groups(batches, "batch"):
            told = [r for r in rows if r["cid"] is None]
            key, n = _u8([r["h"] for r in told]), np.frombuffer(b"".join(r["n"] for r in told), "<u4")
            order = np.argsort(key)
            key, n = key[order], n[order]
            cids, prefixes = [], []
            for r in rows:
                if r["cid"] is None or not len(key):
                    continue
                h = np.frombuffer(r["h"], np.uint64)
                at = np.searchsorted(key, h).clip(max=len(key) - 1)
                more = key[at] == h
                left = _keep(len(h), percent) - int((~more).sum())
                if left > 0:
                    h, times = h[more], n[at[more]]
                    cids.append(r["cid"])
                    prefixes.append(h[np.lexsort((h, times))[:left]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(prefixes, pa.binary())], ["cid", "prefix"])

    dealt = sets.select("batch", "h").mapInArrow(ask, "block int, batch long, h binary, n binary")
    told = dealt.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(answer, "batch long, h binary, n binary")
    both = sets.select("cid", "batch", "h", F.lit(None).cast("binary").alias("n")).unionByName(told.withColumn("cid", F.lit(None).cast("long")))
    return both.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(pick, "cid long, prefix binary")


def _runs(h: np.ndarray, cid: np.ndarray, last: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For sorted h: whether a run of equal values begins, and each run's first cid; last is the value and first cid of the run before."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[0] = h[0] != last[0]
    first, run = cid[np.flatnonzero(new)], np.cumsum(new) - 1
    if not new[0]:
        first, run = np.concatenate([[last[1]], first]), run + 1
    return new, first[run]


def chains(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all classes with a common posted shingle: first within each batch, which then posts the shingle once, then between batches."""
    spark = classes.sparkSession

    def edges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column(1).to_pylist()
            h = np.frombuffer(b"".join(prefixes), np.uint64)
            if not len(h):
                continue
            cid = np.repeat(batch.column(0).to_numpy(), [len(p) // 8 for p in prefixes])
            order = np.argsort(h, kind="stable")
            h, cid = h[order], cid[order]
            new, first = _runs(h, cid, (h[0] ^ np.uint64(1), -1))
            pairs = edges(cid[~new], first[~new])
            shingle = pa.concat_arrays([pa.array(_signed(h[new])), pa.nulls(len(pairs), pa.int64())])
            a = np.concatenate([cid[new], pairs[:, 0]])
            b = pa.concat_arrays([pa.nulls(int(new.sum()), pa.int64()), pa.array(pairs[:, 1])])
            yield pa.RecordBatch.from_arrays([shingle, pa.array(a), b], ["h", "a", "b"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            h, cid = (batch.column(k).to_numpy() for k in range(2))
            if not len(h):
                continue
            new, first = _runs(h, cid, last)
            last = (h[-1], first[-1])
            pairs = edges(cid[~new], first[~new])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = written(classes.select("cid", "prefix").mapInArrow(post, "h long, a long, b long"), "postings", "zstd")
    dealt = rows.filter("b IS NULL").select("h", "a").repartition(parallelism(spark), "h").sortWithinPartitions("h", "a")
    return rows.filter("b IS NOT NULL").select("a", "b").unionByName(dealt.mapInArrow(chain, "a long, b long")).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): each node of the edges (a, b) with the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each round
    written to the shared folder; the rounds end when one changes nothing.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if small:
            # all b are below a
            moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            return moved.unionByName(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()
        return joined.filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = written(e, "edges")
    for _ in range(most):
        before, e = e, written(star(star(e, small=False), small=True), "edges")
        if e.count() == before.count() and e.join(before, ["a", "b"], "left_anti").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components have not settled in {most} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


class SignatureTree:
    """Sets as leaves of a tree whose nodes hold OR-combined bitmaps, size ranges and the least number of bits of a set."""

    LEAF, FAN = 16, 8

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        bits = 1 << int(np.clip(np.ceil(np.log2(4 * max(1, np.median(self.sizes)))), 9, 13))
        self.bitmaps = np.zeros((len(sets), bits // 64), np.uint64)
        row = np.zeros(bits, bool)
        for at, s in enumerate(sets):
            row[:] = False
            row[(s >> np.uint64(24)) & np.uint64(bits - 1)] = True
            self.bitmaps[at] = np.packbits(row).view(np.uint64)
        counts = np.bitwise_count(self.bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [self._combine(self.bitmaps, self.sizes, self.sizes, counts, self.LEAF)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._combine(*self.levels[-1], self.FAN))

    @staticmethod
    def _combine(bitmaps: np.ndarray, least: np.ndarray, most: np.ndarray, counts: np.ndarray, fan: int) -> tuple:
        starts = np.arange(0, len(bitmaps), fan)
        return np.bitwise_or.reduceat(bitmaps, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts), np.minimum.reduceat(counts, starts)

    def apart(self, level: int, x: int, y: int, t: float) -> bool:
        """Whether no set below node x reaches similarity t with one below node y."""
        bitmaps, least, most, counts = self.levels[level]
        if most[x] < t * least[y] or most[y] < t * least[x]:
            return True
        common = int(np.bitwise_count(bitmaps[x] & bitmaps[y]).sum())
        lone_x, lone_y = max(0, counts[x] - common), max(0, counts[y] - common)
        # at least so many members of any set below one node have no partner below the other
        return most[x] - lone_x < t * (least[y] + lone_x) - 1e-9 or most[y] - lone_y < t * (least[x] + lone_y) - 1e-9


def tree_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that span the components of all pairs of sorted sets with similarity of at least percent/100."""
    count = len(sets)
    if count < 2:
        return []
    order = sorted(range(count), key=lambda i: (int(sets[i][0]), len(sets[i])))
    sets = [sets[i] for i in order]
    tree, t = SignatureTree(sets), percent / 100
    sizes, root, links = tree.sizes, np.arange(count), []
    members = [[i] for i in range(count)]  # of each root
    width = [tree.LEAF * tree.FAN**k for k in range(len(tree.levels))]
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, x, y = stack.pop()
        a, b = slice(x * width[level], (x + 1) * width[level]), slice(y * width[level], (y + 1) * width[level])
        first = root[a.start]
        if (root[a] == first).all() and (root[b] == first).all() or x != y and tree.apart(level, x, y, t):
            continue
        if level:
            below = len(tree.levels[level - 1][0])
            xs, ys = range(x * tree.FAN, min(below, (x + 1) * tree.FAN)), range(y * tree.FAN, min(below, (y + 1) * tree.FAN))
            # the last put is the first taken: nodes meet themselves first, which links close sets early
            stack += [(level - 1, i, j) for i in xs for j in ys if i < j]
            stack += [(level - 1, i, i) for i in xs] if x == y else []
            continue
        ma, mb = tree.bitmaps[a][:, None, :], tree.bitmaps[b][None, :, :]
        na, nb = sizes[a][:, None], sizes[b][None, :]
        overlap = np.minimum(na - np.bitwise_count(ma & ~mb).sum(axis=2, dtype=np.int64), nb - np.bitwise_count(mb & ~ma).sum(axis=2, dtype=np.int64))
        may = (100 * overlap >= percent * (na + nb - overlap)) & (root[a][:, None] != root[b][None, :])
        for i, j in np.argwhere(np.triu(may, 1) if x == y else may) + (a.start, b.start):
            if root[i] == root[j]:
                continue
            p, q = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
            both = int((q[np.searchsorted(q, p).clip(max=len(q) - 1)] == p).sum())
            if 100 * both >= percent * (len(p) + len(q) - both):
                links.append((order[i], order[j]))
                into, gone = (root[i], root[j]) if len(members[root[i]]) >= len(members[root[j]]) else (root[j], root[i])
                root[members[gone]] = into
                members[into] += members[gone]
                members[gone] = []
    return links


def block_links(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes (cid, h), within their blocks (node, label)."""
    spark = sets.sparkSession
    held = blocks.select(F.col("node").alias("cid"), "label").join(sets.select("cid", "h"), "cid").withColumn("n", F.octet_length("h") / 8)
    shares = blocks.select(F.col("node").alias("cid"), "label").join(sets.select("cid", (F.octet_length("h") / 8).alias("n")), "cid")
    shares = written(shares.groupBy("label").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("chunks")).filter("chunks > 1"), "shares")  # blocks of over TILE shingles
    own = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(own, k) * F.col("chunks") + F.greatest(own, k))
    tiles = held.join(shares, "label", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).select("label", F.explode(meets).alias("tile"), "cid", "h")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, cids, sets = None, [], []

        def out() -> pa.RecordBatch:
            found = [(cids[i], cids[j]) for i, j in tree_links(sets, percent)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for label, tile, cid, h in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (label, tile) != now:
                    if len(sets) > 1:
                        yield out()
                    now, cids, sets = (label, tile), [], []
                cids.append(cid)
                sets.append(np.frombuffer(h, np.uint64))
        if len(sets) > 1:
            yield out()

    tiles = tiles.repartition(parallelism(spark), "label", "tile").sortWithinPartitions("label", "tile")
    return tiles.mapInArrow(link, "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    python_path(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets = written(shingle_sets(docs, percent).withColumn("row", F.monotonically_increasing_id()), "sets")
    # A class is numbered by one of its rows.
    classes = written(sets.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("row").alias("cid"), F.count("*").alias("copies")), "classes")
    copies = written(sets.select("digest", "row").join(classes.filter("copies > 1"), "digest").filter("row <> cid").select(F.col("row").alias("cid")), "copies")
    if copies.count() <= BROADCAST_CLASSES:
        copies = F.broadcast(copies)
    near = near_classes(sets.filter("n > 0").select(F.col("row").alias("cid"), "n", "first").join(copies, "cid", "left_anti"), percent)
    wanted = written(classes.join(near, "cid"), "near")
    whole = written(class_sets(docs, wanted), "class-sets")
    if whole.count() > wanted.count():  # rows that repeat a doc_id and its text
        whole = written(whole.dropDuplicates(["cid"]), "class-sets")
    blocks = components(chains(posted(whole, percent)))
    labels = components(written(block_links(whole, blocks, percent), "links"))
    named = classes.select("digest", "rep", "cid").join(labels, F.col("cid") == F.col("node"), "left").select("digest", "rep", F.coalesce("label", "cid").alias("label"))
    named = written(named, "named")
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    named = named.join(least, "label").select("digest", "component")
    return sets.select("doc_id", "n", "digest").join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )
