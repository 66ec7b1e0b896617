"""Ranked lexical search over an inverted index: accumulators for short lists, documents at a time over long ones.

The index is a table of segments: the documents of one stretch of a task, at most SEGMENT_DOCS of them or about SEGMENT_WORDS words,
with their sorted terms and postings. It holds all terms of all documents, asks for no shuffle, and is written once; searches read it.

In each segment a query's short lists are summed term by term into one list of accumulators. From then on that list is one more
iterator with a bound, beside those of the long lists, and documents are taken in blocks: a block whose bounds together can't reach the
query's k-th best score so far is skipped, the others best bound first; within a block, a document is let go as soon as what it has and
the bounds of the lists still to come fall short. The k-th best score is carried from segment to segment of a task. Each task returns
its k best of each query, and the best of all tasks are taken by query.

Queries go to the tasks in shares of about QUERY_BYTES of text, so what is broadcast is bounded whatever their number.

Defined cases: null and empty texts have no terms and are never found; a query without terms finds nothing; rows that repeat a
document are found one by one; a null doc_id is a document like others and sorts first; empty tables give an empty result; further columns are ignored.
Scores are exact integers; ties go to the smaller doc_id.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import python_path, release, slices, written

SEGMENT_DOCS, SEGMENT_WORDS, BLOCK = 2048, 1_500_000, 64
#: A list is short if it has at most 1 / SHORT of a segment's documents.
SHORT, QUERY_BYTES = 16, 1 << 22

#: A-Z become lower case; other ASCII than letters and digits becomes a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(_TERMS).split()


def build_index(docs: DataFrame) -> DataFrame:
    """Segments: doc_ids, n (terms of each document), terms (sorted, joined by spaces), df (of each term), at and tf (postings: place in doc_ids, occurrences), n_docs (with any term), n_terms."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_ids", "n", "terms", "df", "at", "tf", "n_docs", "n_terms"]

    def segment(ids: list, lengths: list[int], numbers: dict[bytes, int], runs: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        terms = sorted(numbers)
        place = np.empty(len(terms), np.int64)
        place[[numbers[t] for t in terms]] = np.arange(len(terms))
        n = np.array(lengths, np.int64)
        keys = place[np.concatenate([np.zeros(0, np.int64), *runs])] * len(ids) + np.repeat(np.arange(len(ids)), n)
        pairs, tf = np.unique(keys, return_counts=True)
        df = np.bincount(pairs // len(ids), minlength=len(terms))
        blobs = [n.tobytes(), b" ".join(terms), df.astype("<i4").tobytes(), (pairs % len(ids)).astype("<i4").tobytes(), tf.astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_type)), *[pa.array([b], pa.binary()) for b in blobs], pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], names)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ids, lengths, numbers, runs, words = [], [], {}, [], 0
        id_type = None
        for batch in slices(batches, 128):
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text or b"")
                for t in set(found).difference(numbers):
                    numbers[t] = len(numbers)
                runs.append(np.array([*map(numbers.__getitem__, found)], np.int64))
                ids.append(doc_id)
                lengths.append(len(found))
                words += len(found)
                if len(ids) >= SEGMENT_DOCS or words >= SEGMENT_WORDS:
                    yield segment(ids, lengths, numbers, runs, id_type)
                    ids, lengths, numbers, runs, words = [], [], {}, [], 0
        if ids:
            yield segment(ids, lengths, numbers, runs, id_type)

    python_path(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(built, f"doc_ids array<{kind}>, n binary, terms binary, df binary, at binary, tf binary, n_docs long, n_terms long")


def document_counts(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the terms."""
    sent = index.sparkSession.sparkContext.broadcast(sorted(terms))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches, 1):
            have, df = batch.column(0)[0].as_py().split(), np.frombuffer(batch.column(1)[0].as_py(), "<i4")
            for t in sent.value:
                k = bisect_left(have, t)
                if k < len(have) and have[k] == t:
                    found[t] += int(df[k])
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["term", "df"])

    rows = index.select("terms", "df").mapInArrow(counted, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # at most the terms asked for
    return {bytes(r["term"]): r["df"] for r in rows}


class Best:
    """The k best (score, doc_id) of one query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        """Documents whose scores are at least `least`."""
        if len(scores) > self.k:  # only the k-th score and what is above or equal can enter
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= kth
            scores, docs = scores[keep], docs[keep]
        self.rows += [(-s, ids[d] is not None, ids[d]) for s, d in zip(scores.tolist(), docs.tolist())]
        self.rows.sort()
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.least = max(1, -self.rows[-1][0])


class Segment:
    """One row of the index, read for searches of a corpus of n_docs documents with n_terms terms."""

    def __init__(self, row: dict, n_docs: int, n_terms: int) -> None:
        self.ids, self.terms = row["doc_ids"], row["terms"].split()
        n = np.frombuffer(row["n"], np.int64)
        self.length_part = 8 * (25 + 75 * n * n_docs // n_terms)  # 8 m
        df = np.frombuffer(row["df"], "<i4")
        self.ends = np.cumsum(df)
        self.at, self.tf = np.frombuffer(row["at"], "<i4"), np.frombuffer(row["tf"], "<i4")
        self.blocks = -(-len(self.ids) // BLOCK)
        self.short: dict[bytes, tuple[np.ndarray, np.ndarray] | None] = {}
        self.long: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def open(self, term: bytes) -> None:
        """Work out a term's impacts once: a short list as it stands, a long one by document, with the largest of each block."""
        if term in self.short or term in self.long:
            return
        k = bisect_left(self.terms, term)
        if k == len(self.terms) or self.terms[k] != term:
            self.short[term] = None
            return
        low, high = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        docs, tf = self.at[low:high], self.tf[low:high].astype(np.int64)
        impacts = 1_000_000_000 * tf // (1000 * tf + self.length_part[docs])
        if len(docs) * SHORT <= len(self.ids):
            self.short[term] = (docs, impacts)
        else:
            dense = np.zeros(self.blocks * BLOCK, np.int64)
            dense[docs] = impacts
            self.long[term] = (dense, dense.reshape(-1, BLOCK).max(axis=1))

    def search(self, query: list[tuple[bytes, int]], best: Best) -> None:
        """query: terms with weight times occurrences."""
        sums = np.zeros(self.blocks * BLOCK, np.int64)
        lists = []
        for term, weight in query:
            self.open(term)
            if term in self.long:
                dense, tops = self.long[term]
                lists.append((int(tops.max()) * weight, weight, dense, tops))
            elif found := self.short[term]:
                sums[found[0]] += weight * found[1]
        # The accumulators are one iterator among the others, with its own bounds by block.
        bounds = sums.reshape(-1, BLOCK).max(axis=1)
        for _, weight, _, tops in lists:
            bounds += weight * tops
        lists.sort(key=lambda x: -x[0])
        to_come = np.cumsum([0, *(x[0] for x in reversed(lists))])[::-1].tolist()
        order = np.argsort(-bounds, kind="stable")
        at, step = 0, 1
        while at < len(order) and bounds[order[at]] >= best.least:
            some = order[at : at + step]
            some = some[bounds[some] >= best.least]
            docs = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            scores = sums[docs]
            for k, (_, weight, dense, _) in enumerate(lists):
                alive = scores + to_come[k] >= best.least
                if not alive.all():
                    docs, scores = docs[alive], scores[alive]
                scores = scores + weight * dense[docs]
            good = scores >= best.least
            if good.any():
                best.add(scores[good], docs[good], self.ids)
            at, step = at + step, step * 2


def search_index(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the index for each item's text."""
    spark = index.sparkSession
    size = index.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms"), F.count("*")).first()
    items = items.select("item_id", F.col("text").cast("binary").alias("text"))
    asked = items.agg(F.sum(F.length("text")).alias("bytes")).first()["bytes"] or 0
    shares = asked // QUERY_BYTES + 1
    item_kind, doc_kind = items.schema["item_id"].dataType, index.schema["doc_ids"].dataType.elementType
    item_type = to_arrow_type(item_kind)
    schema = f"item_id {item_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score long"
    found = spark.createDataFrame([], schema)
    python_path(spark)
    for share in range(shares if size["n_terms"] else 0):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)) == share).collect()
        found = found.unionByName(_share(index, rows, size, k, schema, item_type))
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _share(index: DataFrame, rows: list[Row], size: Row, k: int, schema: str, item_type: pa.DataType) -> DataFrame:
    asked = [(r["item_id"], Counter(terms_of(bytes(r["text"] or b"")))) for r in rows]
    df = document_counts(index, sorted({t for _, terms in asked for t in terms}))
    n_docs, n_terms = size["n_docs"], size["n_terms"]
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    queries = [(item, [(t, times * weights[t]) for t, times in sorted(terms.items()) if weights.get(t)]) for item, terms in asked]
    sent = index.sparkSession.sparkContext.broadcast([q for q in queries if q[1]])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        best = [Best(k) for _ in sent.value]
        kinds = None
        for batch in slices(batches, 1):
            kinds = batch.schema.field("doc_ids").type.value_type
            segment = Segment(batch.to_pylist()[0], n_docs, n_terms)
            for (_, query), own in zip(sent.value, best):
                segment.search(query, own)
        if kinds is not None:
            out = [(item, doc_id, -score) for (item, _), own in zip(sent.value, best) for score, _, doc_id in own.rows]
            items, docs, scores = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(items, item_type), pa.array(docs, kinds), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    return index.select("doc_ids", "n", "terms", "df", "at", "tf").mapInArrow(searched, schema)


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score over all documents: the index is written to the shared folder and searched."""
    return search_index(written(build_index(docs), "index", "zstd"), items, k)


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED_SQL = f"""WITH t AS (SELECT doc_id, unnest({_SQL_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 10"""
