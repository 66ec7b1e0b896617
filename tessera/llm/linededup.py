"""Reversible line dedup: sharded cuckoo filters over exact reference tables.

A line's key is the line without ASCII white space at its ends, A-Z in lower
case; keys of at least `min_chars` code points count. `LineIndex` keeps every
standing reference (key, doc_id) with its number, the keys that `min_docs`
documents or more hold, which are active, and a cuckoo filter of 16-bit
fingerprints of these, all three by shards of the keys. Inserting or deleting
documents finds the shards that their keys touch, adds to or takes from the
references of these shards alone, and inserts the keys that became active into
their filters or deletes those that ceased to be. The files of a change stand in
a manifest that is written last: a change that fails leaves the index as it was,
and another session opens the index by its folder and goes on. One session at a
time may change it. Files that no manifest entry of use names are the cluster's to clear.

A deletion takes no more than stands: references that the index does not hold
are left out, so a later insertion of that document counts.

A pass over documents asks the filters first: a line that no filter
knows can't be active, so only the others meet the exact table. Filters of up to `broadcast_keys` keys in all are sent
to every worker; of more, the lines go to the shards of the filters. After documents were deleted, a
pass sees the counts and the largest holder as though they had never come.

Keys are held as 128-bit BLAKE2b digests. Defined cases: null and empty texts
are one empty line; several rows of one doc_id count as one document; a null
doc_id counts as a document that sorts before all others (rows without id are told apart by their texts
when lines are taken out); an empty table gives an empty result; columns other than doc_id and text pass through, and columns
named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Collection, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_text, parallelism, python_path, release, shared_folder, slices, written

#: References per shard. A shard has a fifth as many active keys at most, with a filter of 2.4 bytes each.
SHARD_REFS = 5_000_000
#: Filters of at most so many keys (2.4 bytes each) are sent to every worker; and at most so many (document, key) pairs.
BROADCAST_KEYS, BROADCAST_PAIRS = 32_000_000, 1_000_000
#: Keys that more documents hold are joined apart, so that no task gets all rows of one: by a broadcast of up to so many, else by salts.
HOT_DOCS, BROADCAST_HOT = 100_000, 1_000_000


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key, or None if the key is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return digest(key)


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key has two buckets. Keys are the first 8 bytes of digests, as uint64."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray) -> None:
        self.table = table  # uint16, buckets x 4; 0 is free

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(keys)) / cls.SLOTS / 0.85))))
        while True:
            found = cls(np.zeros((buckets, cls.SLOTS), np.uint16))
            if all(map(found.insert, keys.tolist())):
                return found
            buckets *= 2

    def _places(self, key: int) -> tuple[int, int, int]:
        mask = len(self.table) - 1
        mark = (key >> 48) or 1
        first = (key ^ key >> 23) & mask
        return mark, first, (first ^ mark * 0x5BD1) & mask

    def insert(self, key: int) -> bool:
        mark, a, b = self._places(key)
        for place in (a, b):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        mask, place = len(self.table) - 1, a
        for n in range(self.KICKS):
            slot = (mark + n) % self.SLOTS
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = (place ^ mark * 0x5BD1) & mask
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        return False

    def delete(self, key: int) -> bool:
        """Take one copy of a key out; the key must have been inserted."""
        mark, a, b = self._places(key)
        for place in (a, b):
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.table) - 1)
        mark = np.maximum(keys >> np.uint64(48), np.uint64(1))
        a = (keys ^ keys >> np.uint64(23)) & mask
        b = (a ^ mark * np.uint64(0x5BD1)) & mask
        want = mark.astype(np.uint16)[:, None]
        return ((self.table[a] == want) | (self.table[b] == want)).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())


def heads(digests: Iterable[bytes]) -> np.ndarray:
    """The first 8 bytes of each digest, as uint64."""
    return np.frombuffer(b"".join(digests), "<u8")[::2]


def _mark(i, text: bytes) -> str | None:
    """What tells rows without an id apart: equal texts have the same lines."""
    return hashlib.sha256(text).hexdigest() if i is None else None


def _asked_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("mark", T.StringType())])


def _asked(batch: pa.RecordBatch, keys_of) -> pa.RecordBatch:
    keys, ids, marks = [], [], []
    for i, text in id_text(batch):
        if found := keys_of(text):
            keys += found
            ids += [i] * len(found)
            marks += [_mark(i, text)] * len(found)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, batch.schema.field(0).type), pa.array(marks, pa.string())], ["key", "doc_id", "mark"])


def references(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(key, doc_id, mark): each counting line of each document, once per document row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            yield _asked(batch, lambda text: {k for line in text.split(b"\n") if (k := line_key(line, min_chars))})

    python_path(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(read, _asked_schema(docs))


class Part(NamedTuple):
    """A shard of the index: how much it holds, and the written tables that hold it."""

    shard: int
    n_refs: int
    n_active: int
    refs: str
    active: str
    filters: str | None


MANIFEST = "change long, shards int, min_docs int, min_chars int, kind string, parts array<struct<shard int, n_refs long, n_active long, refs string, active string, filters string>>"


class LineIndex:
    """The references of a set of documents and the filters of their active keys, in a folder that all executors share.

    A folder that holds an index is opened as it stands after its last whole change; its rules must be the same.
    """

    def __init__(self, spark, folder: str, min_docs: int = 5, min_chars: int = 40, shard_refs: int = SHARD_REFS) -> None:
        self.spark, self.folder, self.min_docs, self.min_chars, self.shard_refs = spark, folder.rstrip("/"), min_docs, min_chars, shard_refs
        self.shards, self.changes, self.kind = 1, 0, "bigint"
        self.parts: dict[int, Part] = {}
        if last := self._last():
            if (last["min_docs"], last["min_chars"]) != (min_docs, min_chars):
                raise ValueError(f"the index in {folder} counts lines of {last['min_chars']} characters in {last['min_docs']} documents")
            self.changes, self.shards, self.kind = last["change"], last["shards"], last["kind"]
            self.parts = {p["shard"]: Part(*p) for p in last["parts"]}

    def _last(self) -> Row | None:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").orderBy(F.desc("change")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def insert(self, docs: DataFrame) -> None:
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """Take documents out again; they must be given as they were inserted, and what the index does not hold is left out."""
        self._change(docs, -1)

    @property
    def active(self) -> DataFrame:
        """(shard, key, n_docs, max_doc) of the keys that enough documents hold."""
        return self._held("active", f"shard int, key binary, n_docs bigint, max_doc {self.kind}")

    @property
    def n_active(self) -> int:
        return sum(p.n_active for p in self.parts.values())

    @property
    def filters(self) -> DataFrame:
        """(shard, filter)"""
        return self._held("filters", "shard int, filter binary")

    def _held(self, what: str, schema: str, shards: Collection[int] | None = None) -> DataFrame:
        """A table of the index as it stands, of all shards or of some; the others' files are not opened."""
        at = [p for p in self.parts.values() if (shards is None or p.shard in shards) and (p.filters if what == "filters" else p.n_active if what == "active" else p.n_refs)]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{getattr(p, what)}/dir={p.shard}" for p in at])

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.withColumn("dir", F.col("shard")).write.partitionBy("dir").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}").select(df.columns)

    def _change(self, docs: DataFrame, sign: int) -> None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        if self.parts and kind != self.kind:
            raise ValueError(f"the index holds ids of type {self.kind}, not {kind}")
        self.kind, change = kind, self.changes + 1
        own = f"{change}-{uuid.uuid4().hex}"
        path = f"{self.folder}/change-{own}"
        references(docs, self.min_chars).select("key", "doc_id", F.lit(sign).cast("long").alias("n")).write.parquet(path)
        refs_schema = f"key binary, doc_id {kind}, n bigint"
        delta = self.spark.read.schema(refs_schema).parquet(path)

        shards = self.shards
        wanted = -(-(sum(p.n_refs for p in self.parts.values()) + delta.count()) // self.shard_refs)
        anew = sign > 0 and (wanted > 2 * shards or not self.parts)  # all shards are dealt anew
        if anew:
            shards, touched = max(1, wanted), None
        else:
            touched = {r[0] for r in delta.select(_shard("key", shards)).distinct().collect()}
        both = self._held("refs", refs_schema, touched).unionByName(delta).withColumn("shard", _shard("key", shards))
        # A change has one sign, so a sum of 0 or less means that nothing is left of a reference.
        refs = both.groupBy("shard", "key", "doc_id").agg(F.sum("n").alias("n")).filter("n > 0")
        if shards > 1:  # few files a shard, and a hot key's shard in several tasks
            salts = -(-8 * parallelism(self.spark) // shards)
            refs = refs.repartition("shard", F.pmod(F.xxhash64("key", "doc_id"), F.lit(salts)))
        refs = self._save(refs, f"refs-{own}")
        active = refs.groupBy("shard", "key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")).filter(F.col("n_docs") >= self.min_docs)
        active = self._save(active.repartition("shard") if shards > 1 else active, f"active-{own}")

        none = self.spark.createDataFrame([], "shard int, filter binary")
        if anew:
            before, filters = active.limit(0), none
        else:
            before, filters = self._held("active", f"shard int, key binary, n_docs bigint, max_doc {kind}", touched), self._held("filters", "shard int, filter binary", touched)
        new = active.join(before, "key", "left_anti").select("key", F.lit(1).alias("change"))
        gone = before.join(active, "key", "left_anti").select("key", F.lit(-1).alias("change"))
        filters = self._save(updated_filters(filters, new.unionByName(gone), shards), f"filters-{own}")
        full = {r["shard"]: r["full"] for r in filters.select("shard", F.col("filter").isNull().alias("full")).collect()}
        names = dict.fromkeys(full, f"filters-{own}")
        if crowded := [s for s, f in full.items() if f]:
            self._save(updated_filters(none, active.filter(F.col("shard").isin(crowded)).select("key", F.lit(1).alias("change")), shards), f"larger-filters-{own}")
            names |= dict.fromkeys(crowded, f"larger-filters-{own}")

        n_refs, n_active = ({r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()} for df in (refs, active))
        parts = {} if anew else {s: p for s, p in self.parts.items() if s not in touched}
        parts |= {s: Part(s, n, n_active.get(s, 0), f"refs-{own}", f"active-{own}", names.get(s)) for s, n in n_refs.items()}
        row = (change, shards, self.min_docs, self.min_chars, kind, [tuple(p) for p in parts.values()])
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.changes, self.shards, self.parts = change, shards, parts


def _shard(key, shards: int):
    return (F.crc32(key) % shards).cast("int")


def updated_filters(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) after changes (key, 1 or -1); null where a filter has no room for its new keys."""

    def update(old: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else group)["shard"].iloc[0])
        new, gone = (heads(group.loc[group["change"] == c, "key"]) for c in (1, -1))
        if not len(old):
            return pd.DataFrame({"shard": [shard], "filter": [CuckooFilter.of(new).to_bytes()]})
        held = CuckooFilter.from_bytes(old["filter"].iloc[0])
        for key in gone.tolist():
            held.delete(key)
        full = not all(map(held.insert, new.tolist()))
        return pd.DataFrame({"shard": [shard], "filter": [None if full else held.to_bytes()]})

    keyed = changes.select(_shard("key", shards).alias("shard"), "key", "change")
    return filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(update, "shard int, filter binary")


def maybe(keys: list[bytes], filters: dict[int, CuckooFilter], shards: int) -> list[bytes]:
    """The keys that a filter knows; all active keys are among them."""
    if not keys or not filters:
        return []
    h = heads(keys)
    if shards == 1:
        return [keys[i] for i in np.flatnonzero(filters[0].contains(h))]
    shard = np.fromiter((zlib.crc32(k) % shards for k in keys), np.int64, len(keys))
    hit = np.zeros(len(keys), bool)
    for s in np.unique(shard):
        if (f := filters.get(int(s))) is not None:
            own = shard == s
            hit[own] = f.contains(h[own])
    return [keys[i] for i in np.flatnonzero(hit)]


def known_lines(docs: DataFrame, index: LineIndex, broadcast_keys: int = BROADCAST_KEYS, salts: int = 16) -> DataFrame:
    """(key, doc_id, mark): the lines of docs, once per row, that the filters know: all active ones and few others."""
    kind, found = docs.schema["doc_id"].dataType, _asked_schema(docs)
    if index.n_active <= broadcast_keys:
        filters = {r["shard"]: bytes(r["filter"]) for r in index.filters.collect()}  # 2.4 bytes per key
        sent, shards, min_chars = docs.sparkSession.sparkContext.broadcast(filters), index.shards, index.min_chars

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            held = {s: CuckooFilter.from_bytes(f) for s, f in sent.value.items()}
            for batch in slices(batches):
                yield _asked(batch, lambda text: maybe(list({k for line in text.split(b"\n") if (k := line_key(line, min_chars))}), held, shards))

        python_path(docs.sparkSession)
        return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(ask, found)

    def ask_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = None
        for batch in batches:
            # a filter comes before the lines of its shard and salt
            starts = [*[k for k, f in enumerate(batch.column("filter").is_valid().to_pylist()) if f], batch.num_rows]
            for k in range(-1, len(starts) - 1):
                low, high = (starts[k] if k >= 0 else 0), starts[k + 1]
                if k >= 0:
                    held, low = CuckooFilter.from_bytes(batch.column("filter")[low].as_py()), low + 1
                part = batch.slice(low, high - low)
                if part.num_rows and held is not None:
                    hit = pa.array(held.contains(heads(part.column("key").to_pylist())))
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(hit) for c in ("key", "doc_id", "mark")], ["key", "doc_id", "mark"])

    lines = references(docs, index.min_chars).withColumns({"shard": _shard("key", index.shards), "salt": F.pmod(F.xxhash64("doc_id", "mark"), F.lit(salts)).cast("int"), "filter": F.lit(None).cast("binary")})
    tables = index.filters.withColumns({"salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1))), "key": F.lit(None).cast("binary"), "doc_id": F.lit(None).cast(kind), "mark": F.lit(None).cast("string")})
    dealt = lines.unionByName(tables).repartition(parallelism(docs.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    return dealt.select("key", "doc_id", "mark", "filter").mapInArrow(ask_shard, found)


def lines_to_drop(asked: DataFrame, active: DataFrame, hot_docs: int = HOT_DOCS, broadcast_hot: int = BROADCAST_HOT, salts: int = 64) -> DataFrame:
    """(doc_id, mark, keys): the active keys among (key, doc_id, mark) whose lines go, as another document is their largest holder."""
    goes = "max_doc IS NOT NULL AND (doc_id IS NULL OR doc_id < max_doc)"
    hot = active.filter(F.col("n_docs") > hot_docs).select("key", "max_doc", F.lit(True).alias("hot"))
    if hot.limit(broadcast_hot + 1).count() <= broadcast_hot:
        by_hot = asked.join(F.broadcast(hot), "key", "left")
    else:
        dealt = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        by_hot = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(salts)).cast("int")).join(dealt, ["key", "salt"], "left")
    rest = by_hot.filter("hot IS NULL").select("key", "doc_id", "mark").join(active.filter(F.col("n_docs") <= hot_docs).select("key", "max_doc"), "key")
    gone = by_hot.filter("hot").select("key", "doc_id", "mark", "max_doc").unionByName(rest.select("key", "doc_id", "mark", "max_doc")).filter(goes)
    return gone.groupBy("doc_id", "mark").agg(F.collect_set("key").alias("keys"))


def _strip(text: bytes, min_chars: int, gone: frozenset[bytes]) -> tuple[bytes, int, int]:
    """Text without the lines whose keys are gone, the number of lines before, and of lines dropped."""
    if not gone:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    left = [line for line in lines if line_key(line, min_chars) not in gone]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, broadcast_keys: int = BROADCAST_KEYS, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """docs with repeated lines taken out of text, plus n_lines and n_dropped.

    Keys that at least min_docs documents hold lose their lines everywhere but
    in the largest doc_id among these.
    """
    spark = docs.sparkSession
    index = LineIndex(spark, f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}", min_docs, min_chars)
    index.insert(docs.select("doc_id", "text"))
    return drop_lines(docs, index, broadcast_keys, broadcast_pairs)


def drop_lines(docs: DataFrame, index: LineIndex, broadcast_keys: int = BROADCAST_KEYS, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """docs without the lines of the index's active keys in documents other than the largest holder, plus n_lines and n_dropped."""
    python_path(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    names, min_chars = docs.columns, index.min_chars
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    gone = written(lines_to_drop(known_lines(docs, index, broadcast_keys), index.active), "gone-lines")
    gone = gone.select(F.col("doc_id").alias("_who"), F.col("mark").alias("_mark"), F.col("keys").alias("_gone"))
    if gone.agg(F.coalesce(F.sum(F.size("_gone") + 1), F.lit(0))).first()[0] <= broadcast_pairs:
        gone = F.broadcast(gone)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            texts, keys = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist()
            done = [_strip(t or b"", min_chars, frozenset(k or ())) for t, k in zip(texts, keys)]
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array([t if n else old for (t, _, n), old in zip(done, texts)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n, _ in done], pa.int64()), pa.array([n for _, _, n in done], pa.int64())], [f.name for f in schema.fields])

    mark = F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_who")) & mark.eqNullSafe(F.col("_mark")), "left").select(*names, "_gone").mapInArrow(apply, schema)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per document."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM (SELECT *, row_number() OVER () AS r FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
a AS (
  SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(k.doc_id < a.max_doc, false) AS gone FROM k LEFT JOIN a USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
