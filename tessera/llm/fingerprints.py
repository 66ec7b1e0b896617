"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A fingerprint holds every 5-word shingle hash below a fixed fraction of the hash
range, whatever the document's length; sketches of parts therefore merge by
union, and the share of one sketch found in another estimates containment even
between very unequal documents. A document of which no hash falls below the
fraction keeps its smallest one, so that only a text without words has an empty
fingerprint.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; fewer than five words are one
shingle. Defined cases: a null text is empty; two empty fingerprints have
likeness 1, one empty and one not 0; rows that repeat a doc_id follow each
other in the order of a hash of their text; a null doc_id comes first; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, parallelism, plain, written

SHINGLE = 5
#: The fraction of the hash range that is kept, as a power of two: 1/8.
FRACTION_BITS = 3


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all word shingles of a text, in order, as non-negative longs of 63 bits."""
    words = F.split(F.btrim(F.translate(plain(text), UPPER, LOWER), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # The words' hashes are an array of their own first: hashing longs is much cheaper than strings.
    return F.when(text.isNull() | (words == F.array(F.lit(""))), F.array().cast("array<bigint>")).otherwise(_windows(hashes, width))


def _windows(hashes: Column, width: int) -> Column:
    def of(h: Column) -> Column:
        long_enough = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.shiftrightunsigned(F.xxhash64(*[h[i + k] for k in range(width)]), 1))
        return F.when(F.size(h) >= width, long_enough).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(h), 1)))

    return F.transform(F.array(hashes), of)[0]  # binds the array once


def sketch(text: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """The sorted distinct hashes below 2^-fraction_bits of the range, or the smallest hash if there are none."""
    below = 1 << (63 - fraction_bits)

    def keep(h: Column) -> Column:
        kept = F.filter(h, lambda x: x < F.lit(below))
        return F.when((F.size(kept) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(F.array_sort(F.array_distinct(kept)))

    return F.transform(F.array(shingle_hashes(text)), keep)[0]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """The sketch of two parts together."""
    both = F.array_sort(F.array_union(a, b))
    kept = F.filter(both, lambda x: x < F.lit(1 << (63 - fraction_bits)))
    return F.when((F.size(kept) == 0) & (F.size(both) > 0), F.slice(both, 1, 1)).otherwise(kept)


def to_string(hashes: Column) -> Column:
    """The sketch as text: the upper 48 of 63 bits of each hash in hexadecimal."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(F.shiftright(x, 15))), 12, "0")), "")


def next_rows(docs: DataFrame) -> DataFrame:
    """uid, n_chars, next_uid, prev_uid, prev_chars of each row in ascending (doc_id, text hash); the last row is followed by the first.

    Rows are numbered inside ranges of doc_id; only the first and last row of each
    range meet the neighbouring ranges.
    """
    ids = docs.select("uid", "n_chars", "doc_id", "text_key")
    order = ["doc_id", "text_key", "uid"]
    ids = written(ids.repartitionByRange(parallelism(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "order")
    ends = ids.groupBy("part").agg(F.min(F.struct(*order, "n_chars")).alias("first"), F.max(F.struct(*order, "n_chars")).alias("last"))
    # One row per range.
    by_part = Window.orderBy("part")
    everything = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(by_part), F.first("first").over(everything)).alias("after"),
        F.coalesce(F.lag("last").over(by_part), F.last("last").over(everything)).alias("before"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    here = ids.select(
        "part", "uid", "n_chars", F.lead("uid").over(inside).alias("n"), F.lag(F.struct("uid", "n_chars")).over(inside).alias("p")
    )
    return here.join(F.broadcast(ends), "part").select(
        "uid", "n_chars", F.coalesce("n", F.col("after.uid")).alias("next_uid"), F.coalesce(F.col("p.uid"), F.col("before.uid")).alias("prev_uid"), F.coalesce(F.col("p.n_chars"), F.col("before.n_chars")).alias("prev_chars")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited, in_next of each row of docs.

    near_* are likenesses (Jaccard), in_* the estimated share of the text that the edited text or the next document contains.

    The edited text's last floor(n_chars / 4) code points are replaced by the first
    as many (or all) of the next document.
    """
    rows = docs.select("doc_id", plain(F.col("text")).alias("text"))
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "text_key": F.xxhash64("text")})
    # Rows alike in doc_id and text are interchangeable, and share a uid with a copy number.
    slim = written(rows.select("doc_id", "n_chars", "text_key"), "text-keys")
    repeated = slim.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count() > 0
    if repeated:
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("n_chars")))
        slim = rows.select("doc_id", "n_chars", "text_key", "copy")
    copy = F.col("copy") if repeated else F.lit(1)
    uid = F.struct(F.col("doc_id"), F.col("text_key"), copy.cast("int").alias("copy"))
    key = F.xxhash64("doc_id", "text_key", copy.cast("int"))
    slim = slim.withColumn("uid", uid)
    order = next_rows(slim)
    here = order.select(F.xxhash64("uid.doc_id", "uid.text_key", "uid.copy").alias("k"), "uid", "n_chars", "prev_uid", "prev_chars")
    # The sketch is worked out once, before texts are dealt out: both sides of the join with the neighbour read the same exchange.
    texts = rows.select(key.alias("k"), uid.alias("uid"), "text", sketch(F.col("text")).alias("sketch"))
    placed = texts.join(here.withColumnRenamed("uid", "u"), "k").filter(F.col("uid").eqNullSafe(F.col("u"))).drop("u")
    own = placed.select("k", "uid", "n_chars", "text", "sketch")
    fitted = placed.select(
        F.xxhash64("prev_uid.doc_id", "prev_uid.text_key", "prev_uid.copy").alias("k"),
        F.col("prev_uid").alias("u"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("head"),
        F.col("sketch").alias("next_sketch"),
    )
    both = own.join(fitted, "k").filter(F.col("uid").eqNullSafe(F.col("u")))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), F.col("head"))
    both = both.select(F.col("uid.doc_id").alias("doc_id"), "n_chars", edited.alias("edited"), "sketch", "next_sketch")
    both = both.withColumn("edited_sketch", sketch(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        to_string(F.col("sketch")).alias("fingerprint"),
        to_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("in_next"),
    )
