"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All stages but the last return
the columns of documents, whatever their names; doc_id may be null or repeated, as each stage
that has to tell rows apart keys them by a number of its own. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, linededup, mixing, packing, toxicity
from tessera.llm.common import written
from tessera.plans import table


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones under names that no stage gives, and how to get its columns back."""
    names = {c: c if c in used else f"_user{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def _resized(docs: DataFrame, changed) -> DataFrame:
    """n_chars, where there is one, follows the texts that changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows, back = _apart(docs, "doc_id", "text")
    return back(toxicity.score_rows(rows, model, rows.columns).filter("predicted = 0"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents hold stay in the largest doc_id alone; n_chars follows the text."""
    rows, back = _apart(docs, "doc_id", "text", "n_chars")
    return back(_resized(linededup.dedup_lines(rows), F.col("n_dropped") > 0))


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a written key of each row, _row, and a hash of its columns, _tie, which no order of the input changes."""
    return written(docs.withColumns({"_row": F.monotonically_increasing_id(), "_tie": F.xxhash64(*docs.columns)}), name, "zstd")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join one row stays, of the smallest doc_id (null last); each row without words stays."""
    rows, back = _apart(docs, "doc_id", "text")
    rows = _keyed(rows, "join-rows")
    found = jaccard.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_tie", "_row")
    kept = rows.select("doc_id", "_tie", "_row").join(found, "_row").groupBy("component_id").agg(F.min(first)["_row"].alias("_row"))
    return back(rows.join(kept, "_row", "left_semi"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one that the budget cuts ends after its share of words."""
    rows, back = _apart(docs, "doc_id", "text", "source", "n_chars")
    rows = _keyed(rows, "mix-rows")
    mix = mixing.mix_documents(rows.select("doc_id", "text", "source", "_row", "_tie"), key=["_tie", "_row"]).filter("taken > 0")
    rows = rows.join(mix.select("_row", F.col("size").alias("_size"), F.col("taken").alias("_taken")), "_row")
    passes = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    rows = rows.withColumn("_words", F.explode(F.transform(F.sequence(F.lit(1), passes), lambda k: F.least(F.col("_size"), F.col("_taken") - (k - 1) * F.col("_size")))))
    cut = F.col("_words") < F.col("_size")
    # Each part is a word and the white space behind it; white space at the beginning is a part of its own.
    parts, led = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    head = F.rtrim(F.array_join(F.slice(parts, F.lit(1), F.col("_words").cast("int") + led), ""), F.lit(" \t\n\x0b\f\r"))
    return back(_resized(rows.withColumn("text", F.when(cut, head).otherwise(F.col("text"))), cut))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("jaccard_join", remove_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the models; tests hold the stages against their operators and these against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
