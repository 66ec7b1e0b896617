"""The pipeline's stages, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_filters_keep_the_columns_and_rows_of_clean_documents(spark, docs):
    clean = p.remove_toxic(spark, docs, SF)
    assert clean.schema == docs.schema
    lines = p.remove_lines(spark, docs, SF)
    assert lines.schema == docs.schema and lines.count() == docs.count()
    assert lines.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_one_document_of_each_group_stays(spark, docs):
    from tessera.llm.jaccard import jaccard_components

    kept = p.remove_near_copies(spark, docs.unionByName(docs.limit(5)), SF)
    assert kept.schema == docs.schema
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in jaccard_components(docs).select("component_id").distinct().collect())


def test_mix_repeats_and_cuts(spark, docs):
    from tessera.llm.mixing import mix_documents, word_count

    mixed = p.mix_sources(spark, docs, SF)
    want = {r["doc_id"]: r["taken"] for r in mix_documents(docs).collect() if r["taken"]}
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("n")).collect()}
    assert got == want and mixed.schema == docs.schema


def _unkeyed(spark, docs):
    """Unlike texts under a null doc_id or one doc_id, a near copy under each, two exact copies without an id, and rows without words."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(100))
    near = text(0).replace("w0x50", "other")
    found = [(None, text(0)), (None, text(1)), (None, text(1)), (7, text(2)), (7, text(3)), (7, near), (8, near), (None, None), (None, ""), (9, " "), (9, None)]
    named = spark.createDataFrame(found, "doc_id long, text string")
    lit = {f.name: F.lit("a" if f.name == "source" else None).cast(f.dataType) for f in docs.schema if f.name not in named.columns}
    return named.withColumns(lit).select(docs.columns)


@pytest.mark.parametrize("slices", [1, 5])
def test_unlinked_documents_without_an_own_id_stay(spark, docs, slices):
    kept = p.remove_near_copies(spark, _unkeyed(spark, docs).repartition(slices), SF).select("doc_id", "text").collect()
    got = sorted((r["doc_id"] or 0, (r["text"] or "").split()[:1]) for r in kept)
    assert got == [(0, []), (0, []), (0, ["w1x0"]), (7, ["w0x0"]), (7, ["w2x0"]), (7, ["w3x0"]), (9, []), (9, [])]
    assert any("other" in (r["text"] or "") for r in kept)


def test_mix_takes_each_row_by_itself(spark, docs):
    from tessera.llm.mixing import mix_documents, word_count

    rows = _unkeyed(spark, docs)
    n = word_count(F.col("text"))
    mixed = p.mix_sources(spark, rows, SF)
    assert mixed.agg(F.sum(n)).first()[0] == mix_documents(rows).agg(F.sum("taken")).first()[0] == rows.agg(F.sum(n)).first()[0]
    assert sorted(r[0] for r in mixed.select("text").collect()) == sorted(r[0] for r in rows.filter(n > 0).select("text").collect())


def test_empty_documents(spark, docs):
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_columns_of_any_name_pass_through(spark, docs):
    names = ["size", "taken", "score", "predicted", "held_out", "n_lines", "n_dropped", "_row", "_tie", "target"]
    mine = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, mine, SF)
        assert out.columns == mine.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.limit(20).collect() for n in names)


def test_a_cut_document_keeps_its_white_space(spark, docs):
    mixed = p.mix_sources(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert all((texts[r["doc_id"]] or "").startswith(r["text"] or "") for r in mixed.select("doc_id", "text").collect())
