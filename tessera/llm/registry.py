"""Queries of this folder: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprints, jaccard, licenses, linededup, lm, mixing, packing, phrases, quality, ranked, sharding, toxicity
from tessera.plans import Catalog, table


def build() -> Catalog:
    found = Catalog()
    found.add("op1_lm_score")(lambda spark, d: lm.score_corpus(table(spark, d, "documents")))
    found.add("op2_line_dedup", linededup.LINES_SQL)(lambda spark, d: linededup.line_dedup_digest(table(spark, d, "documents")))
    found.add("op3_sharding")(lambda spark, d: sharding.shard_documents(table(spark, d, "documents")))
    found.add("op4_toxicity")(lambda spark, d: toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")))
    found.add("op5_fingerprints")(lambda spark, d: fingerprints.fingerprint_documents(table(spark, d, "documents")))
    found.add("op6_mixing", mixing.MIX_SQL)(lambda spark, d: mixing.mix_documents(table(spark, d, "documents")))
    found.add("op7_licenses")(lambda spark, d: licenses.scan_licenses(table(spark, d, "documents")).withColumn("spans", F.to_json("spans")))
    found.add("op8_jaccard_join")(lambda spark, d: jaccard.jaccard_components(table(spark, d, "documents")))
    found.add("op9_quality")(lambda spark, d: quality.quality_rules(table(spark, d, "documents")))
    found.add("op10_packing")(lambda spark, d: packing.pack_documents(table(spark, d, "documents")))
    found.add("op11_bpe")(lambda spark, d: bpe.codec_digest(table(spark, d, "documents")))
    found.add("op12_phrases", phrases.PHRASES_SQL)(lambda spark, d: phrases.mine_phrases(table(spark, d, "documents")))
    found.add("op13_ranked_search", ranked.RANKED_SQL)(lambda spark, d: ranked.search_documents(table(spark, d, "documents"), table(spark, d, "benchmark")))
    return found
