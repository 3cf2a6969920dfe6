"""Queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_decontaminate, op2_warc, op3_licenses, op4_packing, op5_exact_dedup, op6_minhash, op7_mixing, op8_toxicity, op9_quality, op10_substring, op11_audit, op12_private, op13_divergence
from .common import read


def op1_decontaminate_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_licenses.scan(read(spark, sf_dir, "documents"))


def op4_pack_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_packing.pack(read(spark, sf_dir, "documents"))


def op5_exact_dedup_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_exact_dedup.deduplicate(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mixing.mix(read(spark, sf_dir, "documents"))


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8_toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_segments"))


def op9_quality_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality.classify(read(spark, sf_dir, "documents"))


def op10_substring_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_substring.digests(op10_substring.remove_repeats(read(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_redact_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_private.redactions(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate_wand, op2_warc_revisits, op3_license_scan, op4_pack_token_ids, op5_exact_dedup_recipes,
        op6_minhash_tensored, op7_mix_sources, op8_toxic_segments, op9_quality_weak_labels, op10_substring_trees,
        op11_filter_audit, op12_redact_private, op13_source_divergence,
    )
}

ORACLE = {
    "op2_warc_revisits": op2_warc.ORACLE_SQL,
    "op3_license_scan": op3_licenses.ORACLE_SQL,
    "op5_exact_dedup_recipes": op5_exact_dedup.ORACLE_SQL,
    "op6_minhash_tensored": op6_minhash.ORACLE_SQL,
    "op7_mix_sources": op7_mixing.ORACLE_SQL,
    "op10_substring_trees": op10_substring.ORACLE_SQL,
    "op11_filter_audit": op11_audit.ORACLE_SQL,
    "op13_source_divergence": op13_divergence.ORACLE_SQL,
}
