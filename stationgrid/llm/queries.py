"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationgrid.llm import audit, graph, imatch, lines, mixing, packing, pii, quality, simhash, suffixes, tokens, turns, vafile
from stationgrid.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(read(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.exact_top_k(read(spark, sf_dir, "embeddings"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.damaged(read(spark, sf_dir, "conversations"))
    return turns.repair_digests(rows, turns.audits(rows))


def op12_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_simhash_components, op2_quality_classifier, op3_entropy_mixing, op4_graph_neighbours, op5_line_dedup, op6_suffix_array_dedup, op7_token_counts, op8_best_fit_packing, op9_exact_top_k, op10_personal_data, op11_conversation_repair, op12_imatch_fingerprints, op13_filter_audit)}
ORACLE: dict[str, str] = {
    "op5_line_dedup": lines.DIGEST_SQL.format(more=lines.MIN_WORDS - 1),
    "op9_exact_top_k": vafile.DIGEST_SQL,
    "op13_filter_audit": audit.AUDIT_SQL,
}
