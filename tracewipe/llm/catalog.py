"""Queries of this subpackage, and DuckDB's counterpart where SQL can express one."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewipe.session import prepare

from . import additive_ann, collision_dedup, language_id, license_scan, mixing, ngram_join, packing, quality, secret_ledger, spelling_variants, target_resampling, token_rollup, warc
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {
    "op1_additive_quantisation": additive_ann.ORACLE,
    "op2_warc_chunked_records": warc.ORACLE,
    "op3_hash_threshold_mixing": mixing.ORACLE,
    "op4_ngram_jaccard_join": ngram_join.ORACLE,
    "op7_license_scan": license_scan.ORACLE,
    "op10_collision_near_dedup": collision_dedup.ORACLE,
    "op11_target_resampling": target_resampling.ORACLE,
    "op12_secret_ledger": secret_ledger.ORACLE,
    "op13_spelling_variants": spelling_variants.ORACLE,
}


def _query(f):
    """Registers ``f`` under its own name."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(prepare(spark), sf_dir)

    QUERIES[f.__name__] = run
    return run


@_query
def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.neighbours(table(spark, sf_dir, "embeddings"))


@_query
def op2_warc_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@_query
def op3_hash_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@_query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@_query
def op5_delta_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.replayed_rollup(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op6_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "license", "first_line", F.col("words_missing"))


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op10_collision_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_dedup.near_copies(table(spark, sf_dir, "embeddings"))


@_query
def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op12_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.scan(table(spark, sf_dir, "documents"))


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))
