"""Where queries and their DuckDB counterparts are registered, and what they read."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession

from ..session import prepare

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, content: Column, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), *more)


def expected(format: str, assurance: str, n: str, kinds: str, removed: str, output: str, source: str = "documents") -> str:
    return (
        f"SELECT doc_id, '{format}' AS format, '{assurance}' AS assurance, CAST({n} AS BIGINT) AS n_removed, {kinds} AS kinds, "
        f"CAST({removed} AS BIGINT) AS bytes_removed, CAST({output} AS BIGINT) AS output_len FROM {source}"
    )
