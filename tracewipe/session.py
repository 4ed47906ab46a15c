"""What a session needs before the engine's Python functions run in it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

#: Rows hold whole files or texts, so fewer of them than Spark's default go to a Python worker at once.
BATCH_SETTING, SPARK_BATCH, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers that see this folder import the package from it, in batches that fit whole texts.

    On a cluster whose workers do not see the driver's folder, ship the package with ``--py-files``.
    """
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in known:
        env["PYTHONPATH"] = ":".join([*known, ROOT])
    if spark.conf.get(BATCH_SETTING) == SPARK_BATCH:
        spark.conf.set(BATCH_SETTING, BATCH)
    return spark
