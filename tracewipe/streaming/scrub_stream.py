"""Scrubbing as files arrive.

The scrub is stateless, so a stream is the batch operator on a file source. Each row carries the
generation (a hash of the policy it was cleaned under); a consumer that has moved on drops rows of
other generations. Files are let through once while their watermark lasts.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import Policy
from ..operators.scrub import scrub

SOURCE = "path string, modificationTime timestamp, length long, content binary"


def generation(policy: Policy) -> str:
    return hashlib.sha256(repr(policy).encode()).hexdigest()[:16]


def read_stream(spark: SparkSession, path: str, per_trigger: int = 1000, limit: int = 256 << 20) -> DataFrame:
    """New files below ``path`` within the size limit."""
    files = spark.readStream.format("binaryFile").schema(SOURCE).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") <= limit)


def once(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Without repeats of a path and modification time."""
    return files.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["path", "modificationTime"])


def scrub_stream(files: DataFrame, policy: Policy = Policy(), emit: bool = True) -> DataFrame:
    """The scrub result of each arriving file with its ``generation``."""
    keep = [c for c in files.columns if c != "content"]
    return scrub(files, keep, policy, emit=emit).withColumn("generation", F.lit(generation(policy)))


def current(results: DataFrame, policy: Policy) -> DataFrame:
    """Only what was cleaned under ``policy``."""
    return results.filter(F.col("generation") == generation(policy))


def run_available(results: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote, as a batch.

    ``folder`` (a new one below ``spark.checkpoint.dir`` where it is not given, a temporary one in local
    mode) holds the output and the stream's checkpoint; with the same folder the next run goes on from there.
    """
    spark = results.sparkSession
    if folder is None:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{root or 'file://' + tempfile.mkdtemp(prefix='tracewipe-')}/stream-{uuid.uuid4().hex[:12]}"
    query = results.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(results.schema).parquet(f"{folder}/out")
