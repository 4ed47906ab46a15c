"""Tables between the rounds of an iterative operator, below the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A shared folder; in local mode a temporary one takes its place where the setting is missing, on a cluster that is an error."""
    root = spark.sparkContext.getConf().get(_SETTING)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='tracewipe-')}"
    return _local[app]


class Rounds:
    """Written tables of one run; ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    def saved(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again: cuts lineage and survives lost executors."""
        self.made += 1
        path = f"{self.path}/{self.made:04d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(path)

    def close(self) -> None:
        """Removes all of the run's tables."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
