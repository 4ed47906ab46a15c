"""What the operators of this subpackage share: shared scratch tables and table reading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than one in ``HOT`` of a side's rows is joined by broadcast: fewer than ``HOT`` keys can.
HOT = 256
_SETTING = "spark.checkpoint.dir"
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the one the cluster names in spark.checkpoint.dir.

    Where that setting is missing a temporary folder takes its place in local mode, where driver and
    tasks are one machine; on a cluster its absence is an error, as executors would not see each other's.
    """
    app = spark.sparkContext.applicationId
    if app not in _made:
        root = spark.sparkContext.getConf().get(_SETTING)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='tracewipe-')}"
        _made[app] = f"{root.rstrip('/')}/tracewipe-{app}"
        atexit.register(_drop_all, spark, _made[app])
    return _made[app]


def _drop_all(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the gateway may be gone by now; the folder is the cluster's to clean
        pass


def filesystem(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path for ``path``, from the driver."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors.

    Tables of few very large rows take ``rows_per_file``: Parquet looks at its buffers every 100 rows only,
    and a reader decodes up to 4 096 rows of a file at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, whatever their names; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_spread(rows: DataFrame, by_key: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) with ``by_key``, one row per key, so that no key makes one heavy task.

    ``weight`` is a column of ``by_key``: how many of ``rows`` have the key. Keys above one in ``HOT`` of
    all rows are fewer than ``HOT``; they are broadcast and their rows stay where they are. All others are
    joined by shuffle. The weight is dropped.
    """
    hot, cold = by_key.filter(F.col(weight) * HOT > total).drop(weight), by_key.filter(F.col(weight) * HOT <= total).drop(weight)
    spread = rows.join(F.broadcast(hot), keys)
    dealt = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return spread.unionByName(dealt)
