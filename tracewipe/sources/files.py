"""Where files come from: whole-file scans, their sidecars, and the members of archives."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_extension, file_name, file_stem, folder
from ..operators.formats import archive
from ..operators.model import ScrubError
from ..session import prepare

LIMIT = 256 << 20
SIDECARS = ("xmp", "thm", "aae", "pp3", "dop", "on1", "repair")


def read_files(spark: SparkSession, path: str, limit: int = LIMIT, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content); the size limit is pushed into the scan, before any read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).filter(F.col("length") <= limit)


def oversized(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """Files beyond the limit as error rows; their content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.filter(F.col("length") > limit).withColumn("error", F.struct(F.lit("too_large").alias("class"), F.lit("file").alias("format"), F.lit(f"the limit is {limit}").alias("detail")))


def sidecars(inputs: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, sidecar): files beside an input that share its stem or whole name and end like a sidecar.

    Endings count in lower or upper case; inputs themselves are no sidecars, and a pair is named once.
    """
    i = inputs.select(F.col("path"), folder(F.col("path")).alias("dir"), F.explode(F.array_distinct(F.array(file_stem(F.col("path")), file_name(F.col("path"))))).alias("stem"))
    ending = file_extension(F.col("path"))
    s = listing.select(F.col("path").alias("sidecar"), folder(F.col("path")).alias("dir"), file_stem(F.col("path")).alias("stem"), ending.alias("ending"))
    s = s.filter(F.col("ending").isin(*SIDECARS, *(e.upper() for e in SIDECARS)))
    s = s.join(inputs.select(F.col("path").alias("sidecar")), "sidecar", "left_anti")
    return i.join(s, ["dir", "stem"]).select("path", "sidecar").distinct()


MEMBER = "member string, method int, size long, data binary, error string"


def _members(keep: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                try:
                    for m in archive.read(b.column(0)[i].as_py() or b""):
                        try:
                            rows.append((m.path, m.method, m.size, m.read(), None))
                        except ScrubError as e:
                            rows.append((m.path, m.method, m.size, None, e.cls))
                except ScrubError as e:
                    rows.append((None, None, None, None, e.cls))
                if rows:
                    types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
                    kept = [pa.array([b.column(1 + k)[i].as_py()] * len(rows), b.schema.field(1 + k).type) for k in range(keep)]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [*names, *(c.split()[0] for c in MEMBER.split(", "))])

    return run


def members(files: DataFrame, keep: list[str]) -> DataFrame:
    """One row per member of each archive, or one with the error class."""
    prepare(files.sparkSession)
    kept = files.select("content", *keep)
    types = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[1:])
    return kept.mapInArrow(_members(len(keep), keep), f"{types}, {MEMBER}")
