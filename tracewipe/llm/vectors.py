"""Which embedding rows take part in vector operators, and their numpy form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding double array, usable) of every row.

    Usable are rows with an id whose vector is not null, empty or zero, holds neither nulls nor
    non-finite values, and has the most frequent length of such vectors (the longer on a tie).
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & some, F.lit(False))
    length = v.filter(sound).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return v.withColumn("usable", sound & (F.size("embedding") == (length["dim"] if length else 0)))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the usable rows."""
    return marked(vectors).filter("usable").select("vec_id", "embedding")


def matrix(column: pa.ListArray, dtype=np.float64) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows; squares of large components do not overflow on the way."""
    top = np.abs(x).max(axis=1, initial=0.0)
    with np.errstate(over="ignore"):
        return top * np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def sample_matrix(vectors: DataFrame, most: int, seed: int) -> np.ndarray:
    """At most about ``most`` vectors, the same on every run: those with small hashes of their id."""
    n = vectors.count()
    if n > most:
        share = int(most / n * (1 << 30))
        vectors = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < share)
    rows = vectors.orderBy("vec_id").limit(2 * most).select("embedding").toArrow()
    return matrix(rows.column(0).combine_chunks()) if rows.num_rows else np.zeros((0, 0))
