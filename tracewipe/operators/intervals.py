"""Overlap tests between two tables of byte ranges, by one sort and a running maximum.

A range [start, end) overlaps one of the other side if and only if, of those that start before its end, the
one that reaches farthest ends behind its start. So both sides are laid out in one order, left ranges by
their end and right ones by their start, cut by ranges into partitions of like size, and each partition is
passed once with the farthest end so far. What the partitions before hold for a key that goes on is one
number each, joined afterwards. Every row is shuffled once, whole: a file with a third of all ranges is cut
like the rest, a place where thousands pile up as well, and no pair of ranges is ever formed.

Ranges are [start, end); empty ones and those with a null key or bound overlap nothing. Repeated rows
stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..scratch import Rounds
from ..session import prepare

_LEAST = np.iinfo(np.int64).min
_LEFT, _RIGHT, _LAST, _FIRST = range(4)  # kinds of rows: of the two sides, and a partition's last and first key


def _ranges(df: DataFrame, keys: list[str], start: str, end: str, *more) -> DataFrame:
    """Keys, bounds, whether the range can overlap anything, and more."""
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    known = s < e
    for k in keys:
        known &= F.col(k).isNotNull()
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], s.alias("_s"), e.alias("_e"), F.coalesce(known, F.lit(False)).alias("_known"), *more)


def _farthest(new: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The running maximum of ``ends``, begun again where ``new`` is true."""
    n = len(ends)
    order = np.argsort(ends, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    run = np.cumsum(new) * n
    return ends[order][np.maximum.accumulate(run + rank) - run]


def _swept(keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, top, schema = TaskContext.get().partitionId(), None, _LEAST, None

        def edge(kind: int, key: tuple, value: int) -> pa.RecordBatch:
            values = [*key, value, kind, part, None, None]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            of, n = [b.column(i) for i in range(keys)], b.num_rows
            kind = b.column("_kind").to_numpy()
            end = np.where(kind == _RIGHT, b.column("_e").to_numpy(), _LEAST)
            new = np.zeros(n, bool)
            for k in of:
                new[1:] |= pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            upto, head = _farthest(new, end), tuple(k[0].as_py() for k in of)
            if held == head:
                first = int(np.argmax(new)) if new.any() else n
                upto[:first] = np.maximum(upto[:first], top)
            columns = [*of, b.column("_s"), b.column("_kind"), pa.array(np.full(n, part, np.int32)), pa.array(upto > b.column("_s").to_numpy()), b.column("_row")]
            out = pa.RecordBatch.from_arrays(columns, [*b.schema.names[:keys], "_s", "_kind", "_part", "_hit", "_row"])
            if schema is None:
                schema = pa.schema([pa.field(f.name, f.type) for f in out.schema])
                yield edge(_FIRST, head, 0)
            held, top = tuple(k[n - 1].as_py() for k in of), int(upto[-1])
            yield out.filter(pa.array(kind == _LEFT))
        if held is not None:
            yield edge(_LAST, held, top)

    return run


def _marked(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``_row``, ``_hit``: each row of ``left`` and whether its range overlaps one of ``right``."""
    spark = prepare(left.sparkSession)
    names = [f"_k{i}" for i in range(len(keys))]
    a = _ranges(left, keys, start, end, F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    b = _ranges(right, keys, start, end).withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType))
    at = lambda kind, place: [*names, F.col(place).alias("_at"), F.lit(kind).alias("_kind"), "_s", "_e", "_row"]
    both = a.filter("_known").select(*at(_LEFT, "_e")).unionByName(b.filter("_known").select(*at(_RIGHT, "_s")))
    order = [*names, "_at", "_kind"]  # a left range that ends where a right one starts comes first
    laid = both.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order)
    fields = {f.name: f for f in both.schema}
    out = StructType([StructField(n, fields[n].dataType) for n in (*names, "_s", "_kind")] + [StructField("_part", IntegerType()), StructField("_hit", BooleanType()), StructField("_row", fields["_row"].dataType)])
    swept = Rounds(spark, "ranges").saved(laid.select(*names, "_s", "_e", "_kind", "_row").mapInArrow(_swept(len(keys)), out))
    # at most one row for each partition: the farthest end that those before hold for its first key
    last = swept.filter(F.col("_kind") == _LAST).select(*names, F.col("_part").alias("_of"), F.col("_s").alias("_before"))
    first = swept.filter(F.col("_kind") == _FIRST).select(*names, "_part")
    before = first.join(F.broadcast(last), names).filter("_of < _part").groupBy(*names, "_part").agg(F.max("_before").alias("_before"))
    met = swept.filter(F.col("_kind") == _LEFT).join(F.broadcast(before), [*names, "_part"], "left")
    hit = F.col("_hit") | F.coalesce(F.col("_before") > F.col("_s"), F.lit(False))
    return met.select("_row", hit.alias("_hit")).unionByName(a.filter("not _known").select("_row", F.lit(False).alias("_hit")))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], id: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The ``id`` columns of the rows of ``left`` whose range overlaps one of ``right`` under the same ``keys``, each once."""
    return overlap_semi_join(left, right, keys, id, start, end).select(*id).distinct()


def overlap_semi_join(left: DataFrame, right: DataFrame, keys: list[str], id: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows of ``left`` that overlap a range of ``right``; ``id`` tells rows of ``left`` apart and has no nulls."""
    return _marked(left, right, keys, start, end).filter("_hit").select("_row.*")


def overlap_anti_join(left: DataFrame, right: DataFrame, keys: list[str], id: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows of ``left`` that overlap no range of ``right``."""
    return _marked(left, right, keys, start, end).filter("not _hit").select("_row.*")
