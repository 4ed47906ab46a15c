"""Results under the newest policy only, in a running stream.

When a policy changes while files are in flight, results under the old one may arrive after those under
the new. For each path the newest (generation, time) that was let through is held; a result passes if it
is beyond that, so consumers see results of a path in the order of their policies and none twice. Paths
are dealt to ``BUCKETS`` buckets by hash, and a bucket's paths are settled together: a call of Python for
each path would cost more than all else. State is keyed by bucket and kept by the state store across
restarts: a path and two numbers a path, for as long as the stream lives, because a late result may be of
any age. A bucket is one of 4 096, so a task holds that share of the paths at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import prepare

BUCKETS = 4096  # as long as a stream lives: its state is keyed by them
_HELD = ["path", "generation", "time"]


def _packed(held: dict[str | None, tuple[int, int]]) -> bytes:
    columns = [pa.array(list(held), pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))]
    batch, sink = pa.RecordBatch.from_arrays(columns, _HELD), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> dict[str | None, tuple[int, int]]:
    path, generation, time = (c.to_pylist() for c in pa.ipc.open_stream(bytes(raw)).read_all().columns)
    return dict(zip(path, zip(generation, time, strict=True), strict=True))


def _newest(generation: str, time: str, columns: list[str]):
    order = [generation, time]

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:  # one row a path, whatever the batch holds for it
            both = part if best is None else pd.concat([best, part])
            best = both.sort_values(order, kind="stable").drop_duplicates("_path", keep="last")
        if best is None:
            return
        held = _unpacked(state.get[0]) if state.exists else {}
        at = list(zip(best[generation].astype("int64").tolist(), best[time].astype("datetime64[ns]").astype("int64").tolist(), strict=True))
        paths = best["_path"].tolist()
        beyond = [p not in held or a > held[p] for p, a in zip(paths, at, strict=True)]
        held.update((p, a) for p, a, ok in zip(paths, at, beyond, strict=True) if ok)
        state.update((_packed(held),))
        if any(beyond):
            yield best.loc[beyond, columns] if best.index.is_unique else best[beyond][columns]

    return run


def newest_policy(results: DataFrame, path: str = "path", generation: str = "generation", time: str = "modificationTime") -> DataFrame:
    """Each path's results whose (``generation``, ``time``) is beyond all that passed before; of a batch the last of them.

    ``generation`` is a number that grows with the policies. Rows without a generation or time do not pass.
    """
    prepare(results.sparkSession)
    # pandas would make numbers beside nulls floats: large ones travel as text
    wide = {f.name for f in results.schema if isinstance(f.dataType, LongType) and f.name != generation}
    schema = StructType([StructField(f.name, StringType()) if f.name in wide else f for f in results.schema])
    key = F.col(path).cast("string")
    bucket = F.when(key.isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    rows = results.filter(F.col(generation).isNotNull() & F.col(time).isNotNull()).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], key.alias("_path"), bucket.cast("int").alias("_bucket"))
    run = _newest(generation, time, results.columns)
    passed = rows.groupBy("_bucket").applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.NoTimeout)
    return passed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in results.schema])
