"""Box blur of rasters by tiles with halos, for pictures that no row could hold.

A raster is a table of samples (id, x, y, value). Along an axis each sample goes to the tile it lies in and, where
it is within the radius of the tile's border, to the neighbour it is a halo of; samples at the raster's edge
stand in for those beyond it, so means are clamped. Within a tile a window takes the mean of 2 r + 1
samples, and halo samples are left out of the result. The second axis works on the result of the first, as
a box mean is the mean of means. A tile's line is a window's group, so no group grows with the raster, and a
raster with a third of all samples is spread by its tiles.

Rows with a null place or value take no part and are left out of the result. ``width`` and ``height`` come with each row. A radius of 0
gives the values as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 256


def _axis(samples: DataFrame, id: list[str], at: str, size: str, other: str, radius: int, tile: int) -> DataFrame:
    x, r = F.col(at), F.lit(radius)
    # edges repeated ``radius`` times stand for what lies beyond
    beyond: Column = F.concat(
        F.when(x == 0, F.sequence(-r, F.lit(-1))).otherwise(F.array().cast("array<int>")), F.array(x.cast("int")),
        F.when(x == F.col(size) - 1, F.sequence(F.col(size).cast("int"), F.col(size).cast("int") + r - 1)).otherwise(F.array().cast("array<int>")),
    )
    laid = samples.withColumn("_at", F.explode(beyond))
    inside = F.least(F.greatest(F.col("_at"), F.lit(0)), F.col(size).cast("int") - 1)
    own = F.floor(inside / tile).cast("int")
    tiles = F.array_distinct(F.array(own, F.greatest(F.floor((F.col("_at") - r) / tile).cast("int"), F.lit(0)), F.least(F.floor((F.col("_at") + r) / tile).cast("int"), F.floor((F.col(size) - 1) / tile).cast("int"))))
    dealt = laid.withColumn("_own", (F.col("_at") == x) & (own == F.floor(x / tile))).withColumn("_tile", F.explode(tiles)).withColumn("_own", F.col("_own") & (F.col("_tile") == own))
    near = Window.partitionBy(*id, other, "_tile").orderBy("_at").rowsBetween(-radius, radius)
    return dealt.withColumn("_mean", F.avg("value").over(near)).filter("_own").withColumn("value", F.col("_mean")).select(*samples.columns)


def box_blur(samples: DataFrame, id: list[str], radius: int, tile: int = TILE) -> DataFrame:
    """``samples`` (``id``, x, y, width, height, value) with the clamped mean of the box of ``radius`` around each as its value."""
    if not 0 <= radius <= tile:
        raise ValueError(f"a radius of {radius} does not fit tiles of {tile}")
    rows = samples.select(*id, "x", "y", "width", "height", F.col("value").cast("double").alias("value")).dropna(subset=["x", "y", "width", "height", "value"])
    if not radius:
        return rows
    return _axis(_axis(rows, id, "x", "width", "y", radius, tile), id, "y", "height", "x", radius, tile)
