"""Connected components of a link table, by alternating large-star and small-star steps.

Links are kept as (u, v) with u > v. A large-star step hands each link to its smaller end's smallest
neighbour, a small-star step ties all smaller neighbours of a node to the smallest. Both are a partial
aggregate and a join on a node; no neighbour list is ever collected. Nodes with more than one in ``HOT``
of all links, fewer than 2 ``HOT``, are joined by broadcast, so a hub makes no heavy task.
Published as the star algorithms of Kiveris et al. (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, remove, saved


def _hubs(edges: DataFrame, total: int) -> tuple[list[int], list[int]]:
    """Nodes that are the smaller, and the larger, end of more than one in ``HOT`` links; fewer than ``HOT`` each."""
    ends = edges.select(F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("v").alias("node")), F.struct(F.lit(1).alias("end"), F.col("u").alias("node")))).alias("e"))
    rows = ends.groupBy("e.end", "e.node").agg(F.count("*").alias("n")).filter(F.col("n") * HOT > total).collect()
    return [r["node"] for r in rows if r["end"] == 0], [r["node"] for r in rows if r["end"] == 1]


def _joined(edges: DataFrame, key: str, least: DataFrame, hubs: list[int], how: str) -> DataFrame:
    """``edges`` with the row of ``least`` (node, m) for their ``key``; hubs by broadcast."""
    if not hubs:
        return edges.join(least, F.col(key) == F.col("node"), how)
    cold = edges.filter(~F.col(key).isin(hubs)).join(least, F.col(key) == F.col("node"), how)
    return cold.unionByName(edges.filter(F.col(key).isin(hubs)).join(F.broadcast(least.filter(F.col("node").isin(hubs))), F.col(key) == F.col("node"), how))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, hubs: list[int]) -> DataFrame:
    return _joined(edges, "v", _least(edges), hubs, "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame, hubs: list[int]) -> DataFrame:
    least = _least(edges)
    out = _joined(edges, "u", least, hubs, "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))


def connected_components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    ``links`` holds two long columns, a and b; order, repeats and self links do not matter, rows with
    a null end are left out. An empty table gives an empty table.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = saved(edges.filter("u is not null and v is not null and u <> v").distinct(), "links")
    total = edges.count()
    mark = None
    for _ in range(limit):
        low, high = _hubs(edges, total)
        after = saved(_small_star(_large_star(edges, low), high).distinct(), "links")
        row = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for path in {f.rsplit("/", 1)[0] for f in edges.inputFiles()}:
            remove(spark, path)
        edges, total = after, row[0]
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    else:
        raise RuntimeError(f"components did not settle in {limit} steps")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
