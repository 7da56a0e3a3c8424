"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigate.llm.common import discard, staged

EDGES_A_TASK = 100_000
#: A node with more edges than this, and than a hundredth of all, is a hub.
HUB = 1_000


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """rows (u, v), n at most, with m, the least neighbour of u. Hubs (a few hundred at most) are broadcast, so that
    their edges stay spread."""
    limit = max(HUB, n // 100)
    if n <= limit:
        return rows.join(least.select("u", "m"), "u")
    hubs = least.where(F.col("d") > limit).select("u", "m")
    light = rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("d") <= limit).select("u", "m"), "u")
    return light.unionByName(rows.join(F.broadcast(hubs), "u"))


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs to (node, root): root is the smallest node of its component.

    Every node of an edge is in the result, roots included. Each step joins edges with the smallest neighbour of
    a node, so no neighbourhood is ever gathered in one place, nor the edges of a hub in one task.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        parts = 1 + mark[0] // EDGES_A_TASK  # a step never has more edges than twice the last one
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("d"))
        large = _with_least(both, least, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large.coalesce(parts), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        small = _with_least(large, least, 2 * mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, staged(small.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().coalesce(parts), "edges")
        before, mark = mark, _mark(now)
        discard(last, large)
        if mark == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
