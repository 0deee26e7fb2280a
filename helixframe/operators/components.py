"""Connected components by alternating large-star and small-star rounds.

Every round only groups and joins by node, so no component is gathered anywhere. The smallest neighbours are written to the
shared folder before edges are joined to them: then both sides of the join are plain shuffles, which adaptive execution splits
where a node has very many edges. The loop ends when a round changes no edge, and then every node hangs on the smallest node of
its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.storage import drop, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    out = stage(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "components")
    drop(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stage(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
    drop(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component. Null ends and loops are ignored."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    now = stage(pairs.distinct(), "components")
    mark = _mark(now)
    while mark[0]:
        large = _large_star(now)
        drop(now)
        now = _small_star(large)
        drop(large)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
