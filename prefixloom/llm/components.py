"""Connected components of a graph given as an edge table, by alternating large and small stars.

Every step is a grouped minimum (partial aggregation first) joined back to the edges, so a hub with
any number of edges never meets in one task: its side of the join can be split. The edges of each
round are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame) -> DataFrame:
    """Of (u, v): every v with the least of u's neighbours and u itself, and u too."""
    least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).withColumn("_m", F.least("_u", "_m"))
    return edges.join(least, edges["u"] == least["_u"]).select("u", "v", F.col("_m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots; a root is the least node of its component."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        s = _star(large)
        small = s.select("u", F.col("m").alias("v")).unionByName(s.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct())
    raise RuntimeError(f"no components after {max_rounds} rounds")
