"""Connected components of an edge table, by alternating stars.

Each round links every node's larger neighbours to its least neighbour (large
star) and then its smaller neighbours, and itself, to the least of them (small
star), until nothing changes; then every node hangs on its component's least.
A node's least neighbour is an aggregate joined back on, never a gathered
group, so a node with a third of all edges is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the least node of each node's component, for all nodes
    of ``edges`` (u, v) but the least ones themselves."""
    mark = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31))]
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = now.agg(*mark).first()
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        if (found := now.agg(*mark).first()) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("least"))
        seen = found
