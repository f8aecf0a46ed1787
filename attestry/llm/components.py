"""Connected components of a large graph by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the edge table; the work is in proportion to the edges, no group is
collected, and stars shrink geometrically.  Rounds are cut with checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """``u > v`` edges in, ``u > v`` edges out; each node's neighbours are hung under its least neighbour."""
    sides = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if small:
        out = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge in ``edges(u, v)`` (longs); the root is the component's least node.

    Self-edges and nulls are ignored; repeated and reversed edges count once; an empty table gives an empty one.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = checkpointed(now)
    mark = None
    while True:
        got = now.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))").alias("s")).first()
        if (got["n"], got["s"]) == mark or got["n"] == 0:
            break
        mark = (got["n"], got["s"])
        now = checkpointed(_star(_star(now, small=False), small=True))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
