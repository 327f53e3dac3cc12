"""Connected components of an edge table by alternating stars (Kiveris et al., 2014).

Only minima per node are aggregated (combined before the shuffle), stored and joined back, so that both sides of the join are
plain exchanges, which Spark can split where a node is hot: no component is ever in one task. Every step is written to the shared folder and so cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_STEPS = 60


def _distinct(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "minima")
    return _distinct(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    least = stored(e.groupBy("u").agg(F.min("v").alias("m")), "minima")
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``node, root`` (the smallest node of the component) of every node that is not its component's root.

    ``edges``: two bigint columns; loops, repeats, both directions and nulls are allowed. Empty: empty."""
    e = stored(_distinct(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")),
               "edges")
    last = None
    for _ in range(MAX_STEPS):
        s = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if (s.n, s.h) == last or not s.n:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = (s.n, s.h)
        e = stored(_small_star(_large_star(e)), "edges")
    raise RuntimeError("components did not converge")
