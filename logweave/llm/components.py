"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is two equal-key aggregations and joins on the links; nothing is collected.  A hub's links meet its smallest
neighbour through a join, whose hub side Spark can split, and not through one group held in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.plans.session import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node move to its smallest neighbour; small star: those below, and itself."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(state: DataFrame) -> bool:
    """Whether every node points to one smaller node that points nowhere: the fixed point of both steps."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(state.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node that has a link in ``links(u, v)``.

    Defined results: links of a node with itself and repeated links count for nothing; no links give no rows; ends must not
    be null. The state of each round is written to ``folder``.
    """
    state = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", folder)
    while not _are_stars(state):  # O(log^2 n) rounds
        state = written(_star(_star(state, True), False), "links", folder)
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
