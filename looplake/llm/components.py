"""Connected components of a link table by alternating large and small stars.

Nothing is collected: every round is an aggregation (smallest neighbour of each node) and a join
on the node, both over link rows; a node with very many links costs partial minima.  Rounds are
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looplake.llm.common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round over links (u, v) with u > v."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component`` (its smallest node) for every node of the links ``a, b``; nodes without
    links are not listed."""
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = materialize(_star(_star(now, True), False))
        last, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
