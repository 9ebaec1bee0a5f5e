"""Connected components of an edge table by alternating stars.

Every round keeps the components, pulls nodes towards the smallest node they can see and
removes duplicate edges; it ends when each component is a star around its smallest node.
Rounds grow with the logarithm of a component's diameter. Minima are grouped aggregates
(combined before the shuffle), so a hub with very many neighbours is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.common import landed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"),
                                                           F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` go from the larger node a to the smaller node b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(low, "a")
    return (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct())


def components(spark: SparkSession, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of (a, b) edges; root is the component's smallest node."""
    now = landed(spark, edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    state = None
    for _ in range(rounds):
        now = landed(spark, _small_star(_large_star(now)), "components")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
