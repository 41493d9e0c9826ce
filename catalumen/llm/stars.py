"""Connected components of a table of links by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.llm.base import written

# Rounds grow with the logarithm of a component's size; this only stops a fault from looping for ever.
MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """For every node, its larger neighbours move to the smallest node around it."""
    around = links.groupBy(F.col("high").alias("low")).agg(F.min("low").alias("least"))
    return links.join(around, "low", "left").select("high", F.coalesce("least", "low").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """For every node, it and its smaller neighbours move to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high")
    side = F.when(F.col("low") > F.col("least"), F.col("low")).otherwise(F.col("high"))
    return moved.select(side.alias("high"), F.col("least").alias("low")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of all linked nodes; a component is named by its smallest node.

    ``links`` may hold repeated rows, both directions and loops. Nodes without
    a link are not listed. Each round is one written table.
    """
    links = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    links, seen = written(links, "links"), None
    for _ in range(MAX_ROUNDS):
        state = tuple(links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        links = written(_small_star(_large_star(links)), "links")
    else:
        raise RuntimeError("the components did not settle")
    # At the end every other node points at the smallest one, which is added itself.
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
