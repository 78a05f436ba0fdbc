"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Points neighbours at the least node around: the larger ones (large star), or all that are not larger and the node itself (small star)."""
    if large:
        near = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = near.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of node's component. Nodes without a link to another have no row.

    ``links`` has integer columns a and b, in any order, repeats allowed. Each round is one reliable checkpoint;
    the rounds end when the stars no longer change, which takes O(log^2 n) of them.
    """
    now = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
