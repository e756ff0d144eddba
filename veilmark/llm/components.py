"""Connected components by alternating large and small stars, every step a join and a minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets, and a one-row result."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) for each end of the edges (a, b); component is the smallest id reachable.

    Loops and repeated edges do no harm; an empty table gives an empty one. A hub with very many
    edges only ever meets its own minimum, by a join that Spark can split. Raises after most rounds.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(most):
        both = now.union(now.select("b", "a"))
        # minima are written before they are joined on their own key: joined at once they'd share their shuffle
        # with the join, and Spark couldn't split a hub's edges
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        # large star: every larger neighbour of a goes to the least of a and its neighbours
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: a and its smaller neighbours go to the least of them
        down = cut(large.select(F.col("b").alias("n"), F.col("a").alias("s")))
        low = cut(down.groupBy("n").agg(F.min("s").alias("m")))
        small = down.join(low, "n").where("s <> m").select(F.col("m").alias("a"), F.col("s").alias("b")).union(low.select(F.col("m").alias("a"), F.col("n").alias("b")))
        new = cut(small.where("a <> b").distinct())
        before, after = mark, _mark(new)
        mark = after
        if before == after:
            return new.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component").union(new.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
        now = new
    raise RuntimeError(f"components did not settle in {most} rounds")
