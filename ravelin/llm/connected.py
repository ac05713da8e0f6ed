"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), as joins and min aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of longs, without self-links -> (u, v): each node but the smallest of its component, and that smallest.

    A round's groups are reduced by min() on the map side, so a hub costs its edges only. Raises if rounds run out.
    """
    signature = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = staged(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = signature(now)
    for _ in range(max_rounds):
        now = staged(_small_star(_large_star(now)), "stars")
        after = signature(now)
        if tuple(after) == tuple(before):
            return now
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
