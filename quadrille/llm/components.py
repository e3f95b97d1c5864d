"""Connected components by alternating large and small stars, in DataFrame operations on edge lists."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.storage import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): component is the least id reachable.

    Each round keeps an edge list no longer than the first, in a table in the shared folder; a hub's edges are aggregated
    before the shuffle and joined by a join that can split them. Self-loops and repeats are allowed.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        # Large star: the greater neighbours of u go to the least of u's neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the lesser neighbours of u, and u, go to the least of them.
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select("u", "v", "m")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v"))).distinct()
        after = stored(after, "edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(now)
        now = after
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = state
