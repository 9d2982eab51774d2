"""Connected components of a graph given as links, by alternating star contractions.

Both steps only aggregate and join on the vertex; a hub's links are never gathered in one row. Each
round is kept in the shared folder until the next one is. Large-star joins every larger neighbour to the smallest
one; small-star joins all not larger ones to the smallest; when nothing changes every vertex points
at the smallest of its component (Kiveris et al., 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import remove, saved, table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(u, v) links of longs to (node, root): the smallest node that each linked node reaches."""
    spark, path = edges.sparkSession, table(edges.sparkSession)
    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), path)
    before = None
    for _ in range(max_rounds):
        old, path = path, table(spark)
        edges = saved(_small_star(_large_star(edges)), path)
        remove(spark, old)
        # The links change in every round but the last, and so does this digest of them.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
