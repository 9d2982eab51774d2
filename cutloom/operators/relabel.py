"""New vertex ids under which every part is contiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rank import ranked


def relabel_map(assignment: DataFrame, base: int = 1) -> DataFrame:
    """(v, part, new_id): the rank by part and id, from `base`.

    Ranks are taken over ranges of (part, v), so no task sorts all vertices or all of a part.
    """
    rows = ranked(assignment.select("v", "part"), "part", "v")
    return rows.select("v", "part", (F.col("rank") + base).cast("long").alias("new_id"))


def part_boundaries(assignment: DataFrame, base: int = 1) -> DataFrame:
    """(part, upper): the exclusive upper bound of each part's new ids."""
    sizes = assignment.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("part", (F.sum("n").over(W.orderBy("part")) + base).cast("long").alias("upper"))


def relabel_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entries under new ids, each pair once; entries with an unknown end go."""
    a = mapping.select(F.col("v").alias("src"), F.col("new_id").alias("new_src"))
    b = mapping.select(F.col("v").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst")).distinct()


def source_id(mapping: DataFrame, source: int = 0) -> DataFrame:
    """The new id of one vertex, null if it is absent."""
    return mapping.where(F.col("v") == source).agg(F.max("new_id").alias("new_id"))
