"""Contraction of graphs along a matching, by levels.

Weighted graphs are entries (src, dst, w); vertex weights are (v, vwgt).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assign import vertices
from .rank import ranked, saved


def weighted(edges: DataFrame) -> DataFrame:
    """Parallel entries as one of their number as weight."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def unit_weights(edges: DataFrame) -> DataFrame:
    return vertices(edges).select("v", F.lit(1).cast("long").alias("vwgt"))


def equal_weights(edges: DataFrame) -> DataFrame:
    """Whether all entries weigh the same."""
    return edges.agg((F.min("w") == F.max("w")).alias("equal_weights"))


def number(matching: DataFrame) -> DataFrame:
    """(v, cv): coarse ids from 0, by the smaller id of each pair. `matching` is (v, mate), alone where mate = v."""
    heads = matching.select(F.least("v", "mate").alias("head")).distinct()
    ids = ranked(heads, "head", name="cv")
    return matching.select("v", F.least("v", "mate").alias("head")).join(ids, "head").select("v", "cv")


def contract(edges: DataFrame, cmap: DataFrame) -> DataFrame:
    """Coarse entries (src, dst, w): weights added up, entries between the two of a pair gone.

    A self-loop of a vertex that is alone stays.
    """
    a = cmap.select(F.col("v").alias("src"), F.col("cv").alias("a"))
    b = cmap.select(F.col("v").alias("dst"), F.col("cv").alias("b"))
    paired = cmap.groupBy("cv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cv").alias("a"), F.lit(True).alias("paired"))
    rows = edges.join(a, "src").join(b, "dst").join(paired, "a", "left").where("a <> b or paired is null")
    return rows.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def contract_weights(vertex_weights: DataFrame, cmap: DataFrame) -> DataFrame:
    return vertex_weights.join(cmap, "v").groupBy(F.col("cv").alias("v")).agg(F.sum("vwgt").alias("vwgt"))


def _two_hop(alone: DataFrame, links: DataFrame, order: Column) -> DataFrame:
    """(v, mate) of unmatched vertices that have a neighbour in common, and of islands, two by two.

    Each vertex goes by its first neighbour, islands by none, and those that go by the same are paired in
    order of their ids. They are ranked by range, as a star's centre may have any number of them.
    """
    first = links.join(alone.select(F.col("v").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("v")).agg(F.min_by("dst", F.struct(order, F.col("dst"))).alias("centre"))
    rows = ranked(alone.join(first, "v", "left").select("v", F.coalesce("centre", F.lit(-1)).alias("centre")), "centre", "v", name="at")
    starts = rows.groupBy("centre").agg(F.min("at").alias("start"))
    pairs = rows.join(starts, "centre").groupBy("centre", F.floor((F.col("at") - F.col("start")) / 2).alias("pair")).agg(F.min("v").alias("u"), F.max("v").alias("w")).where("u <> w")
    return pairs.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("w").alias("mate")), F.struct(F.col("w").alias("v"), F.col("u").alias("mate")))).alias("m")).select("m.*")


def random_matching(edges: DataFrame, seed: int = 1, rounds: int = 4, rank: Callable[[Column, Column, int], Column] | None = None, two_hop: bool = False) -> DataFrame:
    """(v, mate): each round, vertices that name each other as their first free neighbour by a seeded hash are matched.

    `rank` replaces the hash: it gives the rank of a link out of its smaller and larger end and the round.
    `two_hop` then pairs those that are left over a neighbour in common, and islands, so that at most one
    vertex for each such neighbour stays alone.
    """
    both = saved(edges.select("src", "dst").unionAll(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct())
    matched = None
    for r in range(rounds):
        free = both
        if matched is not None:
            done = matched.select("v")
            free = both.join(done, both.src == done.v, "left_anti").join(done, both.dst == done.v, "left_anti")
        # The rank of a link is the same seen from both ends.
        ends = F.least("src", "dst"), F.greatest("src", "dst")
        order = F.xxhash64(*ends, F.lit(seed + r)) if rank is None else rank(*ends, r)
        first = free.groupBy("src").agg(F.min_by("dst", F.struct(order, F.col("dst"))).alias("mate"))
        back = first.select(F.col("src").alias("mate"), F.col("mate").alias("src"))
        pairs = first.join(back, ["src", "mate"]).select(F.col("src").alias("v"), "mate")
        matched = saved(pairs if matched is None else matched.unionAll(pairs))
    if two_hop:
        ends = F.least("src", "dst"), F.greatest("src", "dst")
        order = F.xxhash64(*ends, F.lit(seed + rounds)) if rank is None else rank(*ends, rounds)
        left = vertices(edges) if matched is None else vertices(edges).join(matched, "v", "left_anti")
        matched = saved(_two_hop(saved(left), both, order) if matched is None else matched.unionAll(_two_hop(saved(left), both, order)))
    alone = vertices(edges).join(matched, "v", "left")
    return alone.select("v", F.coalesce("mate", "v").alias("mate"))


def coarsen(edges: DataFrame, to: int, fraction: float = 0.85, seed: int = 1) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """Levels (entries, vertex weights, map from the level before), at least one.

    It ends at `to` vertices, when a level keeps more than `fraction` of the vertices of the one before,
    or when it has no more entries than half its vertices.
    """
    fine, weights, levels = saved(weighted(edges)), unit_weights(edges), []
    n = weights.count()
    while True:
        cmap = saved(number(random_matching(fine, seed + len(levels), two_hop=True)))
        fine, weights = saved(contract(fine, cmap)), saved(contract_weights(weights, cmap))
        levels.append((fine, weights, cmap))
        before, n = n, weights.count()
        if not (n > to and n < fraction * before and fine.count() > n / 2):
            return levels
