"""What a partition's cut, boundaries and D values follow from, kept up to date while vertices move.

The state has one row for each vertex: its part, its degree, and how many entries reach it from each part,
at most as many numbers as there are parts. E is one of these numbers and D is reckoned from them without
a join. When vertices move, only the entries that leave them are looked up, and the two numbers that each
changes are added where the state lies: it is bucketed by vertex and the entries by source, so neither is
shuffled again, only the vertices that moved and what their entries change.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import degree
from .rank import Bucketed, bucketed, saved


def _as_map(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """(v, part, n) to (v, counts), a map from parts; as they lie in so many buckets of v, if `buckets` are given."""
    if buckets is not None:
        counts = counts.repartition(buckets, "v")
    return counts.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("counts"))  # an entry for each part at most


def count_entries(edges: DataFrame, assignment: DataFrame, n: int | None = None) -> Bucketed:
    """(v, part, deg, counts) of every assigned vertex; entries with an unassigned end do not count in `counts`. Entries that are bucketed by src are not shuffled by it; `n` is the number of buckets of the state."""
    assignment = saved(assignment.select("v", "part"))
    parts = assignment.select(F.col("v").alias("src"), "part")
    into = _as_map(edges.join(parts, "src").groupBy(F.col("dst").alias("v"), "part").agg(F.count(F.lit(1)).alias("n")), n)
    rows = assignment.select("v", "part").join(degree(edges), "v", "left").join(into, "v", "left")
    none = F.create_map().cast("map<int,bigint>")
    return bucketed(rows.select("v", F.col("part").cast("int").alias("part"), F.coalesce("deg", F.lit(0)).cast("long").alias("deg"), F.coalesce("counts", none).alias("counts")), "v", n=n)


def entries_from(part: Column) -> Column:
    """How many entries reach a vertex of the state from a part."""
    return F.coalesce(F.col("counts")[part], F.lit(0)).cast("long")


def d_values(state: DataFrame, pairs: Iterable[tuple[int, int]], kind: str = "all") -> DataFrame:
    """(a, b, v, part, deg, ext, d) of the boundary vertices of single or disjoint pairs of parts, as `refine.d_values` gives them."""
    pairs = [(min(p), max(p)) for p in pairs]
    mate = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    if len(mate) < 2 * len(pairs):
        raise ValueError("pairs of parts must be disjoint")
    partner = F.create_map(*[F.lit(x) for p in mate.items() for x in p])[F.col("part")]
    rows = state.withColumn("mate", partner).where("mate is not null").withColumn("ext", entries_from(F.col("mate"))).where("ext > 0")
    d = F.col("ext") - entries_from(F.col("part")) if kind == "pair" else 2 * F.col("ext") - F.col("deg")
    return rows.select(F.least("part", "mate").alias("a"), F.greatest("part", "mate").alias("b"), "v", "part", "deg", "ext", d.cast("long").alias("d"))


def cut_entries(state: DataFrame) -> DataFrame:
    """cut_entries, and edge_cut = cut_entries div 2."""
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, b: a + b)
    return state.agg(F.coalesce(F.sum(total - entries_from(F.col("part"))), F.lit(0)).alias("cut_entries")).select("cut_entries", F.expr("cut_entries div 2").alias("edge_cut"))


def move(state: Bucketed, links: Bucketed, moved: DataFrame) -> Bucketed:
    """The state after vertices moved (v, old, new). `links` are the entries, bucketed by src."""
    sent = links.rows.join(moved.withColumnRenamed("v", "src"), "src")
    ways = sent.groupBy(F.col("dst").alias("v"), "old", "new").agg(F.count(F.lit(1)).alias("n"))  # each entry once; the two numbers come out of what they add up to
    changes = F.explode(F.array(F.struct(F.col("old").alias("part"), (-F.col("n")).alias("n")), F.struct(F.col("new").alias("part"), F.col("n").alias("n"))))
    deltas = _as_map(ways.select("v", changes.alias("c")).groupBy("v", "c.part").agg(F.sum("c.n").alias("n")).where("n <> 0"), state.n).withColumnRenamed("counts", "delta")
    rows = state.rows.join(moved.select("v", "new"), "v", "left").join(deltas, "v", "left")
    both = F.map_filter(F.map_zip_with("counts", "delta", lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), lambda k, n: n > 0)
    return bucketed(rows.select("v", F.coalesce("new", "part").alias("part"), "deg", F.when(F.col("delta").isNull(), F.col("counts")).otherwise(both).alias("counts")), "v", in_place=True, n=state.n)
