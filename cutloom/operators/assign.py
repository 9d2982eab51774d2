"""Placing vertices into parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import check_parts
from .rank import saved


def vertices(edges: DataFrame) -> DataFrame:
    """Every endpoint once: (v)."""
    return edges.select(F.col("src").alias("v")).unionAll(edges.select(F.col("dst").alias("v"))).distinct()


def hash_assign(edges: DataFrame, k: int, n_vertices: int | None = None) -> DataFrame:
    """part(v) = v mod k for every endpoint; with `n_vertices` also for isolated vertices 0..n."""
    check_parts(k)
    ids = vertices(edges) if n_vertices is None else edges.sparkSession.range(n_vertices + 1).select(F.col("id").alias("v"))
    return ids.select("v", F.pmod("v", F.lit(k)).cast("int").alias("part"))


def range_assign(ids: DataFrame, k: int, n_vertices: int) -> DataFrame:
    """Blocks of n_vertices div k ids; the last part takes the rest."""
    check_parts(k)
    width = max(1, n_vertices // k)
    return ids.select("v", F.least(F.floor(F.col("v") / width), F.lit(k - 1)).cast("int").alias("part"))


def bounds_assign(ids: DataFrame, bounds: DataFrame) -> DataFrame:
    """The part whose half-open interval [lower, upper) holds the id; ids in no interval have none.

    The intervals do not overlap; there may be any number. Ids and lower bounds are dealt by range
    together, and an id's interval is the last one before it: in its task, or in a task before, of which
    there is a row each.
    """
    none = F.lit(None).cast("struct<upper:bigint,part:int>")
    here = ids.select(F.col("v").alias("at"), F.lit(1).alias("kind"), none.alias("own"))
    marks = bounds.select(F.col("lower").cast("long"), F.lit(0), F.struct(F.col("upper").cast("long").alias("upper"), F.col("part").cast("int").alias("part")))
    both = here.unionAll(marks)
    # Of intervals with one lower bound all but the last are empty.
    dealt = saved(both.repartitionByRange("at", "kind").sortWithinPartitions("at", "kind", "own").withColumn("id", F.monotonically_increasing_id())).withColumn("task", F.shiftright("id", 33))
    ends = dealt.where("kind = 0").groupBy("task").agg(F.max_by("own", "id").alias("end"))
    tasks = dealt.select("task").distinct().join(ends, "task", "left")
    before = tasks.select("task", F.last("end", ignorenulls=True).over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))  # a row for each task
    last = F.last("own", ignorenulls=True).over(W.partitionBy("task").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    found = dealt.withColumn("last", last).where("kind = 1").join(F.broadcast(before), "task").select(F.col("at").alias("v"), F.coalesce("last", "carried").alias("x"))
    return found.where("v < x.upper").select("v", F.col("x.part").alias("part"))


#: Hubs beyond this number are marked by a shuffle; up to it they are sent to all tasks.
_MANY_HUBS = 1_000_000


def scatter_hubs(edges: DataFrame, hubs: DataFrame, salts: int) -> DataFrame:
    """Entries with the bucket they are placed in: by their source, but a hub's entries by their target.

    Only the physical placement changes, never the assignment. Where hubs are few, no shuffle marks them.
    """
    mark = hubs.select(F.col("v").alias("src"), F.lit(True).alias("hub"))
    mark = F.broadcast(mark) if hubs.limit(_MANY_HUBS + 1).count() <= _MANY_HUBS else mark
    place = F.when(F.col("hub"), F.pmod(F.xxhash64("dst"), F.lit(salts))).otherwise(F.pmod(F.xxhash64("src"), F.lit(salts)))
    return edges.join(mark, "src", "left").select("src", "dst", place.cast("int").alias("bucket"))


def overlay(first: DataFrame, then: DataFrame) -> DataFrame:
    """An assignment in which a later one wins where it has the vertex."""
    return first.join(then.select("v", F.col("part").alias("new")), "v", "full_outer").select("v", F.coalesce("new", "part").cast("int").alias("part"))
