"""Adjacency, degrees, sizes, cuts, boundaries and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import HUB_FLOOR, hub_degree
from .assign import scatter_hubs
from .rank import ranked

#: Candidates beyond this number are looked up by a shuffle; up to it they are sent to all tasks.
_MANY = 1_000_000


def adjacency(edges: DataFrame, combine: Column | None = None) -> DataFrame:
    """(rank, nbrs): the bag of neighbours of each source, ascending, or what the aggregate `combine` makes of `dst`."""
    return edges.groupBy(F.col("src").alias("rank")).agg((F.sort_array(F.collect_list("dst")) if combine is None else combine).alias("nbrs"))


def folded(edges: DataFrame, fold: Callable[[np.ndarray], np.ndarray], keep: int) -> DataFrame:
    """(rank, nbrs): what a function of one's own makes of the neighbours of each source, in two steps.

    `fold` takes any part of a source's bag and returns at most `keep` ids of it; it must give the same for
    a bag as for the folds of its parts put together. Tasks fold what they read, source by source, and
    only folds are shuffled and folded again, so a hub's bag is never in one row or task.
    """
    schema = pa.schema([("rank", pa.int64()), ("nbrs", pa.list_(pa.int64()))])

    def per_source(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        starts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, np.int64)
        folds = [fold(part) for part in np.split(dst, starts[1:])] if len(src) else []
        if any(len(f) > keep for f in folds):
            raise ValueError(f"the fold returned more than {keep} ids")
        return pa.RecordBatch.from_arrays([pa.array(src[starts], pa.int64()), pa.array([f.tolist() for f in folds], pa.list_(pa.int64()))], schema=schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = pa.Table.from_batches([b]).drop_null()
            if b.num_rows:
                yield per_source(b.column("src").to_numpy(), b.column("dst").to_numpy())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by source; the last source of a batch may go on in the next."""
        held: pa.RecordBatch | None = None
        for b in batches:
            src, lists = b.column("rank").to_numpy(zero_copy_only=False), b.column("nbrs")
            src, dst = np.repeat(src, lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
            if held is not None:
                src = np.concatenate([np.full(len(held.column("nbrs")[0]), held.column("rank")[0].as_py(), np.int64), src])
                dst = np.concatenate([np.array(held.column("nbrs")[0].as_py(), np.int64), dst])
            if not len(src):
                continue
            out = per_source(src, dst)
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            held = out.slice(out.num_rows - 1, 1)
        if held is not None:
            yield held

    parts = edges.select("src", "dst").mapInArrow(partial, "rank long, nbrs array<long>")
    return parts.repartition("rank").sortWithinPartitions("rank").mapInArrow(merge, "rank long, nbrs array<long>")


def adjacency_chunks(edges: DataFrame, hubs: DataFrame, salts: int = 64) -> DataFrame:
    """(rank, bucket, nbrs): like `adjacency`, but a hub's neighbours come in as many rows as `salts`, so that no row or task holds them all."""
    return scatter_hubs(edges, hubs, salts).groupBy(F.col("src").alias("rank"), "bucket").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def flatten(adj: DataFrame) -> DataFrame:
    """The entries of an adjacency."""
    return adj.select(F.col("rank").alias("src"), F.explode("nbrs").alias("dst"))


def combined_pairs(edges: DataFrame) -> DataFrame:
    """Entries merged into an existing record: entries minus sources."""
    sources = count_distinct(edges.select(F.col("src").alias("v")))
    return edges.agg(F.count(F.lit(1)).alias("all")).crossJoin(F.broadcast(sources)).select((F.col("all") - F.col("n")).alias("combined_pairs"))  # one row each


def count_distinct(ids: DataFrame) -> DataFrame:
    """(n): how many different ids (v) there are, exactly. Tasks set bits, and only bitmaps of 32,768 ids each are shuffled, none of the ids."""
    bits = ids.where("v is not null").groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def vertex_count(edges: DataFrame, sources_only: bool = False) -> DataFrame:
    ids = edges.select(F.col("src").alias("v"))
    return count_distinct(ids if sources_only else ids.unionAll(edges.select("dst"))).select(F.col("n").alias("n_vertices"))


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_id"), F.count(F.lit(1)).alias("n_entries"), F.expr("count(1) div 2").alias("n_edges"))


def degree(edges: DataFrame) -> DataFrame:
    """Out-degree with multiplicity of every source: (v, deg)."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("deg"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degree(edges).groupBy("deg").agg(F.count(F.lit(1)).alias("n_vertices"))


def hubs(edges: DataFrame, asked: int = 0, floor: int = HUB_FLOOR) -> DataFrame:
    """Vertices of a degree of `asked` or more, `floor` at least."""
    return degree(edges).where(F.col("deg") >= hub_degree(asked, floor))


def heavy_hitters(edges: DataFrame, size: int = 4096) -> DataFrame:
    """(v, deg): all sources that hold more than one in `size` of the entries, with their exact degrees.

    Every task keeps `size` counters while it reads (Misra and Gries): a source without one takes a free
    one, and if there is none all are lowered by what the smallest has. What is left is counted for sure,
    and falls short of a source's entries by a `size`-th of the task's entries at most, so no source of
    more than a `size`-th of all is lost. Only these candidates, `size` times the tasks, are counted
    exactly in a second pass; no other vertex is shuffled.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lost = 0
        for batch in batches:
            mine = batch.column("src").drop_null().to_numpy(zero_copy_only=False)
            own, n = np.unique(mine, return_counts=True)
            ids, at = np.unique(np.concatenate([ids, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(ids)).astype(np.int64)
            if len(ids) > size:
                # The counter that is the largest of those without a place is taken from all.
                cut = np.partition(counts, len(ids) - size - 1)[len(ids) - size - 1]
                lost += int(cut)
                ids, counts = ids[counts > cut], counts[counts > cut] - cut
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array(np.full(len(ids), lost))], names=["v", "low", "lost"])

    found = edges.select("src").mapInArrow(summary, "v long, low long, lost long")
    candidates = found.select("v").distinct()
    exact = degree(edges.join(F.broadcast(candidates) if candidates.limit(_MANY + 1).count() <= _MANY else candidates, edges.src == candidates.v, "left_semi"))
    total = edges.agg(F.count(F.lit(1)).alias("all"))
    return exact.crossJoin(F.broadcast(total)).where(F.col("deg") * size > F.col("all")).drop("all")  # one row


def part_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("part").agg(F.count(F.lit(1)).alias("n_vertices"))


def _with_part(edges: DataFrame, assignment: DataFrame, end: str, part: str, hubs: DataFrame | None) -> DataFrame:
    """Entries with the part of one end. The parts of hubs are sent to all tasks and their entries stay where they are; the others meet theirs by a shuffle."""
    a = assignment.select(F.col("v").alias(end), F.col("part").alias(part))
    if hubs is None:
        return edges.join(a, end)
    few = F.broadcast(hubs.select(F.col("v").alias(end)).distinct())
    own = F.broadcast(a.join(few, end))
    return edges.join(own, end).unionByName(edges.join(few, end, "left_anti").join(a, end))


def placed(edges: DataFrame, assignment: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Entries with the parts of both ends (src, dst, ps, pd); entries with an unassigned end go.

    With `hubs` (v), which are few (see `heavy_hitters`), no task gets all entries of one of them.
    """
    return _with_part(_with_part(edges, assignment, "src", "ps", hubs), assignment, "dst", "pd", hubs).select("src", "dst", "ps", "pd")


def edge_cut(edges: DataFrame, assignment: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """cut_entries, and edge_cut = cut_entries div 2."""
    cut = placed(edges, assignment, hubs).agg(F.coalesce(F.sum((F.col("ps") != F.col("pd")).cast("long")), F.lit(0)).alias("cut_entries"))
    return cut.select("cut_entries", F.expr("cut_entries div 2").alias("edge_cut"))


def edge_cut_per_part(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    return placed(edges, assignment).groupBy(F.col("ps").alias("part")).agg(F.sum((F.col("ps") != F.col("pd")).cast("long")).alias("cut_entries"))


def largest_cut(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """The part with the most cut entries, the smallest of several."""
    return edge_cut_per_part(edges, assignment).agg(F.max_by("part", F.struct("cut_entries", -F.col("part"))).alias("part"), F.max("cut_entries").alias("cut_entries"))


def cut_matrix(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    return placed(edges, assignment).groupBy("ps", "pd").agg(F.count(F.lit(1)).alias("n_entries"))


def external_counts(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(part, v, ext_cnt): entries that reach an outside vertex from each part."""
    cut = placed(edges, assignment).where("ps <> pd")
    return cut.groupBy(F.col("ps").alias("part"), F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("ext_cnt"))


def boundary_vertices(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Vertices that an entry of another part reaches: (v, part, ext)."""
    return placed(edges, assignment).where("ps <> pd").groupBy(F.col("dst").alias("v"), F.col("pd").alias("part")).agg(F.count(F.lit(1)).alias("ext"))


def key_windows(assignment: DataFrame, size: int = 20) -> DataFrame:
    """The window of at most `size` vertices, by id, that each vertex has in its part."""
    rows = ranked(assignment.select("v", "part"), "part", "v")
    first = rows.groupBy("part").agg(F.min("rank").alias("first"))
    return rows.join(F.broadcast(first), "part").select("v", "part", F.floor((F.col("rank") - F.col("first")) / size).alias("window"))


def nth_vertex(ids: DataFrame, n: int) -> DataFrame:
    """The n-th smallest id, counted from 0. Ids are ranked by range, so no task goes through them all."""
    return ranked(ids.select("v"), "v").where(F.col("rank") == n).select("v")


def longest_interval(bounds: DataFrame, threads: int = 0, n_vertices: int = 0) -> DataFrame:
    """The widest interval of the bounds, or without bounds the even share plus the rest."""
    if threads:
        return bounds.sparkSession.range(1).select(F.lit(n_vertices // threads + n_vertices % threads).cast("long").alias("width"))
    return bounds.agg(F.max(F.col("upper") - F.col("lower")).alias("width"))


def run_report(timings: DataFrame) -> DataFrame:
    """Timings of workers (name, value) as the maximum and the sum by name."""
    return timings.groupBy("name").agg(F.max("value").alias("longest"), F.sum("value").alias("total"))
