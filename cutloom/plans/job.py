"""The whole partitioning job: read, assign, refine, measure, write."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..model import HUB_FLOOR, batch_size, check_parts, check_range, hub_degree
from ..operators import assign, metrics, refine
from ..operators.rank import saved
from ..sources import sinks, text


@dataclass
class Result:
    assignment: DataFrame
    metrics: DataFrame
    visited: DataFrame | None = None


@dataclass
class PartitionJob:
    """A graph folder to `k` parts.

    `mode` none keeps the hash partition, static and dynamic refine it. `before_refine` is called with
    the hash partition and `after_refine` with the final one, before it is written to `output` (if given)
    as one folder per part. `parse` replaces the built-in line parser. `on_vertices` is a function over
    batches of adjacency records (rank, nbrs, part) in pandas, with the schema of what it makes of them;
    the result has that as `visited`.
    """

    path: str | list[str]
    fmt: str
    k: int
    n_vertices: int | None = None
    hub_degree: int = 0
    hub_floor: int = HUB_FLOOR
    mode: str = "static"
    schedule: str = "rounds"
    window: int | None = None
    cursor: bool = False
    accept: str = "always"
    threads: int = 1
    batch: int = 0
    output: str | None = None
    symmetrize: bool = False
    include_isolated: bool = False
    parse: Callable[[DataFrame], DataFrame] | None = None
    before_refine: Callable[[DataFrame], None] | None = None
    after_refine: Callable[[DataFrame], None] | None = None
    on_vertices: tuple[Callable, str] | None = None
    timings: dict[str, float] = field(default_factory=dict)

    def _timed(self, name: str, f: Callable[[], DataFrame]) -> DataFrame:
        began = time.perf_counter()
        out = f()
        self.timings[name] = time.perf_counter() - began
        return out

    def run(self, spark: SparkSession) -> Result:
        check_parts(self.k)
        edges = self._timed("read_s", lambda: saved(text.read_graph(spark, self.path, self.fmt, self.symmetrize, self.parse)))
        if self.n_vertices is not None:
            check_range(edges, self.n_vertices)
        isolated = self.n_vertices if self.include_isolated else None
        first = self._timed("assign_s", lambda: saved(assign.hash_assign(edges, self.k, isolated)))
        if self.before_refine is not None:
            self.before_refine(first)
        final = self._timed("refine_s", lambda: refine.refine(edges, first, self.k, self.mode, self.schedule, self.window, accept=self.accept, cursor=self.cursor))
        if self.after_refine is not None:
            self.after_refine(final)
        if self.output is not None:
            began = time.perf_counter()
            sinks.write_parts(final, self.output)
            self.timings["write_s"] = time.perf_counter() - began
        visited = None
        if self.on_vertices is not None:
            records = metrics.adjacency(edges).join(final.withColumnRenamed("v", "rank"), "rank")
            visited = records.select("rank", "nbrs", "part").mapInPandas(*self.on_vertices)
        return Result(final, self._report(spark, edges, first, final), visited)

    def _report(self, spark: SparkSession, edges: DataFrame, first: DataFrame, final: DataFrame) -> DataFrame:
        """(name, value): the cut before and after, over all entries, and the run's figures."""
        before, after = (metrics.edge_cut(edges, a).first() for a in (first, final))
        stats = metrics.graph_stats(edges).first()
        n = self.n_vertices if self.n_vertices is not None else stats["max_id"] or 0
        values = {
            "n_entries": stats["n_entries"], "n_edges": stats["n_edges"], "combined_pairs": metrics.combined_pairs(edges).first()[0],
            "hub_degree": hub_degree(self.hub_degree, self.hub_floor), "n_hubs": metrics.hubs(edges, self.hub_degree, self.hub_floor).count(), "batch_size": batch_size(n, self.threads, self.k, self.batch),
            "cut_entries_before": before["cut_entries"], "edge_cut_before": before["edge_cut"], "cut_entries": after["cut_entries"], "edge_cut": after["edge_cut"], **self.timings,
        }
        return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double")
