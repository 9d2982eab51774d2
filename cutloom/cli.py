"""Command line: partition a graph folder, or convert and relabel graph files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import FORMATS
from .operators import assign, metrics, relabel
from .plans.job import PartitionJob
from .sources import sinks, text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cutloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("partition", help="graph folder to parts")
    a.add_argument("path")
    a.add_argument("format", choices=FORMATS)
    a.add_argument("parts", type=int)
    a.add_argument("output")
    a.add_argument("--vertices", type=int)
    a.add_argument("--hub-degree", type=int, default=0)
    a.add_argument("--mode", choices=("none", "static", "dynamic"), default="static")
    a.add_argument("--schedule", choices=("sequence", "rounds"), default="rounds")
    a.add_argument("--window", type=int)
    a.add_argument("--cursor", action="store_true")
    a.add_argument("--accept", choices=("always", "improve"), default="always")
    a.add_argument("--symmetrize", action="store_true")
    a = sub.add_parser("to-metis", help="edge list to METIS lines")
    a.add_argument("path")
    a.add_argument("output")
    a.add_argument("--drop-beyond-sources", action="store_true")
    a = sub.add_parser("count", help="vertices of a graph")
    a.add_argument("path")
    a.add_argument("format", choices=FORMATS)
    a = sub.add_parser("relabel", help="contiguous ids by part")
    a.add_argument("path")
    a.add_argument("format", choices=FORMATS)
    a.add_argument("parts_path")
    a.add_argument("output")
    a.add_argument("--base", type=int, default=1)
    a.add_argument("--parts-format", choices=text.PART_FORMATS, default="pairs")
    return p


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("cutloom").getOrCreate()
    if a.command == "partition":
        job = PartitionJob(a.path, a.format, a.parts, a.vertices, a.hub_degree, mode=a.mode, schedule=a.schedule, window=a.window, cursor=a.cursor, accept=a.accept, output=a.output, symmetrize=a.symmetrize)
        job.run(spark).metrics.show(50, False)
    elif a.command == "to-metis":
        edges = text.read_graph(spark, a.path, "edgelist")
        sinks.write_metis(sinks.neighbour_filter(edges) if a.drop_beyond_sources else edges, a.output)
    elif a.command == "count":
        edges = text.read_graph(spark, a.path, a.format)
        metrics.vertex_count(edges, sources_only=a.format == "edgelist").show()
    else:
        edges, parts = text.read_graph(spark, a.path, a.format), text.read_parts(spark, a.parts_path, a.parts_format)
        mapping = relabel.relabel_map(parts, a.base)
        sinks.write_edges(relabel.relabel_edges(edges, mapping), f"{a.output}/edges")
        sinks.write_bounds(relabel.part_boundaries(parts, a.base), f"{a.output}/boundaries")
        sinks.write_lines(relabel.source_id(mapping).select(F.coalesce(F.col("new_id").cast("string"), F.lit("")).alias("line")), f"{a.output}/source")


if __name__ == "__main__":
    main()
