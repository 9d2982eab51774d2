"""Writing parts, METIS lines, relabelled graphs, boundaries and reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import write_manifest


def part_lines(assignment: DataFrame) -> DataFrame:
    """(part, v, line) with `v<TAB>part` for each assigned vertex."""
    return assignment.where("part is not null and part >= 0").select("part", "v", F.concat_ws("\t", F.col("v").cast("string"), F.col("part").cast("string")).alias("line"))


def write_parts(assignment: DataFrame, path: str) -> None:
    """A folder part=<p> for each part, its lines ascending by vertex in its files and, by their names, over them. Tasks write ranges of (part, v)."""
    rows = part_lines(assignment)
    rows.repartitionByRange("part", "v").sortWithinPartitions("part", "v").select("part", F.col("line").alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def metis_lines(edges: DataFrame, n_vertices: int | None = None, ordered: bool = True) -> DataFrame:
    """(v, line): v 0 is the header `#sources entries/2`; each vertex to n_vertices has a line, an empty one without neighbours.

    `n_vertices` defaults to the largest id. Neighbours are ascending. Sources that are missing keep their
    line, so that a line's number stays its vertex.
    """
    spark = edges.sparkSession
    adjacency = edges.groupBy("src").agg(F.concat(F.lit(" "), F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string")), "  "), F.lit(" ")).alias("line"))
    stats = edges.agg(F.countDistinct("src").alias("n"), F.count(F.lit(1)).alias("m"), F.coalesce(F.max(F.greatest("src", "dst")), F.lit(0)).alias("top"))
    header = stats.select(F.lit(0).cast("long").alias("v"), F.concat_ws(" ", F.concat(F.lit("#"), F.col("n").cast("string")), F.expr("m div 2").cast("string")).alias("line"))
    last = edges.agg(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(0))).first()[0] if n_vertices is None else n_vertices
    body = spark.range(1, last + 1).select(F.col("id").alias("v")).join(adjacency, F.col("v") == F.col("src"), "left").select("v", F.coalesce("line", F.lit("")).alias("line"))
    out = header.unionAll(body)
    return out.orderBy("v") if ordered else out


def neighbour_filter(edges: DataFrame) -> DataFrame:
    """Entries whose neighbour is not above the number of sources."""
    n = edges.agg(F.countDistinct("src").alias("n"))
    return edges.crossJoin(F.broadcast(n)).where("dst <= n").select("src", "dst")  # one row


def write_lines(rows: DataFrame, path: str, column: str = "line") -> None:
    """One text file per partition; for lines that need no order over files."""
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_ordered(rows: DataFrame, path: str, *by: str, column: str = "line", files: int | None = None) -> None:
    """Lines whose order counts: tasks write ranges of `by`, one file each, and a manifest keeps the order of the files and their lengths."""
    dealt = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    write_lines(dealt.sortWithinPartitions(*by), path, column)
    write_manifest(rows.sparkSession, path)


def write_metis(edges: DataFrame, path: str, n_vertices: int | None = None, files: int | None = None) -> None:
    """The METIS lines of a graph as a folder of ordered files."""
    write_ordered(metis_lines(edges, n_vertices, ordered=False), path, "v", files=files)


def part_list(assignment: DataFrame, n_vertices: int) -> DataFrame:
    """(v, line): the part of each vertex from 1 to n_vertices, -1 without one."""
    ids = assignment.sparkSession.range(1, n_vertices + 1).select(F.col("id").alias("v"))
    return ids.join(assignment, "v", "left").select("v", F.coalesce("part", F.lit(-1)).cast("string").alias("line"))


def write_part_list(assignment: DataFrame, path: str, n_vertices: int, files: int | None = None) -> None:
    """A line with the part of each vertex, in order, as a folder of ordered files."""
    write_ordered(part_list(assignment, n_vertices), path, "v", files=files)


def write_edges(edges: DataFrame, path: str) -> None:
    """`src dst` lines, sorted by both, each pair once."""
    write_lines(edges.distinct().orderBy("src", "dst").select(F.concat_ws(" ", "src", "dst").alias("line")), path)


def write_bounds(bounds: DataFrame, path: str) -> None:
    write_lines(bounds.orderBy("part").coalesce(1), path, "upper")


def file_list_name(gib: int) -> str:
    return f"input_{gib}gb.list"


def write_file_list(files: DataFrame, path: str) -> None:
    write_lines(files.orderBy("file"), path, "file")
