"""Entries of graph files as they arrive: the batch parsers over a text stream.

Both line formats parse line by line and so work unchanged on streams; METIS numbering needs whole
files and does not. Running degrees and cuts of a hash partition are plain streaming aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import check_parts
from ..sources.text import parse_adjlist, parse_edgelist


def stream_graph(spark: SparkSession, path: str, fmt: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of entries (src, dst) from the files that appear in a folder, each read once."""
    if fmt not in ("edgelist", "adjlist"):
        raise ValueError("only edgelist and adjlist files can be read as a stream")
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (parse_edgelist if fmt == "edgelist" else parse_adjlist)(reader.load(path))


def running_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("deg"))


def running_hash_cut(edges: DataFrame, k: int) -> DataFrame:
    """Cut entries of every part under v mod k, which needs no state of vertices."""
    check_parts(k)
    ps, pd = F.pmod("src", F.lit(k)), F.pmod("dst", F.lit(k))
    return edges.groupBy(ps.cast("int").alias("part")).agg(F.sum((ps != pd).cast("long")).alias("cut_entries"))
