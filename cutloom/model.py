"""Data model: schemas and argument checks.

A graph is a DataFrame of directed entries (src, dst); an undirected edge is two entries, and parallel
entries are kept. An assignment maps vertices to parts (v, part).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

EDGES = StructType([StructField("src", LongType()), StructField("dst", LongType())])
ADJACENCY = StructType([StructField("rank", LongType()), StructField("nbrs", ArrayType(LongType(), False))])
ASSIGNMENT = StructType([StructField("v", LongType()), StructField("part", IntegerType())])
FORMATS = ("edgelist", "adjlist", "metis")
#: The least degree of a hub, whatever is asked for.
HUB_FLOOR = 1000


def check_parts(k: int) -> int:
    """The number of parts: two or more."""
    if k < 2:
        raise ValueError(f"a partition needs two parts or more, not {k}")
    return k


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {fmt!r}")
    return fmt


def hub_degree(asked: int, floor: int = HUB_FLOOR) -> int:
    return max(asked, floor)


def batch_size(n_vertices: int, threads: int, k: int, asked: int = 0) -> int:
    """Keys that one buffer holds before it would be spilled: a formula for reports, Spark spills by bytes."""
    m, cells = asked or n_vertices, threads * k
    return m // cells + m % cells


def check_range(edges: DataFrame, n_vertices: int) -> DataFrame:
    """`edges`, after checking that all ids lie in 0..n_vertices."""
    low, high = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    if low is not None and (low < 0 or high > n_vertices):
        raise ValueError(f"vertex ids run from {low} to {high}, outside 0..{n_vertices}")
    return edges
