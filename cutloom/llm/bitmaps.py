"""A clustered layout over several dimensions with a bitmap index of its files.

Every dimension is cut into `bins` coordinates of nearly equal numbers of rows, rows are ordered by the
interleaved binary digits of their coordinates and cut into files. The index has, for each dimension and
coordinate, a bitset of the files whose bounds cover it. A query is a box around a cell: bitsets are
joined by OR within its reach and by AND across the dimensions, and the bits left are counted. A second
set of bitmaps, of the files that hold a row of each cell, gives the files with rows inside the box.

Bitsets are cut into words of 64 neighbouring files, so that an index of any length is spread over tasks.
What all tasks see is a table of one row for each cell of the grid, whose number is fixed by the
dimensions and bins, and a boundary for each dimension and coordinate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rank import ranked
from .common import arrow, checkpointed

#: Files whose bits share a word.
WORD = 64
#: Cells that the grid may have; a table of that many rows is sent to all tasks.
_CELLS = 1 << 20


def boundaries(rows: DataFrame, dims: Sequence[str], bins: int) -> list[list[tuple[int, str | int]]]:
    """For each dimension the coordinates from 1 that are in use, with the least value of each.

    A value's coordinate is floor(bins * s / n), of n rows s with a smaller value; null is the smallest.
    Distinct values are dealt by range and added up task by task, so no task sees all of them.
    """
    kinds = dict(rows.dtypes)
    text = {d: kinds[d] == "string" for d in dims}
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), (F.lit(None) if text[d] else F.col(d)).cast("long").alias("v"), (F.col(d) if text[d] else F.lit(None)).cast("string").alias("s")) for i, d in enumerate(dims)]))
    counts = rows.select(values.alias("x")).groupBy("x.dim", "x.v", "x.s").agg(F.count(F.lit(1)).alias("n"))
    dealt = checkpointed(counts.repartitionByRange("dim", "v", "s").sortWithinPartitions("dim", "v", "s").withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("task", F.shiftright("at", 33))
    sums = dealt.groupBy("task").agg(F.sum("n").alias("all"))
    before = sums.select("task", (F.sum("all").over(W.orderBy("task")) - F.col("all")).alias("before"))  # a row for each task
    total = dealt.where("dim = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    upto = F.sum("n").over(W.partitionBy("task").orderBy("at"))
    placed = dealt.withColumn("upto", upto).join(F.broadcast(before), "task").withColumn("c", F.expr(f"(before + upto - n - dim * {total}L) * {bins} div {max(total, 1)}L"))
    least = placed.where("c > 0").groupBy("dim", "c").agg(F.min(F.struct("v", "s")).alias("least")).collect()  # dims times bins rows at most
    out: list[list[tuple[int, str | int]]] = [[] for _ in dims]
    for r in sorted(least, key=lambda r: (r["dim"], r["c"])):
        out[r["dim"]].append((r["c"], r["least"]["s"] if text[dims[r["dim"]]] else r["least"]["v"]))
    return out


def coordinate(value: Column, bounds: list[tuple[int, str | int]]) -> Column:
    """The coordinate of a value under `boundaries`; null and what is below them all have 0."""
    out = F.lit(0)
    for c, least in bounds:
        out = F.when(value >= F.lit(least), F.lit(c)).otherwise(out)
    return out


def interleaved(coordinates: Sequence[Column | np.ndarray], bits: int):  # noqa: ANN201
    """The binary digits of all coordinates, highest first, in each round one of every dimension: a Column or an array."""
    shift = (lambda x, n: x >> n) if isinstance(coordinates[0], np.ndarray) else F.shiftright
    terms = [(shift(c, b) % 2) * (1 << (b * len(coordinates) + len(coordinates) - 1 - i)) for b in range(bits) for i, c in enumerate(coordinates)]
    return reduce(lambda a, b: a + b, terms)


def clustered(rows: DataFrame, dims: Sequence[str], bins: int = 16, file_rows: int = 1000, key: str = "doc_id") -> DataFrame:
    """`rows` in their layout: key, c0, c1, … (coordinates), z, position, file, and lo0, hi0, … (bounds of the file).

    Positions go by z, then key; rows equal in both are interchangeable. A file is `file_rows` rows.
    """
    bits = max(1, (bins - 1).bit_length())
    if bins ** len(dims) > _CELLS:
        raise ValueError(f"{bins} bins of {len(dims)} dimensions are more than {_CELLS} cells")
    rows = rows.select(F.col(key).alias("__key"), *[F.col(d).alias(f"__d{i}") for i, d in enumerate(dims)])
    names = [f"__d{i}" for i in range(len(dims))]
    bounds = boundaries(rows, names, bins)
    cs = [f"c{i}" for i in range(len(dims))]
    placed = rows.select("__key", *[coordinate(F.col(d), b).cast("int").alias(c) for d, b, c in zip(names, bounds, cs, strict=True)])
    placed = placed.withColumn("z", interleaved([F.col(c) for c in cs], bits).cast("long"))
    placed = ranked(placed, "z", "__key", name="position").withColumn("file", F.expr(f"position div {file_rows}"))
    mine = W.partitionBy("file")
    return checkpointed(placed.select(F.col("__key").alias(key), *cs, "z", "position", "file", *[f(c).over(mine).alias(f"{n}{i}") for i, c in enumerate(cs) for n, f in (("lo", F.min), ("hi", F.max))]))


def _bit(file: str = "file") -> Column:
    return F.expr(f"shiftleft(1L, cast({file} % {WORD} as int))")


def cover_bitmaps(layout: DataFrame, n_dims: int, bins: int, file_rows: int) -> DataFrame:
    """(word, d0, d1, …): for each word of 64 files and each dimension, a bitset by coordinate of the files whose bounds cover it."""
    files = layout.where(F.col("position") % file_rows == 0).withColumn("bit", _bit())
    covers = lambda i, c: F.coalesce(F.bit_or(F.when(F.lit(c).between(F.col(f"lo{i}"), F.col(f"hi{i}")), F.col("bit"))), F.lit(0).cast("long"))
    return files.groupBy(F.expr(f"file div {WORD}").alias("word")).agg(*[F.array(*[covers(i, c) for c in range(bins)]).alias(f"d{i}") for i in range(n_dims)])


def cell_bitmaps(layout: DataFrame, n_dims: int) -> DataFrame:
    """(word, c0, c1, …, files): for each cell and word of 64 files a bitset of the files with a row in the cell.

    A cell's rows are neighbours in the layout, so there are little more rows than cells and words.
    """
    return layout.groupBy(F.expr(f"file div {WORD}").alias("word"), *[f"c{i}" for i in range(n_dims)]).agg(F.bit_or(_bit()).alias("files"))


def files_touched(covers: DataFrame, reach: Sequence[int], bins: int) -> DataFrame:
    """(z, files_touched) of the box around every cell that any file's bounds meet."""
    n, bits = len(reach), max(1, (bins - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bins,) * n, np.int64)
        for batch in batches:
            near = []
            for i, r in enumerate(reach):
                own = np.array(batch.column(f"d{i}").to_pylist(), np.int64).reshape(-1, bins).view(np.uint64)
                wide = own.copy()
                for step in range(1, min(r, bins - 1) + 1):
                    wide[:, step:] |= own[:, :-step]
                    wide[:, :-step] |= own[:, step:]
                near.append(wide)
            for row in range(batch.num_rows):
                # Coordinates that no file covers cannot be in any box.
                used = [np.flatnonzero(x[row]) for x in near]
                boxes = reduce(np.bitwise_and, np.ix_(*[x[row][u] for x, u in zip(near, used, strict=True)]))
                total[np.ix_(*used)] += np.bitwise_count(boxes)
        cells = np.nonzero(total)
        if len(cells[0]):
            yield arrow({"z": interleaved([c.astype(np.int64) for c in cells], bits), "files_touched": total[cells]}, pa.schema([("z", pa.int64()), ("files_touched", pa.int64())]))

    return covers.mapInArrow(count, "z long, files_touched long").groupBy("z").agg(F.sum("files_touched").alias("files_touched"))


def files_matching(cells: DataFrame, reach: Sequence[int], bins: int) -> DataFrame:
    """(z, files_matching) of the box around every cell that has any row inside."""
    n, bits = len(reach), max(1, (bins - 1).bit_length())
    steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in product(*[range(-r, r + 1) for r in reach])])
    moved = cells.select("word", "files", F.explode(steps).alias("step"), *[f"c{i}" for i in range(n)])
    moved = moved.select("word", "files", *[(F.col(f"c{i}") + F.col("step")[i]).alias(f"c{i}") for i in range(n)]).where(reduce(lambda a, b: a & b, [F.col(f"c{i}").between(0, bins - 1) for i in range(n)]))
    boxes = moved.withColumn("z", interleaved([F.col(f"c{i}") for i in range(n)], bits).cast("long")).groupBy("z", "word").agg(F.bit_or("files").alias("files"))
    return boxes.groupBy("z").agg(F.sum(F.bit_count("files").cast("long")).alias("files_matching"))


def bitmap_layout(rows: DataFrame, dims: Sequence[str], reach: Sequence[int], bins: int = 16, file_rows: int = 1000, key: str = "doc_id") -> DataFrame:
    """Every row in the layout of `clustered`, with the files that the box around its cell touches and matches.

    `dims` are columns of strings, compared by their UTF-8 bytes, or integers; `reach` says for each how
    far the box goes to either side. Returns key, z, position, file, files_touched (files whose bounds
    meet the box, the row's own included), files_matching (those that hold a row inside) and file_bounds
    (the least and largest coordinate of each dimension in the row's file, joined by commas).

    Null values are the smallest and null keys come first; repeated rows have a place each; an empty
    table gives an empty result; texts are not looked at but through `dims`; other columns are ignored.
    """
    n, bits = len(dims), max(1, (bins - 1).bit_length())
    layout = clustered(rows, dims, bins, file_rows, key)
    touched = files_touched(cover_bitmaps(layout, n, bins, file_rows), reach, bins)
    matching = files_matching(cell_bitmaps(layout, n), reach, bins)
    # One row for every cell of the grid, whatever the input.
    grid = rows.sparkSession.range(1 << (bits * n)).select(F.col("id").alias("z"))
    answers = grid.join(touched, "z", "left").join(matching, "z", "left").select("z", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files_touched", "files_matching")])
    bounds = F.concat_ws(",", *[F.col(f"{x}{i}").cast("string") for i in range(n) for x in ("lo", "hi")])
    return layout.join(F.broadcast(answers), "z").select(key, "z", "position", "file", "files_touched", "files_matching", bounds.alias("file_bounds"))
