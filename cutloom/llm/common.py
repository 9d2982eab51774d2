"""Helpers shared by the text operators: the shared folder, lineage cuts, small tables and Arrow output."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the text contracts count it.
SPACES = b" \t\n\x0b\x0c\r"


_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same 64-bit values, one for each seed."""
    x = h.view(np.uint64) + np.uint64((seed + 1) * _MIX[0] & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local master, where all share one machine, gets one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cutloom-checkpoint-"))
    return named or sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(name: str, df: DataFrame) -> str:
    """A column name for internal use that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that lost executors lose nothing of it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_frequent(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """`rows` joined with `table`, which has one row for each key and in column `n` the number of its rows.

    The keys of more than a thousandth of all rows, a thousand at most, are sent to all tasks, so that the
    rows of a frequent key stay where they are; only those of the others are shuffled.
    """
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    often = F.col(n) > max(total // 1000, 1000)
    few = F.broadcast(table.where(often).drop(n))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(table.where(~often).drop(n), key))


def looked_up(values: Iterable[int | None], index: Column) -> Column:
    """Element `index` (from 0) of a bounded driver-side list, as a constant that is folded in the JVM."""
    return F.get(F.from_json(F.lit(json.dumps(list(values))), "array<bigint>"), index)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_rows: int = 1024, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one slice holds at most `max_bytes` of `column`, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, min(int(np.searchsorted(ends, base + max_bytes, "right")), start + max_rows))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def arrow(columns: dict[str, Any], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, type=f.type) for x, f in zip((columns[f.name] for f in schema), schema, strict=True)], schema=schema)
