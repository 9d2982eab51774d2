"""Graphs that are derived from the star-schema tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..operators.rank import saved
from ..sources.text import symmetrize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and the suppliers they came from: bipartite, simple, both ways."""
    shift = _table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("shift"))
    base = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().crossJoin(F.broadcast(shift))  # one row
    return symmetrize(base.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + F.col("shift")).alias("dst")))


def following(rows: DataFrame, value: str, within: str, *order: str) -> DataFrame:
    """(within, value, next): the value of the next row of the same `within`, null for the last.

    Rows are dealt by range, so that a frequent `within` is spread over tasks, and are read in order where
    they lie; the last row of a task is followed by the first of the next one, of which there is a row each.
    """
    is_of, is_value = (rows.schema[c].dataType for c in (within, value))
    schema = StructType([StructField("__of", is_of), StructField("__is", is_value), StructField("__next", is_value), StructField("__task", IntegerType()), StructField("__first", BooleanType()), StructField("__last", BooleanType())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch waits for the one after it."""
        task, held, first = TaskContext.get().partitionId(), None, True
        for b in chain((b for b in batches if b.num_rows), [None]):
            if held is not None:
                of, value = held.columns
                n, flags = len(of), np.zeros((2, len(of)), bool)
                flags[0, 0], flags[1, n - 1] = first, b is None
                then_of, then = (pa.concat_arrays([c[1:], pa.nulls(1, c.type) if b is None else b.columns[i][:1]]) for i, c in enumerate(held.columns))
                same = pc.or_(pc.fill_null(pc.equal(of, then_of), False), pc.and_(pc.is_null(of), pc.is_null(then_of)))
                yield pa.RecordBatch.from_arrays([of, value, pc.if_else(same, then, pa.scalar(None, then.type)), pa.array(np.full(n, task, np.int32)), *map(pa.array, flags)], names=schema.names)
                first = False
            held = b

    dealt = saved(rows.repartitionByRange(within, *order).sortWithinPartitions(within, *order).select(within, value).mapInArrow(joined, schema))
    firsts = dealt.where("__first").select("__task", F.struct(F.col("__of").alias("of"), F.col("__is").alias("is")).alias("first"))
    after = firsts.select("__task", F.lead("first").over(W.orderBy("__task")).alias("after"))  # a row for each task
    then = F.when(F.col("__last"), F.when(F.col("after.of").eqNullSafe(F.col("__of")), F.col("after.is"))).otherwise(F.col("__next"))
    return dealt.join(F.broadcast(after), "__task").select(F.col("__of").alias(within), F.col("__is").alias(value), then.alias("next"))


def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that follow each other within an event type: simple, both ways."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    pairs = following(events, "user_id", "event_type", "ts", "event_id").select(F.col("user_id").alias("u"), F.col("next").alias("v")).where("v is not null and u <> v")
    return symmetrize(pairs.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct())


def gm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to supplier of every line: directed, parallel entries kept."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types (0, 1, … by name) and their events: a few hubs, both ways."""
    events = _table(spark, sf_dir, "events").select("event_id", "event_type")
    kinds = events.select("event_type").distinct().withColumn("src", (F.row_number().over(W.orderBy("event_type")) - 1).cast("long"))
    return symmetrize(events.join(F.broadcast(kinds), "event_type").select("src", (F.col("event_id") + 5).alias("dst")))


#: The same graphs as DuckDB common table expressions.
G1_SQL = """o AS (SELECT max(p_partkey) + 1 AS shift FROM part),
b AS (SELECT DISTINCT l_partkey AS u, shift + l_suppkey AS v FROM lineitem, o),
g AS (SELECT u AS src, v AS dst FROM b UNION ALL SELECT v, u FROM b)"""
G2_SQL = """s AS (SELECT user_id AS u, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS v FROM events),
b AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM s WHERE v IS NOT NULL AND u <> v),
g AS (SELECT u AS src, v AS dst FROM b UNION ALL SELECT v, u FROM b)"""
GM_SQL = "g AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
G3_SQL = """t AS (SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS h FROM events),
g AS (SELECT CAST(h AS BIGINT) AS src, 5 + event_id AS dst FROM t UNION ALL SELECT 5 + event_id, CAST(h AS BIGINT) FROM t)"""
