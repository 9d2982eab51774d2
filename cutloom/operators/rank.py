"""Ranks over all rows without one task that sorts them all, and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a bucket on average, where a shuffle has partitions enough.
_BUCKET = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Only a local master, where all share one machine, gets one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cutloom-graph-"))
    return named or sc.getCheckpointDir()


def table(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    root = f"{shared_folder(spark)}/cutloom-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{root}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table, by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """`df` computed once and kept in the shared folder, as a table.

    A checkpoint would cut the lineage as well, but keep the estimate of the plan's size. Joins multiply
    estimates, so in a loop their digits multiply with every step, until planning takes longer than the
    step. A table has the size of its files.
    """
    path = path or table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Bucketed:
    """A table in buckets of a column: its rows, their number of buckets, and what deletes it."""

    rows: DataFrame
    name: str
    path: str
    n: int

    def drop(self) -> None:
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.rows.sparkSession, self.path)


def buckets(rows: DataFrame) -> int:
    """How many buckets tables of these rows get that are read again in every step of a loop.

    A task reads a bucket, so a shuffle's number of partitions would make small tables many tasks in
    every step. There are as many as tasks can run at once, or so many times more that none has over
    `_BUCKET` rows, and no more than a shuffle has partitions.
    """
    spark = rows.sparkSession
    at_once = max(1, spark.sparkContext.defaultParallelism)
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), at_once * max(1, -(-rows.count() // (at_once * _BUCKET)))))


def bucketed(df: DataFrame, key: str, in_place: bool = False, n: int | None = None) -> Bucketed:
    """`df` kept in the shared folder in `n` buckets of `key`, or as many as a shuffle has partitions.

    Tables that are bucketed by the column that they are joined or grouped by are not shuffled for it.
    `in_place` says that the rows already lie so, as they come out of such a join.
    """
    spark, path = df.sparkSession, table(df.sparkSession)
    name = f"cutloom_{uuid.uuid4().hex}"
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if in_place else df.repartition(n, key)
    rows.write.bucketBy(n, key).format("parquet").option("path", path).saveAsTable(name)
    return Bucketed(spark.table(name), name, path, n)


def ranked(df: DataFrame, *by: str, name: str = "rank") -> DataFrame:
    """`df` with the place of each row, from 0, in the order of `by`.

    Rows are dealt by range and sorted in their task; a row's place is its place in the task plus the
    sizes of the tasks before, a table of one row per task.
    """
    dealt = saved(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()))
    dealt = dealt.withColumns({"__task": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = dealt.groupBy("__task").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__task", (F.sum("n").over(W.orderBy("__task")) - F.col("n")).alias("__before"))
    return dealt.join(F.broadcast(before), "__task").withColumn(name, F.col("__before") + F.col("__at")).drop("__id", "__task", "__at", "__before")
