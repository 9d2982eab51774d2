"""A versioned store of keyed records: appended, latest wins, deletes are tombstones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row"))
    return newest.select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def without(log: DataFrame, deleted: DataFrame, key: str = "key") -> DataFrame:
    return log.join(deleted.select(key), key, "left_anti")


class RecordStore:
    """Records (key, value) in a folder; every write is one version, also a batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.option("recursiveFileLookup", "true").parquet(self.root)
        except AnalysisException:
            return None

    def _next(self) -> int:
        log = self._log()
        return 0 if log is None else (log.agg(F.max("version")).first()[0] or 0) + 1

    def put(self, records: DataFrame) -> int:
        """Appends records under one version, which is returned."""
        n = self._next()
        records.select("key", "value", F.lit(n).cast("long").alias("version"), F.lit(False).alias("gone")).write.parquet(f"{self.root}/v{n:019d}")
        return n

    def delete(self, keys: DataFrame) -> int:
        n, log = self._next(), self._log()
        if log is None:
            return n
        keys.select("key", F.lit(None).cast(log.schema["value"].dataType).alias("value"), F.lit(n).cast("long").alias("version"), F.lit(True).alias("gone")).write.parquet(f"{self.root}/v{n:019d}")
        return n

    def scan(self) -> DataFrame:
        """(key, value, version) of live records."""
        log = self._log()
        if log is None:
            return self.spark.createDataFrame([], "key long, value string, version long")
        return latest(log).where("not gone").select("key", "value", "version")

    def get(self, key: int) -> DataFrame:
        return self.scan().where(F.col("key") == key)

    def get_range(self, first: int, last: int) -> DataFrame:
        return self.scan().where(F.col("key").between(first, last))

    def stats(self) -> DataFrame:
        """What was written, by version: (version, n_records, n_deletes)."""
        log = self._log()
        if log is None:
            return self.spark.createDataFrame([], "version long, n_records long, n_deletes long")
        return log.groupBy("version").agg(F.count_if(~F.col("gone")).alias("n_records"), F.count_if("gone").alias("n_deletes"))
