"""Token counts as delta-maintained rollups.

A batch of inserts, deletes and revised counts is turned into signed entries (a revision retracts the
document's present count and adds the new one), which are added up by source, language and tokenizer
version. A batch is committed by a marker that is written last, under its own name: replaying a
committed batch changes nothing, and what a broken commit left behind is overwritten by the next try.
Totals add up the deltas of committed batches; entries are only joined to the documents that change.
`compact` replaces many committed batches by one of net entries, so that the history does not grow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, slices
from .tokens import WordTokenizer

KEYS = ("source", "lang", "version")
_ENTRIES = "doc_id long, source string, lang string, version string, d_docs long, d_tokens long, batch string"
_DELTAS = "source string, lang string, version string, d_docs long, d_tokens long, batch string"


def _check(batch: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", batch):
        raise ValueError("a batch's name must be letters, digits, dots, lines or underscores")


class TokenRollup:
    """Rollups in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _markers(self) -> dict[str, list[str]]:
        """Every committed batch with the batches that it replaces (one row each, so a short list)."""
        try:
            return {r["batch"]: r["covers"] for r in self.spark.read.schema("batch string, covers array<string>").parquet(f"{self.root}/commits/*").collect()}
        except AnalysisException:
            return {}

    def committed(self) -> list[str]:
        """Names of all committed batches."""
        return sorted(self._markers())

    def _read(self, kind: str, schema: str) -> DataFrame:
        markers = self._markers()
        live = sorted(set(markers) - {b for covers in markers.values() for b in covers})
        paths = [f"{self.root}/{kind}/{b}" for b in live]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _present(self, entries: DataFrame) -> DataFrame:
        """What signed entries add up to, by document and keys."""
        return entries.groupBy("doc_id", *KEYS).agg(F.sum("d_docs").alias("n"), F.sum("d_tokens").alias("t")).where("n <> 0 or t <> 0")

    def _write(self, batch: str, entries: DataFrame, covers: list[str]) -> None:
        """Entries, their deltas and, when both are there, the marker that makes them count."""
        entries.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.root}/entries/{batch}")
        written = self.spark.read.schema(_ENTRIES).parquet(f"{self.root}/entries/{batch}")
        deltas = written.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).withColumn("batch", F.lit(batch))
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/{batch}")
        marker = self.spark.range(1, numPartitions=1).select(F.lit(batch).alias("batch"), F.array(*map(F.lit, covers)).cast("array<string>").alias("covers"))
        marker.write.mode("overwrite").parquet(f"{self.root}/commits/{batch}")

    def compact(self, batch: str) -> bool:
        """Replaces all committed batches by `batch`, which holds their net entries; names stay taken. False if it was committed before."""
        _check(batch)
        markers = self._markers()
        if batch in markers:
            return False
        present = self._present(self._read("entries", _ENTRIES)).withColumnsRenamed({"n": "d_docs", "t": "d_tokens"})
        self._write(batch, present, sorted(markers))
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if it was committed before.

        `changes` has op (insert, revise or delete), doc_id, source, lang, version and tokens. An insert
        of a known document and a revision of an unknown one both set its count; a delete of an unknown
        one does nothing. If a batch names a document more than once, a delete wins, then the largest
        count, then the last key. Null doc_ids are ignored; null tokens count as 0; null keys are a
        group of their own; an empty batch is committed and changes nothing; other columns are ignored.
        `changes` is computed once.
        """
        _check(batch)
        if batch in self.committed():
            return False
        asked = changes.where(F.col("doc_id").isNotNull() & F.col("op").isin("insert", "revise", "delete")).select(
            F.col("doc_id").cast("long").alias("doc_id"), F.struct((F.col("op") == "delete").alias("gone"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), *[F.col(k).cast("string").alias(k) for k in KEYS]).alias("c")
        )
        last = checkpointed(asked.groupBy("doc_id").agg(F.max("c").alias("c")).select("doc_id", "c.*"))
        # Only entries of documents that change are shuffled.
        present = self._present(self._read("entries", _ENTRIES).join(last.select("doc_id"), "doc_id", "left_semi"))
        back = present.select("doc_id", *KEYS, (-F.col("n")).alias("d_docs"), (-F.col("t")).alias("d_tokens"))
        new = last.where("not gone").select("doc_id", *KEYS, F.lit(1).cast("long").alias("d_docs"), F.col("tokens").alias("d_tokens"))
        self._write(batch, back.union(new), [])
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of all committed batches, without empty groups."""
        sums = self._read("deltas", _DELTAS).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def word_counts(docs: DataFrame, version: str = "words-1") -> DataFrame:
    """Every document with its number of runs of characters other than white space (ASCII) as an insert. Whole texts are counted, however long; null and empty ones have none. Repeated rows are as many inserts, of which a commit counts one; an empty table gives none."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", F.lit(version).alias("version"), n.cast("long").alias("tokens"))


def tokenizer_counts(docs: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """Every document with its number of tokenizer ids as a revision. Whole texts are counted, however long; null and empty ones have none. Repeated rows are as many revisions, of which a commit counts one; an empty table gives none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(tokenizer_path)
        for part in slices(batches, "text", 4096, 8 << 20):
            n = pa.array(tokenizer.counts(part.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("lang"), n], names=["doc_id", "source", "lang", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(count, "doc_id long, source string, lang string, tokens long").select(F.lit("revise").alias("op"), "doc_id", "source", "lang", F.lit(version).alias("version"), "tokens")
