"""Exact duplicates by a sort of the contents. DataFrame operations only.

Rows are dealt by sampled splitters over their normalised bytes: the first and last of them and the
length, so that a splitter stays short however long the texts are. Within a task an external sort by
the whole normalised text lays equal texts side by side, and a run ends where the next text differs in
any byte. Nothing is shuffled for that, as equal texts cannot have different ends or lengths.

A group of copies that weighs more than a thousandth of all bytes would land in one task. Such groups
are found first, by the weight of their ends and length, and their rows are dealt over many places by
doc_id; what the runs of one text found in each place is then added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters of either end of a text that the splitters look at; texts are compared whole.
_ENDS = 64
#: Groups above this share of all bytes, or this weight in small tables, are dealt over several places.
_SHARE, _LEAST = 1024, 1 << 15
#: What a row weighs besides its text.
_ROW = 64
_KEY = ["head", "bytes", "tail"]


def lowered(text: Column) -> Column:
    """A-Z as a-z, all other characters as they are; texts of one-byte characters take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def content_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Every document with the one of its equals that stays: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical once A-Z are lower-cased; `keep` says whether the smallest or
    the largest doc_id stays. text_sha256 is of the lower-cased text. Null texts are empty ones. Rows
    without a doc_id stay only where no equal row has one; of rows that repeat the doc_id that stays,
    one is kept. Texts are compared whole, however long. An empty table gives an empty result; other
    columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    largest = keep == "largest"
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", lowered(F.left("text", F.lit(_ENDS))).alias("head"), F.octet_length("text").cast("long").alias("bytes"), lowered(F.right("text", F.lit(_ENDS))).alias("tail")
    )
    key = F.xxhash64(*_KEY)
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)) + _ROW * F.count(F.lit(1))).first()[0]
    limit = max(_LEAST, -(-total // _SHARE))
    weights = rows.groupBy(key.alias("key")).agg((F.sum("bytes") + _ROW * F.count(F.lit(1))).alias("weight"))
    #: At most _SHARE keys, as each weighs more than that part of all bytes.
    heavy = checkpointed(weights.where(F.col("weight") > limit).select("key", F.least(F.ceil(F.col("weight") / (limit / 4)), F.lit(1 << 16)).cast("int").alias("places")))
    place = F.when(F.col("places").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("places"))).cast("int")
    dealt = rows.withColumn("key", key).join(F.broadcast(heavy), "key", "left").withColumn("place", place)
    spread = dealt.select("doc_id", "text", *_KEY, "place").repartitionByRange(*_KEY, "place")

    order = F.desc_nulls_last("doc_id") if largest else F.asc_nulls_last("doc_id")
    sorted_ = spread.select("doc_id", *_KEY, "place", lowered(F.col("text")).alias("norm")).sortWithinPartitions(*_KEY, "place", "norm", order)
    run = W.partitionBy(*_KEY, "place", "norm").orderBy(order)
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    runs = sorted_.select("doc_id", "bytes", "place", F.sha2("norm", 256).alias("text_sha256"), F.row_number().over(run).alias("nth"), F.first("doc_id").over(whole).alias("best"), F.count(F.lit(1)).over(whole).alias("n"))
    found = checkpointed(runs)

    out = ("doc_id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), (F.col("nth") == 1).alias("kept"), "text_sha256")
    plain = found.where("place < 0").select(*out)
    if heavy.isEmpty():
        return plain
    parts = found.where("place >= 0")
    best = F.max("best") if largest else F.min("best")
    sums = parts.where("nth = 1").groupBy("text_sha256", "bytes").agg(best.alias("all_best"), F.sum("n").alias("all_n"))
    sums = checkpointed(sums.withColumn("big", (F.col("bytes") + _ROW) * F.col("all_n") > limit).drop("bytes"))
    # Texts that are heavy themselves are at most _SHARE again; the other texts of heavy keys have few rows each.
    big, small = F.broadcast(sums.where("big").drop("big")), sums.where("not big").drop("big")
    joined = parts.join(big, "text_sha256").unionByName(parts.join(big, "text_sha256", "left_anti").join(small, "text_sha256"))
    return plain.union(joined.select("doc_id", F.col("all_best").alias("keep_id"), F.col("all_n").alias("group_size"), ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("all_best"))).alias("kept"), "text_sha256"))
