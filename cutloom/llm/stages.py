"""The stages of the corpus pipeline. All but the last return the columns of `documents`; other columns go.

Every stage takes null and empty texts as texts without words, looks at very long ones whole, and
gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, linededup, packing, quality, simhash
from .common import read_table
from .queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on `labels`, accepts. Repeated rows and equal texts share their fate; a null doc_id does not matter."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten of them or more hold, n_chars counted anew.

    A document of nothing else stays with an empty text, a null text becomes an empty one; repeated rows
    are documents of their own and so count towards the ten.
    """
    return linededup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id.

    Of repeated rows with one doc_id and text one stays; of a doc_id with several texts only those that
    are copies go; rows without a doc_id have no name for a group to keep and all stay. Texts without
    words, null ones among them, are copies of equal texts only.
    """
    return simhash.keep_representatives(docs.select(*COLUMNS), simhash.similar_documents(docs, words=5, similarity=0.8))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of `benchmark`. Repeated rows and equal texts share their fate; an empty benchmark takes nothing."""
    return decontaminate.mark_leaks(docs, read_table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents with their places in sequences, as `packing.pack` gives them. Null texts are one token; repeated rows are packed each."""
    return packing.pack(docs, TOKENIZER)
