"""The corpus pipeline: documents go through five stages, each over all that the one before it kept.

1. quality: documents that the rule ensemble rejects go.
2. lines: lines that ten documents or more share go; a document of such lines only stays, with no text.
3. near_duplicates: of each group of near copies (Jaccard similarity of 0.8 or more over sets of
   five-word shingles, decided on the shingles) the document with the smallest doc_id stays.
4. contamination: documents that hold benchmark passages go.
5. packing: the rest is tokenised and packed into sequences.

Every stage but the last returns the columns of `documents`; what each does with nulls, repeated rows and
empty tables is stated with its function in `cutloom.llm.stages`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cutloom.llm.common import checkpoint_dir, read_table, remove
from cutloom.llm.stages import drop_contaminated, drop_shared_lines, keep_good, keep_one_of_each_group, pack

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("lines", drop_shared_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("contamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the fitted classifier nor the near-copy groups. These groups are tested against brute force (tests/llm/test_near_copies.py), the other stages through their operators' tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last one stays, as the result reads it.
    """
    docs = read_table(spark, sf_dir, "documents")
    root = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{root}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
