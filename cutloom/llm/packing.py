"""Best-fit packing of tokenised documents by sums of squares.

An online sum-of-squares packer keeps N(g), the number of open sequences with residual gap g, and puts
each piece where the sum of N(g)^2 becomes smallest (Csirik et al., 2006). Texts are tokenised once, as
they are read, and their pieces (lengths and checksums, no ids) are kept in the shared folder. There
every piece has a row number of its own, by which pieces are dealt into blocks of bounded size, so that
no key, however frequent, fills one. Inside a block the longest go first, and only lengths are looked
at, so one step costs a vector operation over the gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, checkpointed, slices
from .tokens import WordTokenizer

CAPACITY = 2048
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece. Pieces are taken longest first.

    A sequence is opened only where a piece fits into none, as few sequences are wanted. Among those that
    it fits into, moving one from gap g to g - s changes the sum of squares by 2 (N(g-s) - N(g)) + 2, and a
    gap of zero counts for nothing. Ties go to the smallest gap.
    """
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n_open = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in order:
        s = int(lengths[i])
        left = n_open[s:]
        there = np.flatnonzero(left)
        gap = capacity
        if len(there):
            # n_open[0] stays 0, so filling a sequence up costs least.
            costs = 2 * (n_open[there] - left[there]) + 2
            costs[there == 0] -= 1
            gap = int(there[np.argmin(costs)]) + s
        if gap < capacity:
            b = waiting[gap].pop()
            n_open[gap] -= 1
        else:
            b, made = made, made + 1
        sequence[i], offset[i] = b, capacity - gap
        if gap > s:
            n_open[gap - s] += 1
            waiting[gap - s].append(b)
    return sequence, offset


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenised documents as pieces: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(tokenizer_path)
        for part in slices(batches, "text", 4096, 8 << 20):
            ids, ends = tokenizer.encode(part.column("text"), end_id)
            sizes = np.diff(ends, prepend=0)
            n = -(-sizes // capacity)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(np.repeat(sizes, n) - start, capacity)
            raw, at = memoryview(ids.astype("<u4")).cast("B"), (np.repeat(ends - sizes, n) + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            doc = part.column("doc_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(part.num_rows), n)))
            yield arrow({"doc_id": doc, "piece": piece, "start": start, "length": length, "ids_crc32": crc}, _PIECES)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, pieces_per_block: int = 150_000) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    Every text is followed by `end_id`. A longer one is cut into pieces of `capacity` tokens, the last
    one shorter; no other is cut. Returns per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id and offset. Null texts are empty ones (one token); repeated rows are packed as often as
    they come; null doc_ids are kept; an empty table gives an empty result; other columns are ignored.
    A block leaves a few sequences partly empty, so blocks are as large as a task's memory allows.
    """
    cut = checkpointed(pieces(docs, tokenizer_path, end_id, capacity))
    n_blocks = max(1, round(cut.count() / pieces_per_block))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        sequence, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="block").assign(sequence_id=sequence * n_blocks + pdf["block"], offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("block").applyInPandas(fill, schema)
