"""Line dedup with a sharded minimal perfect hash.

Pass 1 counts, for every distinct line key, the documents that hold it; only hashes are shuffled, and
each task adds up its own counts first. Lines of one document only can never be repeated lines and get
no slot. Each shard of the other hashes becomes a minimal perfect hash (levels of bit arrays; a key
settles in the first level where it collides with no other) whose slots index two compact arrays, of
fingerprints and of counts. Pass 2 probes the arrays from the documents: out of a broadcast while all
arrays together stay under a checked size, and shard by shard beyond it. There documents get row numbers,
lines travel to the shard of their key and only the numbers of dropped lines come back. Keys of so many
lines that they would fill a shard, of which there are few, are probed where the documents are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow, checkpointed, mixed, slices, unused, utf8

GAMMA = 2.0
ARRAYS = "shard int, n long, levels binary, sizes array<long>, prints binary, counts binary, extra binary"


def line_keys(text: bytes) -> list[bytes]:
    """Keys of the lines of a text: stripped of ASCII white space, A-Z lower-cased."""
    return [line.strip(SPACES) for line in text.lower().split(b"\n")]


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and an independent 64-bit fingerprint for each key."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<i8").reshape(-1, 2)
    return np.ascontiguousarray(raw[:, 0]), np.ascontiguousarray(raw[:, 1])


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes: a slot below n for every key, any slot or -1 for others."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        #: The number of set bits before each byte: the slot of a key is its rank among the set bits.
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        sizes, levels, rest = [], [], h
        while len(rest):
            m = max(64, int(GAMMA * len(rest)) + 7 & ~7)
            at = (mixed(rest, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def slots(self, h: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for seed, m in enumerate(self.sizes):
            if not len(left):
                break
            at = (mixed(h[left], seed) % np.uint64(m)).astype(np.int64) + base
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> bit) & 1 == 1
            b, k = byte[hit], bit[hit]
            below = np.bitwise_count(self.bits[b] & ((1 << k.astype(np.uint16)) - 1).astype(np.uint8))
            out[left[hit]] = self.ranks[b] + below
            left, base = left[~hit], base + m
        return out


class Shard:
    """The arrays of one shard. `extra` holds keys whose 64-bit hash is not unique in the shard."""

    def __init__(self, row: dict):
        self.mph = PerfectHash(list(row["sizes"]), np.frombuffer(row["levels"], np.uint8))
        self.prints = np.frombuffer(row["prints"], "<i8")
        self.counts = np.frombuffer(row["counts"], "<u4")
        self.extra = np.frombuffer(row["extra"], "<i8").reshape(-1, 3)

    def lookup(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The number of documents with each key, 0 where the fingerprint does not fit."""
        out = np.zeros(len(h), np.int64)
        if len(self.prints):
            slot = self.mph.slots(h)
            known = np.flatnonzero(slot >= 0)
            known = known[self.prints[slot[known]] == f[known]]
            out[known] = self.counts[slot[known]]
        for eh, ef, n in self.extra:
            out[(h == eh) & (f == ef)] = n
        return out


def _shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mixed(h, 997) % np.uint64(n)).astype(np.int64)


_COUNTED = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("n", pa.int64())])


def _count_batch(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 4096):
        keys: list[bytes] = []
        for text in utf8(part.column("text")):
            keys += {k for k in line_keys(text) if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars)}
        if keys:
            h, f = _hashes(keys)
            order = np.lexsort((f, h))
            h, f = h[order], f[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])]))
            yield arrow({"h": h[first], "f": f[first], "n": np.diff(np.append(first, len(h)))}, _COUNTED)


def _build(pdf: pd.DataFrame) -> dict:
    """The arrays of one shard out of its keys (h, f) and counts (n)."""
    pdf = pdf.sort_values(["h", "f"])
    h, f, n = pdf["h"].to_numpy(), pdf["f"].to_numpy(), np.minimum(pdf["n"].to_numpy(), 0xFFFFFFFF)
    first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    mph = PerfectHash.build(h[first])
    slot = mph.slots(h[first])
    prints, counts = np.zeros(len(slot), "<i8"), np.zeros(len(slot), "<u4")
    prints[slot], counts[slot] = f[first], n[first]
    extra = np.stack([h, f, n], axis=1)[~first].astype("<i8")
    return {"n": len(h), "levels": mph.bits.tobytes(), "sizes": mph.sizes, "prints": prints.tobytes(), "counts": counts.tobytes(), "extra": extra.tobytes()}


def counted_lines(docs: DataFrame, min_chars: int = 1, index_docs: int = 2) -> DataFrame:
    """The hashes of line keys that `index_docs` documents or more hold, and how many do: h, f, n."""
    counted = docs.select("text").mapInArrow(lambda b: _count_batch(b, min_chars), "h long, f long, n long").groupBy("h", "f").agg(F.sum("n").alias("n"))
    return checkpointed(counted.where(F.col("n") >= index_docs))


def line_index(counted: DataFrame, n_shards: int) -> DataFrame:
    """The arrays of all shards. One task builds one shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(np.asarray(b.column("h")), n_shards), pa.int32()), *b.columns], names=["shard", *b.schema.names])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), **_build(pdf)}])

    return checkpointed(counted.mapInArrow(deal, "shard int, h long, f long, n long").groupBy("shard").applyInPandas(build, ARRAYS))


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    return b"\n".join(line for line, g in zip(text.split(b"\n"), gone.tolist(), strict=True) if not g)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = 32 << 20, keys_per_shard: int = 200_000, lines_per_shard: int = 2_000_000, keep_text: bool = True) -> DataFrame:
    """Drops, in every document, each line whose key at least `min_docs` documents hold.

    A key is the line without ASCII white space at its ends, A-Z lower-cased; keys of fewer than
    `min_chars` code points never go. Returns the columns of `docs` with the kept lines as `text`
    (without it if `keep_text` is false), then n_lines (before), n_dropped and kept_sha256 (of the
    UTF-8 bytes). Null and empty texts are one empty line, which stays. Repeated rows are documents
    of their own; very long texts are looked at whole; an empty table gives an empty result. Columns of
    `docs` named like a new one are replaced, all others are kept. Keys are known by 64-bit hashes and
    64-bit fingerprints: another key is taken for a repeated one with a chance of 2**-64.

    `broadcast_bytes` bounds the arrays that are sent to the executors. Beyond it the documents are kept
    in the shared folder under row numbers; a shard has at most about `keys_per_shard` keys and
    `lines_per_shard` lines.
    """
    spark = docs.sparkSession
    fresh = ("n_lines", "n_dropped", "kept_sha256")
    docs = docs.drop(*fresh)
    names = [c for c in docs.columns if keep_text or c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    schema = ", ".join([*fields, "n_lines long", "n_dropped long", "kept_sha256 string"])
    counted = counted_lines(docs, min_chars, min(2, min_docs))
    n_keys = counted.count()
    n_shards = max(1, -(-n_keys // keys_per_shard))

    if n_keys * 16 <= broadcast_bytes:
        table = spark.sparkContext.broadcast([r.asDict() for r in line_index(counted, n_shards).collect()] if n_keys else [])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays = {r["shard"]: Shard(r) for r in table.value}
            for part in slices(batches, "text", 4096):
                texts = utf8(part.column("text"))
                lines = [line_keys(t) for t in texts]
                ends = np.cumsum([len(x) for x in lines])
                h, f = _hashes([k for x in lines for k in x])
                n, at = np.zeros(len(h), np.int64), _shard_of(h, n_shards)
                for s, a in arrays.items():
                    mine = np.flatnonzero(at == s)
                    n[mine] = a.lookup(h[mine], f[mine])
                yield _finish(part, texts, np.split(n >= min_docs, ends[:-1]), names)

        return docs.mapInArrow(probe, schema)

    row, gone_lines = unused("row", docs), unused("gone_lines", docs)
    docs = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    n_shards = max(n_shards, -(-n_lines // lines_per_shard))
    # At most 16 times the number of shards are this frequent, and at most as many as the bound has room for.
    often = max(lines_per_shard / 16, n_lines * 16 / max(1, broadcast_bytes))
    few = _build(counted.where(F.col("n") > often).toPandas())
    frequent = spark.sparkContext.broadcast(few)
    shards = line_index(counted, n_shards)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("line", pa.int32()), ("h", pa.int64()), ("f", pa.int64())])
        known = Shard(frequent.value)
        for part in slices(batches, "text", 4096):
            lines = [line_keys(t) for t in utf8(part.column("text"))]
            sizes = np.array([len(x) for x in lines])
            h, f = _hashes([k for x in lines for k in x])
            rare = known.lookup(h, f) == 0
            rows, line = np.repeat(np.asarray(part.column(row)), sizes), np.concatenate([np.arange(s) for s in sizes])
            yield arrow({"shard": _shard_of(h[rare], n_shards), "row": rows[rare], "line": line[rare], "h": h[rare], "f": f[rare]}, out)

    def look(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": pd.Series(dtype="int64"), "line": pd.Series(dtype="int32")})
        n = Shard(right.iloc[0].to_dict()).lookup(left["h"].to_numpy(), left["f"].to_numpy())
        return left.loc[n >= min_docs, ["row", "line"]]

    lines = docs.select("text", row).mapInArrow(explode, "shard int, row long, line int, h long, f long")
    found = lines.groupBy("shard").cogroup(shards.groupBy("shard")).applyInPandas(look, "row long, line int")
    gone = found.groupBy(F.col("row").alias(row)).agg(F.collect_list("line").alias(gone_lines))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shard(frequent.value)
        for part in slices(batches, "text", 4096):
            texts = utf8(part.column("text"))
            marks = []
            for t, g in zip(texts, part.column(gone_lines).to_pylist(), strict=True):
                m = known.lookup(*_hashes(line_keys(t))) >= min_docs
                m[g or []] = True
                marks.append(m)
            yield _finish(part, texts, marks, names)

    return docs.join(gone, row, "left").drop(row).mapInArrow(cut, schema)


def _finish(part: pa.RecordBatch, texts: list[bytes], gone: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    dropped = [int(g.sum()) for g in gone]
    kept = [_kept(t, g) if d else t for t, g, d in zip(texts, gone, dropped, strict=True)]
    columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == "text" else part.column(c) for c in names]
    columns += [pa.array([len(g) for g in gone], pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "n_lines", "n_dropped", "kept_sha256"])
