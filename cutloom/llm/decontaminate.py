"""Benchmark decontamination with spaced seeds.

A seed is a hash of the tokens at the kept positions of a fixed mask; the positions that a mask ignores
may hold other tokens. Seeds of the benchmark and of the documents are joined by their hash, and every
hit is checked by laying the item along the document at the hit's shift: segments of matching tokens
that tolerate substitutions count, and together decide. While the benchmark's seeds stay under a
checked size they are joined by a sorted lookup where the documents are read; beyond it by a shuffle of
the seeds that a bit array of the benchmark lets through, in which frequent seeds are dealt over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, checkpointed, slices, unused

#: The kept (1) and ignored (0) token positions of the seeds, five kept in each.
MASKS = ("1101011", "11100101", "110010011", "1010001101")
_KEPT = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]
_SPAN = [len(m) for m in MASKS]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_CJK = "぀-ヿ㐀-鿿"
_TOKEN = re.compile(f"[{_CJK}]|[^\\W_{_CJK}]+")


@dataclass(frozen=True)
class Rule:
    """A document leaks an item if segments on any shifts cover `share` of its tokens, `least` at least, or `many`.

    A segment gains 1 for a matching token and loses `loss` for another, so that it keeps two matches
    of three; segments of fewer than `segment` matches do not count. Items shorter than `least` tokens are no evidence.
    """

    share: float = 0.5
    least: int = 8
    many: int = 20
    segment: int = 5
    loss: int = 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in a row, and where each text ends. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    coded = words.flatten().dictionary_encode()
    hashes: list[int] = []
    sizes = []
    for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
        found = _TOKEN.findall(w.lower())
        hashes += [xxhash.xxh3_64_intdigest(t) for t in found]
        sizes.append(len(found))
    table, n_of = np.array(hashes, np.uint64), np.array(sizes, np.int64)
    first = np.cumsum(n_of) - n_of
    at = np.asarray(coded.indices)
    n = n_of[at]
    upto = np.concatenate([[0], np.cumsum(n)])
    out = table[np.repeat(first[at] - upto[:-1], n) + np.arange(upto[-1])] if len(at) else np.zeros(0, np.uint64)
    ends = upto[np.cumsum(np.asarray(pc.list_value_length(words), np.int64))]
    return out, ends


def seeds(tok: np.ndarray, ends: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a mask at all positions where it fits into one text, and these positions."""
    span, n = _SPAN[mask], len(tok)
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = np.repeat(ends, np.diff(ends, prepend=0))[: n - span + 1]
    at = np.flatnonzero(np.arange(n - span + 1) + span <= stop)
    h = np.full(n - span + 1, (mask + 1) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k, p in enumerate(_KEPT[mask]):
        h += tok[p : n - span + 1 + p] * _ODD[k]
    h ^= h >> np.uint64(29)
    return h[at], at


class Benchmark:
    """The items' tokens and seeds, sorted by hash."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.tok, self.ends = tokens(pa.array(texts, pa.string()))
        self.starts = self.ends - np.diff(self.ends, prepend=0)
        found = [seeds(self.tok, self.ends, m) for m in range(len(MASKS))]
        h, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], at[order]
        #: A bit for each value of the hashes' low bits: most positions of a document end here.
        self.low = np.zeros(1 << 20, bool)
        self.low[self.hash & np.uint64((1 << 20) - 1)] = True

    def hits(self, tok: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, shift): all places where a seed of a text is one of an item, each once."""
        pos, item_pos = [], []
        for m in range(len(MASKS)):
            h, at = seeds(tok, ends, m)
            few = np.flatnonzero(self.low[h & np.uint64((1 << 20) - 1)])
            h, at = h[few], at[few]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            n = hi - lo
            pos.append(np.repeat(at, n))
            item_pos.append(self.at[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        pos, item_pos = np.concatenate(pos), np.concatenate(item_pos)
        text = np.searchsorted(ends, pos, "right")
        item = np.searchsorted(self.ends, item_pos, "right")
        starts = ends - np.diff(ends, prepend=0)
        return tuple(np.unique(np.stack([text, item, (pos - starts[text]) - (item_pos - self.starts[item])]), axis=1)) if len(pos) else (pos, pos, pos)


def segments(same: np.ndarray, loss: int) -> list[tuple[int, int]]:
    """Best-scoring runs of a row of matches, cut where the score falls to nothing or `4 * loss` under its best."""
    out, at, n = [], 0, len(same)
    value = np.where(same, 1, -loss).tolist()
    while at < n:
        if value[at] < 0:
            at += 1
            continue
        total = best = 0
        end = i = at
        while i < n:
            total += value[i]
            if total > best:
                best, end = total, i + 1
            if total <= 0 or total <= best - 4 * loss:
                break
            i += 1
        out.append((at, end))
        at = end
    return out


def covered(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray, rule: Rule) -> tuple[int, int]:
    """How many of an item's tokens the document holds in segments at the given shifts, and where the first begins."""
    have, first = np.zeros(len(item), bool), len(doc)
    for s in shifts.tolist():
        a, b = max(0, -s), min(len(item), len(doc) - s)
        if b <= a:
            continue
        same = item[a:b] == doc[a + s : b + s]
        if same.sum() < rule.segment:
            continue
        for x, y in segments(same, rule.loss):
            if same[x:y].sum() >= rule.segment:
                have[a + x : a + y] |= same[x:y]
                first = min(first, a + s + x)
    return int(have.sum()), first


def leaks_of(texts: pa.Array, bench: Benchmark, rule: Rule) -> list[list[dict]]:
    """For each text, the items it leaks."""
    out: list[list[dict]] = []
    for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", 4096, 4 << 20):
        tok, ends = tokens(part.column("text"))
        starts = ends - np.diff(ends, prepend=0)
        found: list[list[dict]] = [[] for _ in range(len(ends))]
        text, item, shift = bench.hits(tok, ends)
        if len(text):
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
            for a, b in zip(first, np.append(first[1:], len(text)), strict=True):
                t, q = int(text[a]), int(item[a])
                passage = bench.tok[bench.starts[q] : bench.ends[q]]
                n, begin = covered(tok[starts[t] : ends[t]], passage, shift[a:b], rule)
                if len(passage) >= rule.least and n >= min(rule.many, max(rule.least, rule.share * len(passage))):
                    found[t].append({"item_id": bench.ids[q], "first_token": begin, "matched": n, "item_tokens": len(passage)})
        out += found
    return out


_LEAKS = "array<struct<item_id:long,first_token:int,matched:int,item_tokens:int>>"
_LEAK_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("first_token", pa.int32()), ("matched", pa.int32()), ("item_tokens", pa.int32())]))


def mark_leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), broadcast_bytes: int = 4 << 20) -> DataFrame:  # noqa: B008
    """`docs` with `leaks`, the array of benchmark items that the text holds (item_id, first_token, matched, item_tokens).

    Texts are looked at whole, however long; words are known by 64-bit hashes. Null and empty texts leak nothing; null and empty items, and items of fewer than `rule.least`
    tokens, are never found; repeated rows are marked alike and repeated items reported each; empty
    tables are no error; a column of `docs` named leaks is replaced. `broadcast_bytes` bounds the text
    of a benchmark that is sent to the executors; a larger one is joined by a shuffle with the same result.
    """
    docs = docs.drop("leaks")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_text is not null")
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    if n_bytes <= broadcast_bytes:
        rows = sorted(items.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["item_text"]))
        bench = Benchmark([r["item_id"] for r in rows], [r["item_text"] for r in rows])
        shared = docs.sparkSession.sparkContext.broadcast(bench)
        udf = F.arrow_udf(lambda t: pa.array(leaks_of(t, shared.value, rule), _LEAK_TYPE), _LEAKS)
        return docs.withColumn("leaks", udf(F.col("text")))
    return _joined(docs, items, rule)


#: Bits of the array that tells which seeds a large benchmark may hold.
_FILTER_BITS = 1 << 24


def _seen(seeds_of_items: DataFrame) -> np.ndarray:
    """A bit for each value of the low bits of the benchmark's seeds, put together on the executors."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, heap = np.zeros(_FILTER_BITS, bool), None
        for b in batches:
            h = np.asarray(b.column("h")).view(np.uint64)
            if len(h):
                seen[h & np.uint64(_FILTER_BITS - 1)] = True
                heap = int(h[0] % np.uint64(32))
        if heap is not None:
            yield arrow({"heap": [heap], "bits": [np.packbits(seen).tobytes()]}, pa.schema([("heap", pa.int32()), ("bits", pa.binary())]))

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"heap": 0, "bits": np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]]).tobytes()}])

    kind = "heap int, bits binary"
    rows = seeds_of_items.select("h").mapInArrow(mark, kind).groupBy("heap").applyInPandas(both, kind).groupBy("heap").applyInPandas(both, kind).collect()
    return np.unpackbits(np.frombuffer(rows[0]["bits"], np.uint8)).view(bool) if rows else np.zeros(_FILTER_BITS, bool)


def _joined(docs: DataFrame, items: DataFrame, rule: Rule, seeds_per_task: int = 500_000) -> DataFrame:
    """`mark_leaks` by a shuffle. Documents and items are known by row numbers, so that copies are no hot key."""
    row = unused("row", docs)
    docs = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    items = checkpointed(items.withColumn("item", F.monotonically_increasing_id()))

    def spread(batches: Iterator[pa.RecordBatch], key: str, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("h", pa.int64()), (key, pa.int64()), (f"{key}_at", pa.int64())])
        for part in slices(batches, "text", 4096, 2 << 20):
            tok, ends = tokens(part.column("text"))
            starts = ends - np.diff(ends, prepend=0)
            ids = np.asarray(part.column(key))
            for m in range(len(MASKS)):
                h, at = seeds(tok, ends, m)
                if wanted is not None:
                    few = wanted[h & np.uint64(_FILTER_BITS - 1)]
                    h, at = h[few], at[few]
                text = np.searchsorted(ends, at, "right")
                yield arrow({"h": h.view(np.int64), key: ids[text], f"{key}_at": at - starts[text]}, out)

    right = checkpointed(items.select("item", F.col("item_text").alias("text")).mapInArrow(lambda b: spread(b, "item", None), "h long, item long, item_at long"))
    shared = docs.sparkSession.sparkContext.broadcast(_seen(right))
    texts = docs.select(F.col(row).alias("doc"), "text").where("text is not null")
    left = texts.mapInArrow(lambda b: spread(b, "doc", shared.value), "h long, doc long, doc_at long")
    # Seeds of very many places, of which there are 100,000 at most, are dealt over tasks.
    counts = checkpointed(left.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(right.select("h").distinct(), "h", "left_semi"))
    limit = max(seeds_per_task, (counts.agg(F.sum("n")).first()[0] or 0) // 100_000)
    heavy = F.broadcast(counts.where(F.col("n") > limit).select("h", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(heavy, "h", "left").select("h", "doc", "doc_at", F.pmod(F.xxhash64("doc", "doc_at"), parts).cast("int").alias("salt"))
    right = right.join(heavy, "h", "left").select("h", "item", "item_at", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    shifts = left.join(right, ["h", "salt"]).select("doc", "item", (F.col("doc_at") - F.col("item_at")).alias("shift"))
    pairs = checkpointed(shifts.groupBy("doc", "item").agg(F.collect_set("shift").alias("shifts")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("first_token", pa.int32()), ("matched", pa.int32()), ("item_tokens", pa.int32())])
        for part in slices(batches, "text", 512, 4 << 20):
            tok, ends = tokens(part.column("text"))
            item, item_ends = tokens(part.column("item_text"))
            rows = []
            for i, at in enumerate(part.column("shifts").to_pylist()):
                doc, q = (x[(e[i - 1] if i else 0) : e[i]] for x, e in ((tok, ends), (item, item_ends)))
                n, begin = covered(doc, q, np.array(at), rule)
                if len(q) >= rule.least and n >= min(rule.many, max(rule.least, rule.share * len(q))):
                    rows.append((part.column("doc")[i].as_py(), part.column("item")[i].as_py(), begin, n, len(q)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield arrow(dict(zip(out.names, columns, strict=True)), out)

    # An item that very many documents share is sent to 64 tasks.
    salt = F.pmod(F.xxhash64("doc"), F.lit(64)).cast("int")
    passages = items.select("item", "item_text", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt"))
    full = pairs.withColumn("salt", salt).join(passages, ["item", "salt"]).join(texts, "doc")
    found = full.select("doc", "item", "shifts", "text", "item_text").mapInArrow(verify, "doc long, item long, first_token int, matched int, item_tokens int")
    named = found.withColumn("salt", salt).join(items.select("item", "item_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt")), ["item", "salt"])
    leaks = named.groupBy(F.col("doc").alias(row)).agg(F.sort_array(F.collect_list(F.struct("item_id", "first_token", "matched", "item_tokens"))).alias("leaks"))
    return docs.join(leaks, row, "left").drop(row).withColumn("leaks", F.coalesce("leaks", F.array().cast(_LEAKS)))


def leaked(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), broadcast_bytes: int = 4 << 20) -> DataFrame:  # noqa: B008
    """A row for each document and item that it leaks: doc_id, item_id, first_token, matched, item_tokens."""
    return mark_leaks(docs.select("doc_id", "text"), benchmark, rule, broadcast_bytes).select("doc_id", F.inline("leaks"))
