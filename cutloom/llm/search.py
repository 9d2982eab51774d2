"""Exact BM25 top-k with an inverted index per shard and block-max WAND.

A shard is one row of compact arrays, built by the task that reads the texts and cut at a bound of
postings, so that neither a key nor a count of documents makes one large. Its documents are in order of
their own most frequent term and then of length, which brings those of one language and length together,
and grouped in blocks of `BLOCK`; the postings of a term lie block by block, and a directory holds, for
every term and block with postings, how many there are and the largest frequency. That and the shortest
length in the block bound the term's impact there, whatever the mean length turns out to be.
Global statistics (number of documents, mean length, document frequencies of the queries' terms) are
added up over all shards first, so that every shard scores alike and the shards' best merge exactly.

Lists of rare terms are read whole, as they have hardly fewer blocks than postings; frequent terms
have rows of impacts by document and of block maxima, built when they are first asked for. Queries go
together, those of one most frequent term side by side: what their rare lists add up to, with the block
maxima of all rows (one product of matrices), bounds every document from above. Only blocks in which some
query can reach its threshold are cut out of the rows and scored, by a second product. The few documents
that may be among the best are scored anew from their own postings, in an order that is the same in every
shard (block-max WAND, Ding and Suel, 2011, with document-aligned blocks and all cursors of a shard moved
together). Few queries that come alone read less and skip more each: longer lists whole, and the rows group
by group, after each of which the documents that cannot reach the threshold any more are dropped.

The threshold is what the k-th best score is at least. The first shards, one for each core, find it by
scoring the most promising documents; all others get the k-th best score that was found before, so that
most of their documents are ruled out by the bounds, and answer only what reaches it. Postings are decoded
as they are read, a list once for all queries that are sent together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow, checkpointed, slices
from .decontaminate import tokens

BLOCK = 8
#: Lists of at most this share of the documents are read whole; more frequent terms have rows by document, of at most so many values in all.
WHOLE, WHOLE_FEW, ROWS = 1 / 16, 1 / 8, 16_000_000
#: Queries that are bounded by one product, and postings that are held at once.
TOGETHER, STEP = 256, 1 << 18
#: Of fewer queries than these each looks for its own documents, by groups of the frequent terms; these are wasted on many, as what one leaves out another reads.
FEW, GROUPS = 64, 8
K1, B = 1.2, 0.75
#: Terms whose frequencies travel together.
_PART = 1 << 15
_QUERY = "query_id long, terms binary, counts binary, size long"
_ARRAYS = (("doc_ids", "<i8"), ("lengths", "<i4"), ("terms", "<u8"), ("dir_sizes", "<i4"), ("dir_block", "<i4"), ("dir_n", "u1"), ("dir_tf", "<u4"), ("low", "u1"), ("tf", "<u4"))
_INDEX = "place int, n_docs long, n_tokens long, " + ", ".join(f"{k} binary" for k, _ in _ARRAYS)
_SCHEMA = pa.schema([("place", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), *[(k, pa.binary()) for k, _ in _ARRAYS]])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the ranges in a row."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _index_shard(ids: np.ndarray, tok: np.ndarray, lengths: np.ndarray) -> dict:
    """The arrays of one shard out of its documents' tokens in a row."""
    n = max(1, len(ids))
    coded = pa.array(tok.astype(np.uint64, copy=False)).dictionary_encode()
    terms = coded.dictionary.to_numpy()
    by = np.argsort(terms)
    number = np.empty(len(terms), np.int64)
    terms, number[by] = terms[by], np.arange(len(terms)) * n
    key = number[coded.indices.to_numpy()]
    key += np.repeat(np.arange(len(ids)), lengths)
    key.sort()
    at = _starts(key)
    tf, (term, doc) = np.diff(np.append(at, len(key))), np.divmod(key[at], n)
    # Documents in order of their most frequent term (of several the least), length and id.
    most, own = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
    np.maximum.at(most, doc, tf)
    chief = np.flatnonzero(tf == most[doc])[::-1]
    own[doc[chief]] = term[chief]
    order = np.lexsort((ids, lengths, own))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    key = term * n + rank[doc]
    # Frequencies go into the lower bits where there is room, as sorting is faster than looking for an order.
    if (bits := int(tf.max(initial=0)).bit_length()) + (len(terms) * n).bit_length() < 64:
        key = np.sort(key << bits | tf)
        key, tf = key >> bits, key & ((1 << bits) - 1)
    else:
        by = np.argsort(key)
        key, tf = key[by], tf[by]
    term, doc = np.divmod(key, n)
    at = _starts(term * n + doc // BLOCK)
    row = {
        "doc_ids": ids[order], "lengths": lengths[order], "terms": terms, "dir_sizes": np.bincount(term[at], minlength=len(terms)), "dir_block": doc[at] // BLOCK, "dir_n": np.diff(np.append(at, len(doc))),
        "dir_tf": np.maximum.reduceat(tf, at) if len(at) else tf, "low": doc % BLOCK, "tf": tf,
    }
    return {"n_docs": len(ids), "n_tokens": int(lengths.sum()), **{k: row[k].astype(t).tobytes() for k, t in _ARRAYS}}


def build_index(docs: DataFrame, tokens_per_shard: int = 6_000_000, docs_per_shard: int = 10_000) -> DataFrame:
    """The index of all documents (doc_id, text), a row of arrays for each shard, kept in the shared folder.

    Partitions far smaller than a shard are read together. A shard ends at `tokens_per_shard` tokens or `docs_per_shard` documents, or with one longer text,
    which is indexed whole. Null and empty texts are documents without terms; repeated rows and repeated
    ids are documents of their own; null ids stay null; an empty table gives an empty index; other
    columns are ignored. Terms are known by 64-bit hashes: words of equal hash would count as one.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_docs = n_tokens = place = 0

        def shard() -> pa.RecordBatch:
            row = _index_shard(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return arrow({"place": [place], **{k: [v] for k, v in row.items()}}, _SCHEMA)

        for part in slices(batches, "text", 4096, 8 << 20):
            tok, ends = tokens(part.column("text"))
            if held and (n_tokens + len(tok) > tokens_per_shard or n_docs + part.num_rows > docs_per_shard):
                yield shard()
                held, n_docs, n_tokens, place = [], 0, 0, place + 1
            ids = part.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            held.append((ids, tok, np.diff(ends, prepend=0)))
            n_docs, n_tokens = n_docs + part.num_rows, n_tokens + len(tok)
        if held:
            yield shard()

    n_tasks = max(1, -(-2 * docs.count() // docs_per_shard))
    return checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").coalesce(n_tasks).mapInArrow(build, _INDEX).withColumn("part", F.spark_partition_id()))


class Shard:
    """One shard under global statistics. Nothing is decoded before a query needs it; `read` counts the postings and impacts that queries have looked at.

    Impacts and block maxima are kept in single precision, which serves for bounds only: whatever may be among the best is scored anew from frequencies.
    """

    def __init__(self, row: dict, mean_length: float):
        a = {k: np.frombuffer(row[k], t) for k, t in _ARRAYS}
        self.ids, self.terms = a["doc_ids"], a["terms"]
        self.n_docs, self.n_blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        self.norm = K1 * (1 - B + B * a["lengths"] / max(mean_length, 1e-9))
        self.dir_size = a["dir_sizes"].astype(np.int64)
        self.dir_start = np.cumsum(self.dir_size) - self.dir_size
        self.block, self.n = a["dir_block"], a["dir_n"].astype(np.int32)
        self.start = np.cumsum(self.n, dtype=np.int64) - self.n
        self.df = np.add.reduceat(self.n, self.dir_start, dtype=np.int64) if len(self.terms) else self.dir_size
        #: Terms and blocks of the directory, in order; documents and terms of all postings, in order, and their frequencies. Both are made when they are first needed.
        self.places = self.by_doc = self.by_doc_tf = None
        least = np.minimum.reduceat(self.norm, np.arange(0, self.n_docs, BLOCK)) if self.n_docs else self.norm
        most = a["dir_tf"].astype(np.float64)
        self.most = (most * (K1 + 1) / (most + least[self.block])).astype(np.float32)
        self.low, self.tf = a["low"], a["tf"]
        #: Documents and impacts of the postings, for the directory's entries that were decoded.
        self.doc, self.impact = np.empty(len(self.tf), np.int32), np.empty(len(self.tf), np.float32)
        self.ready, self.ready_terms = np.zeros(len(self.n), bool), np.zeros(len(self.terms), bool)
        #: The same side by side as bytes of each list, for terms that were read whole: these are put in a row far faster than arrays are.
        self.lists, self.cut = [b""] * len(self.terms), np.zeros(len(self.terms), bool)
        self.row = np.full(len(self.terms), -1)
        self.dense, self.tops, self.n_rows = np.zeros((0, self.n_blocks * BLOCK), np.float32), np.zeros((0, self.n_blocks), np.float32), 0
        self.read = 0

    def _decode(self, entries: np.ndarray) -> None:
        """Decodes directory entries that were not yet."""
        new = entries[~self.ready[entries]]
        if not len(new):
            return
        n = self.n[new]
        at = ranges(self.start[new], n)
        doc = np.repeat(self.block[new] * np.int32(BLOCK), n) + self.low[at]
        self.doc[at], self.impact[at], self.ready[new] = doc, self._impacts(at, doc), True

    def _impacts(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impacts of postings in double precision."""
        tf = self.tf[at].astype(np.float64)
        return tf * (K1 + 1) / (tf + self.norm[doc])

    def _postings(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of directory entries lie, in a row, and how many each entry has."""
        self._decode(entries)
        n = self.n[entries]
        at = ranges(self.start[entries], n)
        self.read += len(at)
        return at, n

    def _lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for whole lists of different terms."""
        new = terms[~self.ready_terms[terms]]
        self._decode(ranges(self.dir_start[new], self.dir_size[new]))
        self.ready_terms[new] = True
        n = self.df[terms]
        at = ranges(self.start[self.dir_start[terms]], n)
        self.read += len(at)
        return at, n

    def _cut(self, terms: np.ndarray) -> None:
        """Decodes whole lists and cuts them out of the postings."""
        new = self.cut.copy()
        new[terms] = True
        new = np.flatnonzero(new & ~self.cut)
        self.cut[new] = True
        self._decode(ranges(self.dir_start[new], self.dir_size[new]))
        n = self.df[new]
        at = ranges(self.start[self.dir_start[new]], n)
        pairs, ends = np.stack([self.doc[at], self.impact[at].view(np.int32)], axis=1), np.cumsum(n)
        for t, a, b in zip(new.tolist(), (ends - n).tolist(), ends.tolist(), strict=True):
            self.lists[t] = pairs[a:b].tobytes()

    def rows(self, terms: np.ndarray) -> np.ndarray:
        """Where `dense` holds the impacts of different terms by document, and `tops` their block maxima; kept for the next queries up to a bound."""
        new = terms[self.row[terms] < 0]
        if len(new) and self.n_rows and (self.n_rows + len(new)) * self.n_docs > ROWS:
            self.row[:], self.n_rows, new = -1, 0, terms
        if (more := self.n_rows + len(new) - len(self.dense)) > 0:
            more = max(more, len(self.dense))
            self.dense, self.tops = (np.concatenate([x, np.zeros((more, x.shape[1]), np.float32)]) for x in (self.dense, self.tops))
        for t in new.tolist():
            r = self.row[t] = self.n_rows
            self.n_rows += 1
            self.dense[r], self.tops[r] = 0, 0
            entries = np.arange(self.dir_start[t], self.dir_start[t] + self.dir_size[t])
            self.tops[r, self.block[entries]] = self.most[entries]
            at, _ = self._lists(np.array([t]))
            self.dense[r, self.doc[at]] = self.impact[at]
        return self.row[terms]

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of terms in this shard, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, prune: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the k best (score, then smaller id) for one query, over documents with any of its different terms."""
        order = np.argsort(terms)
        _, ids, score = self.best(np.array([len(terms)]), self.find(terms)[order], weights[order], k, np.zeros(1), prune)
        return ids, score

    def best(self, ends: np.ndarray, at: np.ndarray, weights: np.ndarray, k: int, least: np.ndarray, prune: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best documents of every query, of those that score `least` of the query or more: query, doc_id, score; queries in order, the best first.

        `at` has the terms of all queries in a row, by number and in order, -1 where the shard has none, and `ends` where a query's end.
        """
        known = at >= 0
        ends = np.concatenate([[0], np.cumsum(known)])[ends]
        at, weights = at[known], weights[known]
        sizes = np.diff(ends, prepend=0)
        if prune and self.n_docs > 4 * k:
            query, docs = self._pivots(sizes, at, weights, k, least)
            score = self._scores(query, docs, ends - sizes, sizes, at, weights)
        else:
            found = [self._all(at[e - n : e], weights[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            query = np.repeat(np.arange(len(ends)), [len(d) for d, _ in found])
            docs, score = (np.concatenate([x[i] for x in found] or [np.zeros(0)]) for i in (0, 1))
        stay = (score > 0) & (score >= least[query])
        query, ids, score = query[stay], self.ids[docs[stay].astype(np.int64)], score[stay]
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = _starts(query)
        stay = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
        return query[stay], ids[stay], score[stay]

    def _all(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents and their scores, by whole lists, added up in the order of terms."""
        at, n = self._lists(terms)
        doc = self.doc[at]
        return np.arange(self.n_docs), np.bincount(doc, np.repeat(weights, n) * self._impacts(at, doc), self.n_docs).astype(np.float64, copy=False)

    def _scores(self, query: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of documents by all terms of their query, added up one by one in the order of the terms' hashes, which is the same in every shard."""
        out, i, find = np.zeros(len(docs)), 0, self._in_lists if len(sizes) < FEW else self._in_docs
        upto = np.cumsum(sizes[query])
        while i < len(docs):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STEP, "right")))
            n = sizes[query[i:j]]
            term, pair = ranges(starts[query[i:j]], n), np.repeat(np.arange(j - i), n)
            hit, tf = find(terms[term], docs[i:j][pair])
            pair, tf = pair[hit], tf.astype(np.float64)
            out[i:j] = np.bincount(pair, weights[term[hit]] * (tf * (K1 + 1) / (tf + self.norm[docs[i:j][pair]])), j - i)
            i = j
        return out

    def _in_lists(self, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of terms and documents have a posting, and its frequency, by the lists' directory."""
        if self.places is None:
            self.places = np.repeat(np.arange(len(self.terms)) * self.n_blocks, self.dir_size) + self.block
        wanted = terms * self.n_blocks + docs // BLOCK
        entry = np.searchsorted(self.places, wanted)
        hit = np.flatnonzero(self.places[np.minimum(entry, len(self.places) - 1)] == wanted)
        at, n = self._postings(entry[hit])
        hit = np.repeat(hit, n)
        mine = self.doc[at] == docs[hit]
        return hit[mine], self.tf[at[mine]]

    def _in_docs(self, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by the terms of each document, for which all postings are read once."""
        if self.by_doc is None:
            self._decode(np.arange(len(self.n)))
            by = np.argsort(self.doc if self.n_docs > 1 << 16 else self.doc.astype(np.uint16), kind="stable")
            self.by_doc = self.doc[by] * np.int64(len(self.terms))
            self.by_doc += np.repeat(np.arange(len(self.terms), dtype=np.int32), self.df)[by]
            self.by_doc_tf = self.tf[by]
            self.read += len(by)
        wanted = docs * len(self.terms) + terms
        at = np.minimum(np.searchsorted(self.by_doc, wanted), len(self.by_doc) - 1)
        hit = np.flatnonzero(self.by_doc[at] == wanted)
        self.read += len(hit)
        return hit, self.by_doc_tf[at[hit]]

    def _pivots(self, sizes: np.ndarray, at: np.ndarray, weights: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and documents that include the k best of each query, and all that tie with them, where these score `least` or more."""
        width, query = self.n_blocks * BLOCK, np.repeat(np.arange(len(sizes)), sizes)
        whole, groups = (WHOLE_FEW, GROUPS) if len(sizes) < FEW else (WHOLE, 1)
        # Frequent terms have a column each, the rarest first, and no more than the bound of rows; lists of the others are read whole.
        often = np.zeros(len(self.terms), bool)
        often[at] = True
        terms = np.flatnonzero(often & (self.df > whole * self.n_docs))
        terms = terms[np.argsort(self.df[terms], kind="stable")][-max(1, ROWS // width) :]
        m, rows = max(1, len(terms)), self.rows(terms)
        column = np.full(len(self.terms), -1)
        column[terms] = np.arange(len(terms))
        column = column[at]
        often, rare = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        column, often_weights, often_ends = column[often], weights[often].astype(np.float32), np.cumsum(np.bincount(query[often], minlength=len(sizes)))
        often = query[often]
        rare_sizes = np.bincount(query[rare], minlength=len(sizes))
        rare, rare_weights, rare_ends = at[rare], weights[rare].astype(np.float32), np.cumsum(rare_sizes)
        self._cut(rare)
        lengths, rare = self.df[rare], rare.tolist()
        #: What rounding to single precision may take from a sum, as a share.
        slack = 2.4e-7 * (m + 16)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        together = min(TOGETHER, max(1, 16 * STEP // max(m, width)))
        for i in range(0, len(sizes), together):
            j = min(i + together, len(sizes))
            sums = np.empty((j - i, width), np.float32)
            for q in range(i, j):
                b = int(rare_ends[q])
                a = b - int(rare_sizes[q])
                pairs = np.frombuffer(b"".join([self.lists[t] for t in rare[a:b]]), np.int32).reshape(-1, 2)
                docs, impacts = pairs[:, 0], pairs[:, 1].view(np.float32)
                sums[q - i] = np.bincount(docs, impacts * np.repeat(rare_weights[a:b], lengths[a:b]), width)
                self.read += len(docs)
            a, b = (int(often_ends[i - 1]) if i else 0), int(often_ends[j - 1])
            mine, at_mine = np.unique(column[a:b], return_inverse=True)
            matrix = np.zeros((j - i, len(mine)), np.float32)
            matrix[often[a:b] - i, at_mine] = often_weights[a:b]
            found += [(q + i, d) for q, d in self._pivots_of(sums, matrix, rows[mine], groups, k, least[i:j] * (1 - slack), slack)]
        return np.concatenate([np.zeros(0, np.int64), *[q for q, _ in found]]), np.concatenate([np.zeros(0, np.int64), *[d for _, d in found]])

    def _pivots_of(self, sums: np.ndarray, matrix: np.ndarray, rows: np.ndarray, groups: int, k: int, least: np.ndarray, slack: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for queries that go together, by their documents' scores without the terms of the rows, and the weights of these."""
        cuts = [len(rows) * g // groups for g in range(groups + 1)]
        #: What the terms from each group on can add to a document of each block.
        ahead = np.zeros((groups + 1, len(sums), self.n_blocks), np.float32)
        for g in range(groups - 1, -1, -1):
            ahead[g] = ahead[g + 1] + matrix[:, cuts[g] : cuts[g + 1]] @ self.tops[rows[cuts[g] : cuts[g + 1]]]

        def kth(score: np.ndarray) -> np.ndarray:
            """What the k-th best scores are at least, as documents on the threshold must stay, for ties."""
            return np.partition(score, -k, axis=-1)[..., -k] * (1 - slack)

        new = np.flatnonzero(least == 0)
        if len(new):
            # Without a threshold the most promising documents are scored first.
            least = least.copy()
            for q in new.tolist():
                hope = sums[q, : self.n_docs] + np.repeat(ahead[0, q], BLOCK)[: self.n_docs]
                probe, own = np.argpartition(hope, -4 * k)[-4 * k :], np.flatnonzero(matrix[q])
                self.read += len(probe) * len(own)
                least[q] = kth(sums[q, probe] + matrix[q, own] @ self.dense[rows[own, None], probe])
        highest = sums.ravel()
        for _ in range(BLOCK.bit_length() - 1):
            highest = np.maximum(highest[::2], highest[1::2])
        least = least.astype(np.float32)[:, None] * np.float32(1 - 1e-6)
        blocks = np.flatnonzero((highest.reshape(len(sums), -1) + ahead[0] >= least).any(axis=0))
        docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        score = sums[:, docs]
        # Rows are cut out by blocks, as that copies eight values at a time.
        table = self.dense.reshape(len(self.dense), self.n_blocks, BLOCK)[rows[:, None], blocks].reshape(len(rows), len(docs))
        for g in range(groups):
            a, b = cuts[g], cuts[g + 1]
            if groups > 1:
                stay = np.flatnonzero((score + ahead[g][:, docs // BLOCK] >= least).any(axis=0))
                docs, score, table = docs[stay], score[:, stay], table[:, stay]
            self.read += len(docs) * (b - a)
            score += matrix[:, a:b] @ table[a:b]
        if len(new) and len(docs) > k:
            least[new] = np.maximum(least[new], kth(score[new])[:, None])
        query, at = np.nonzero((score >= least) & (score > 0))
        return [(query, docs[at])]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query text as its sorted distinct terms and their frequencies."""
    schema = pa.schema([("query_id", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary()), ("size", pa.int64())])
    for part in slices(batches, "text", 2048, 4 << 20):
        tok, ends = tokens(part.column("text"))
        terms, counts = [], []
        for a, b in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), strict=True):
            t, n = np.unique(tok[a:b], return_counts=True)
            terms.append(t.astype("<u8").tobytes())
            counts.append(n.astype("<u4").tobytes())
        yield arrow({"query_id": part.column("query_id"), "terms": terms, "counts": counts, "size": [len(t) for t in terms]}, schema)


def search(index: DataFrame, queries: DataFrame, k: int = 10, bytes_per_block: int = 64 << 20) -> DataFrame:
    """The k best documents for each query text (query_id, text): query_id, rank, doc_id, score.

    Scores are BM25 with k1 1.2 and b 0.75 and idf ln(1 + (N - n + 0.5) / (n + 0.5)); a query's word
    counts as often as it comes. Ties go to the smaller doc_id. Documents without any word of the query
    are not returned, so null, empty and unmatched queries have no rows, and an empty index or an empty
    table of queries gives an empty result. Rows with one query_id are one query of all their words, each
    different text counted once; query_ids must not be null (such rows are left out). A null doc_id is
    returned as null.

    Queries are sent to the shards in blocks: as many as have terms of `bytes_per_block` bytes, or a
    single larger one. A block goes to a shard for each core first, then to more and more, until all were
    asked; the k-th best score of each query that was found so far is the threshold of the next shards.
    Answers are merged and kept in the shared folder after each of these rounds, and what was sent for a
    block is dropped before the next one goes.
    """
    spark = index.sparkSession
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "text").distinct()
    bags = checkpointed(asked.mapInArrow(_bags, _QUERY))
    total = bags.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-2 * total // bytes_per_block))
    n_docs, n_tokens, n_shards, n_parts = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*"), F.coalesce(F.max("part") + 1, F.lit(0))).first()
    rounds = _rounds(n_shards, n_parts, spark.sparkContext.defaultParallelism)
    order = F.desc("score"), "doc_id"
    # The best of all shards meet in two steps, so that many shards do not make one long window.
    some, best = W.partitionBy("query_id", "heap").orderBy(*order), W.partitionBy("query_id").orderBy(*order)
    found = None
    for block in range(n_blocks):
        rows = bags.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).select("query_id", "terms", "counts").collect()
        plan = _plan(spark, index, rows, n_docs)
        shared, part, least = spark.sparkContext.broadcast(plan), None, np.zeros(len(plan[0]))
        for i, shards in enumerate(rounds):
            answers, sent = _answers(index.where(shards), shared, least, k, n_tokens / max(1, n_docs))
            near = answers.withColumn("heap", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).select("query_id", "doc_id", "score")
            near = near if part is None else near.unionByName(part.select("query_id", "doc_id", "score"))
            part = checkpointed(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score"))
            sent.destroy()
            if i + 1 < len(rounds):
                kth = dict(part.where(F.col("rank") == k).select("query_id", "score").collect())
                least = np.array([kth.get(q, 0.0) for q in plan[0].tolist()])
        shared.destroy()
        found = part if found is None else found.union(part)
    return found.select("query_id", "rank", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")).alias("doc_id"), "score")


def _rounds(n_shards: int, n_parts: int, n_tasks: int) -> list[Column]:
    """Conditions on the shards that are asked together: the first of so many partitions as there are tasks, then of eight times as many, and so on; then all others."""
    if n_shards <= n_tasks:
        return [F.lit(True)]
    every = [-(-n_parts // n_tasks)]
    while every[-1] >= 16:
        every.append(every[-1] // 8)
    if every[-1] > 1 and n_shards * every[-1] > 16 * n_parts:
        every.append(1)
    number = F.coalesce(*[F.when((F.col("place") == 0) & (F.col("part") % n == 0), i) for i, n in enumerate(every)], F.lit(len(every)))
    return [number == i for i in range(len(every) + 1)]


def _frequencies(index: DataFrame, vocabulary: Broadcast, size: int) -> np.ndarray:
    """The number of documents with each term of a sorted vocabulary, added up in parts over the shards."""
    n_parts = -(-size // _PART)
    if not n_parts:
        return np.zeros(0)
    kind = "part int, heap int, n binary"
    schema = pa.schema([("part", pa.int32()), ("heap", pa.int32()), ("n", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        total, heap = np.zeros(n_parts * _PART, "<i8"), None
        for b in batches:
            for row in b.to_pylist():
                t, sizes, n = (np.frombuffer(row[c], d) for c, d in (("terms", "<u8"), ("dir_sizes", "<i4"), ("dir_n", "u1")))
                if not len(t):
                    continue
                where = np.searchsorted(v, t)
                mine = (where < len(v)) & (v[np.minimum(where, len(v) - 1)] == t)
                starts = np.cumsum(sizes) - sizes
                total[where[mine]] += np.add.reduceat(n.astype(np.int64), starts)[mine]
                heap = int(t[0] % np.uint64(64))
        if heap is not None:
            yield arrow({"part": np.arange(n_parts), "heap": np.full(n_parts, heap), "n": [total[i * _PART : (i + 1) * _PART].tobytes() for i in range(n_parts)]}, schema)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<i8") for x in pdf["n"]], axis=0)
        return pd.DataFrame([{"part": int(pdf["part"].iloc[0]), "heap": 0, "n": total.astype("<i8").tobytes()}])

    sums = index.select("terms", "dir_sizes", "dir_n").mapInArrow(count, kind).groupBy("part", "heap").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind).collect()
    out = np.zeros(n_parts * _PART)
    for r in sums:
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["n"], "<i8")
    return out[:size]


def _plan(spark: SparkSession, index: DataFrame, rows: list, n_docs: int) -> tuple[np.ndarray, ...]:
    """Queries for all shards: ids, where the terms of each end, the different terms that there are, and for every query in a row their numbers, in order, and weights.

    Queries of one most frequent term go one after the other, as they have others in common as well.
    """
    asked: list[tuple[int, np.ndarray, np.ndarray]] = []
    for r in sorted(rows):
        qid, t, c = r["query_id"], np.frombuffer(r["terms"], "<u8"), np.frombuffer(r["counts"], "<u4")
        if asked and asked[-1][0] == qid:
            _, t0, c0 = asked.pop()
            t, at = np.unique(np.concatenate([t0, t]), return_inverse=True)
            c = np.bincount(at, np.concatenate([c0, c]), len(t)).astype("<u4")
        asked.append((qid, t, c))
    vocabulary = np.unique(np.concatenate([q[1] for q in asked])) if asked else np.zeros(0, "<u8")
    words = spark.sparkContext.broadcast(vocabulary)
    n = _frequencies(index, words, len(vocabulary))
    words.destroy()
    terms, n = vocabulary[n > 0], n[n > 0]
    idf = np.log(1 + (n_docs - n + 0.5) / (n + 0.5))
    plan = []
    for qid, t, c in asked:
        at = np.searchsorted(terms, t)
        ok = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == t) if len(terms) else np.zeros(len(t), bool)
        at = at[ok]
        plan.append((int(at[np.argmax(n[at])]) if len(at) else -1, len(at), qid, at.astype(np.int32), idf[at] * c[ok]))
    plan.sort(key=lambda q: q[:3])
    ids, sizes = np.array([q[2] for q in plan], np.int64), np.array([q[1] for q in plan], np.int64)
    return ids, np.cumsum(sizes), terms, np.concatenate([np.zeros(0, np.int32), *[q[3] for q in plan]]), np.concatenate([np.zeros(0), *[q[4] for q in plan]])


def _answers(index: DataFrame, shared: Broadcast, least: np.ndarray, k: int, mean_length: float, at_once: int = 4096) -> tuple[DataFrame, Broadcast]:
    """The best documents of every shard for a block of queries, of those that reach its thresholds, and the broadcast that it needs until it is computed."""
    known = index.sparkSession.sparkContext.broadcast(least)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
        ids, ends, terms, of, weights = shared.value
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.slice(i, 1).to_pylist()[0], mean_length)
                at = shard.find(terms)
                for q in range(0, len(ids), at_once):
                    some = slice(q, q + at_once)
                    x, y = int(ends[q - 1]) if q else 0, int(ends[some][-1])
                    query, doc, score = shard.best(ends[some] - x, at[of[x:y]], weights[x:y], k, known.value[some])
                    yield arrow({"query_id": ids[some][query], "doc_id": doc, "score": score}, schema)

    return index.mapInArrow(answer, "query_id long, doc_id long, score double"), known
