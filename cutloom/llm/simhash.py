"""SimHash near-duplicates with covering locality-sensitive hashing.

A random map m of the 64 bits to {0,1}^(r+1) gives 2^(r+1)-1 masks, one for each nonzero v: bit i
belongs to mask v if <m(i), v> is odd. The at most r bits in which two fingerprints differ leave some
v orthogonal to all their m(i), and there both agree under the mask: every pair within the radius
meets in some table (Pagh, 2016). Fingerprints are made distinct first, so exact copies cost nothing.

In a bucket only the links of a spanning forest are kept, which preserves components. Buckets beyond
`bucket_limit` are not paired up: each of their fingerprints names all points within r/2 of itself in
the bits that the bucket leaves free, and those that name a common point are linked to the smallest
of them. Two strings are within r of each other exactly if such a point exists (r even), so this is
exact too, and grows only in proportion to the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import _MIX, arrow, checkpointed, join_frequent, mixed, slices, utf8
from .decontaminate import tokens

BITS = 64
#: Spreads the bits of a byte over the bytes of a word, so that eight counters are added at once.
_SPREAD = np.packbits(np.zeros((256, 64), np.uint8), axis=1).view("<u8").ravel().copy()
for _b in range(256):
    _SPREAD[_b] = sum(((_b >> _k) & 1) << (8 * _k) for _k in range(8))


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles, repeats included, of a text with A-Z lower-cased; fewer words give the whole sequence."""
    w = text.lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]  # noqa: B905


def fingerprints(texts: list[bytes], words: int, seed: int = 42) -> np.ndarray:
    """A 64-bit SimHash for each text: bits set in over half of its shingles' XXH64; zero without words."""
    digest = xxhash.xxh64_intdigest
    sizes, hashes = [], []
    for t in texts:
        s = shingles(t, words)
        sizes.append(len(s))
        hashes += [digest(x, seed) for x in s]
    return majority(np.array(hashes, np.uint64), np.array(sizes, np.int64))


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of `n` hashes the bits that are set in over half of them; zero for an empty run."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    lanes = _SPREAD[hashes.astype("<u8", copy=False).view(np.uint8)].reshape(-1, 8)
    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
    # A lane of eight bits holds up to 255 shingles; longer texts are added up in runs of 255.
    runs = -(-n[full] // 255)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    at = np.repeat(starts - first * 255, runs) + np.arange(runs.sum()) * 255
    parts = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(len(at), 64)
    counts = np.add.reduceat(parts.astype(np.int64), first, axis=0)
    bits = (counts * 2 > n[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """The bits that each of the 2^(radius+1)-1 tables keeps."""
    m = np.random.default_rng(seed).integers(1, 1 << (radius + 1), BITS)
    masks = []
    for v in range(1, 1 << (radius + 1)):
        odd = np.bitwise_count(m & v) & 1
        masks.append(int(sum(1 << i for i in range(BITS) if odd[i])))
    return masks


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("hot_table", pa.int32())])


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the fingerprints within the radius of each other."""
    n = len(fp)
    label = np.arange(n)
    near = np.concatenate([np.bitwise_count(fp[i : i + 512, None] ^ fp[None, :]) <= radius for i in range(0, n, 512)])
    seen = np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            new = near[front].any(axis=0) & ~seen
            seen |= new
            label[new] = root
            front = np.flatnonzero(new)
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (tab, key, fp) sorted by tab and key to links; rows of buckets over the limit come back as hot."""
    rest_t = rest_k = np.zeros(0, np.int64)
    rest_f = np.zeros(0, np.uint64)
    hot: tuple[int, int] | None = None
    #: A link is passed on only if it joins two sets of this task's linked fingerprints, which keeps components.
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def links(t: np.ndarray, k: np.ndarray, f: np.ndarray) -> pa.RecordBatch | None:
        u, v = [], []
        change = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.concatenate([starts, [len(t)]]))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= 16, sizes)
        for s in range(1, 16):
            i = np.flatnonzero((group[s:] == group[:-s]) & small[s:]) if len(t) > s else np.zeros(0, np.int64)
            if not len(i):
                break
            near = np.bitwise_count(f[i] ^ f[i + s]) <= radius
            u.append(f[i[near]])
            v.append(f[i[near] + s])
        for g in np.flatnonzero(sizes > 16):
            a, b = _forest(f[starts[g] : starts[g] + sizes[g]], radius)
            u.append(a)
            v.append(b)
        if not sum(map(len, u)):
            return None
        u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
        both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        kept = []
        for i, (a, b) in enumerate(zip(both[0].tolist(), both[1].tolist(), strict=True)):
            if (x := find(a)) != (y := find(b)):
                parent[max(x, y)] = min(x, y)
                kept.append(i)
        if not kept:
            return None
        both = both[:, kept]
        return arrow({"u": both[1], "v": both[0], "hot_table": np.full(len(kept), -1, np.int32)}, _LINK)

    def as_hot(t: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return arrow({"u": f.view(np.int64), "v": f.view(np.int64), "hot_table": t}, _LINK)

    for batch in batches:
        t = np.concatenate([rest_t, np.asarray(batch.column("tab"), np.int64)])
        k = np.concatenate([rest_k, np.asarray(batch.column("key"), np.int64)])
        f = np.concatenate([rest_f, np.asarray(batch.column("fp"), np.int64).view(np.uint64)])
        if not len(t):
            continue
        if hot is not None:
            same = (t == hot[0]) & (k == hot[1])
            if same.any():
                yield as_hot(t[same], f[same])
                t, k, f = t[~same], k[~same], f[~same]
            if not len(t):
                rest_t, rest_k, rest_f = t, k, f
                continue
            hot = None
        change = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        starts = np.concatenate([[0], change])
        last = starts[-1]
        sizes = np.diff(np.concatenate([starts, [len(t)]]))
        big = np.repeat(sizes > limit, sizes)
        done = np.arange(len(t)) < last
        if big[last]:
            hot, done = (int(t[last]), int(k[last])), np.ones(len(t), bool)
        if (big & done).any():
            yield as_hot(t[big & done], f[big & done])
        plain = done & ~big
        if plain.any() and (out := links(t[plain], k[plain], f[plain])) is not None:
            yield out
        rest_t, rest_k, rest_f = t[~done], k[~done], f[~done]
    if len(rest_t) and (out := links(rest_t, rest_k, rest_f)) is not None:
        yield out


def _hot_links(hot: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Exact links inside large buckets: fingerprints that name a common point within radius/2 meet there."""
    half = radius // 2

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("point", pa.int64()), ("fp", pa.int64())])
        balls: dict[int, np.ndarray] = {}
        for batch in batches:
            t, f = np.asarray(batch.column("hot_table")), np.asarray(batch.column("u"), np.int64).view(np.uint64)
            for tab in np.unique(t).tolist():
                if tab not in balls:
                    free = [i for i in range(BITS) if not masks[tab] >> i & 1]
                    balls[tab] = np.array([sum(1 << i for i in c) for d in range(half + 1) for c in combinations(free, d)], np.uint64)
                mine = f[t == tab]
                for i in range(0, len(mine), 256):
                    part = mine[i : i + 256]
                    yield arrow({"point": (part[:, None] ^ balls[tab]).ravel().view(np.int64), "fp": np.repeat(part, len(balls[tab])).view(np.int64)}, out)

    named = hot.mapInArrow(name, "point long, fp long").distinct()
    least = named.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(least, "point").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_links(prints: DataFrame, radius: int = 4, bucket_limit: int = 2048) -> DataFrame:
    """Distinct fingerprints (fp long) to links (u, v) whose components are those of all pairs within the radius.

    The radius must be even. Every link is a pair of different fingerprints within the radius, or,
    out of large buckets, a pair that a chain of such links connects.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("tab", "key"))
    dealt = keyed.repartition("tab", "key").sortWithinPartitions("tab", "key")
    found = checkpointed(dealt.mapInArrow(lambda b: _bucket_links(b, radius, bucket_limit), "u long, v long, hot_table int"))
    links = found.where("hot_table < 0").select("u", "v").distinct()
    hot = found.where("hot_table >= 0")
    return links if hot.isEmpty() else links.union(_hot_links(hot, masks, radius)).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, bucket_limit: int = 2048) -> DataFrame:
    """Every document with its fingerprint and its component: doc_id, fingerprint (hex), component_id.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits,
    itself included. Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows are returned as often as they come; null doc_ids are linked but never name a
    component (a component of only such rows has id null); texts are hashed whole, however long; an
    empty table gives an empty result; other columns are ignored.
    """

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
        for part in slices(batches, "text", 256, 1 << 20):
            yield arrow({"doc_id": part.column("doc_id").cast(pa.int64()), "fp": fingerprints(utf8(part.column("text")), words).view(np.int64)}, out)

    marked = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hash_all, "doc_id long, fp long"))
    prints = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(prints.select("fp"), radius, bucket_limit))
    named = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = checkpointed(named.join(ids, "root").select("fp", "component_id", "n"))
    return join_frequent(marked, by_print, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: 64-bit words of the sketch that rules out pairs before their shingles are compared.
CHECKS = 8


def _sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text a key of its words in order and the number of its distinct shingles, and all of these as hashes, sorted within a text."""
    tok, ends = tokens(texts)
    n = np.diff(ends, prepend=0)
    raw = utf8(texts)
    keys = np.array([xxhash.xxh3_64_intdigest(tok[e - k : e].tobytes(), 1) if k else xxhash.xxh3_64_intdigest(t, 2) for t, e, k in zip(raw, ends.tolist(), n.tolist(), strict=True)], np.uint64)
    # A text of fewer words is one shingle.
    span = np.minimum(words, n)
    n_shingles = np.where(n > 0, n - span + 1, 0)
    row = np.repeat(np.arange(len(n)), n_shingles)
    at = (ends - n)[row] + np.arange(n_shingles.sum()) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = k < span[row]
        h = h * np.uint64(_MIX[1]) + np.where(inside, tok[np.where(inside, at + k, at)], np.uint64(0))
    h = mixed(h, 0)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
        h, row = h[new], row[new]
    return keys, np.bincount(row, minlength=len(n)), h


#: How many least shingle hashes of a set are known; its keys are chosen from them.
_LISTED = 64


def _n_keys(n: Column, similarity: float) -> Column:
    """By how many of its least shingle hashes each set is found.

    Sets of that similarity share one of their n - ceil(similarity n) + 1 least hashes. Of the least k
    of their union all are unshared with a chance under (1 - similarity)^k, so k stops at e^-32.
    """
    most = 1 if similarity >= 1 else math.ceil(-32 / math.log(1 - similarity))
    return F.when(n > 0, F.least(F.lit(most), n - F.ceil(similarity * n - 1e-9) + 1)).otherwise(F.lit(0)).cast("int")


def _chosen_keys(nodes: DataFrame, similarity: float, limit: int) -> DataFrame:
    """(node, keys): the hashes at which sets meet. `nodes` has node, n and keys, the `_LISTED` least hashes at most.

    A shingle that is a key of more than `limit` sets is frequent. Sets that are found by one get other
    keys, as if frequent shingles came last in the order of hashes: every pair then still meets at the
    first k others, if enough of a set is others. A set of up to `_LISTED` shingles takes as many keys as
    no pair can avoid in that order. For a larger one the share r of others among its listed hashes,
    less 0.1, stands for their share in the set; sets of similarity s differ in (1 - s) n of its shingles
    and (1 - s)^2 / s n of the other's at most, so they share a part f of their others, and k is taken so
    that (1 - f)^k is under e^-32. Where the list does not hold so many others, two thirds of the set or
    less are others; such a set keeps its frequent keys, and takes all others.
    """
    first = nodes.select("node", F.explode(F.slice("keys", 1, _n_keys(F.col("n"), similarity))).alias("key"))
    frequent = checkpointed(first.groupBy("key").agg(F.count(F.lit(1)).alias("load")).where(F.col("load") > limit).select("key"))
    plain = nodes.select("node", "n", F.slice("keys", 1, _n_keys(F.col("n"), similarity)).alias("keys"), F.col("keys").alias("listed"))
    if frequent.isEmpty():
        return plain.select("node", "keys")
    # The rows of a frequent key meet it in 64 places.
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))

    def marked(rows: DataFrame, how: str) -> DataFrame:
        return rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(64)).cast("int")).join(salted.withColumn("often", F.lit(True)) if how == "left" else salted, ["key", "salt"], how).drop("salt")

    hit = checkpointed(marked(first, "left_semi").select("node").distinct())
    listed = marked(plain.join(hit, "node", "left_semi").select("node", F.posexplode("listed").alias("at", "key")), "left")
    lists = listed.groupBy("node").agg(*[F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "key")))), lambda x: x["key"]).alias(name) for name, c in (("others", F.col("often").isNull()), ("common", F.col("often")))])  # _LISTED each at most
    n_others, least = F.size("others"), 1 - similarity
    share = n_others / F.lit(_LISTED) - 0.1
    f = (share - least) / (share + least**2 / similarity)
    need = F.when(share > least, F.ceil(-32 / F.log(1 - f))).otherwise(F.lit(_LISTED + 1)).cast("int")
    of_small = F.slice(F.concat("others", "common"), 1, F.size("keys"))
    of_large = F.when(need <= n_others, F.slice("others", 1, F.greatest(need, F.lit(1)))).otherwise(F.array_union("keys", "others"))
    new = F.when(F.col("n") <= _LISTED, of_small).otherwise(of_large)
    return plain.join(lists, "node", "left").select("node", F.when(F.col("others").isNull(), F.col("keys")).otherwise(new).alias("keys"))


def _apart_limit(n: int, similarity: float) -> float:
    """Bits of the sketch that sets of the similarity hardly ever differ in beyond: nine deviations over the mean, 64 more for small sets, whose bits are no sums of many."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = CHECKS * BITS
    return bits * p + 9 * math.sqrt(bits * p * (1 - p)) + (64 if n < 20 else 0)


#: Shingles of a cell in which sets are compared by them.
_CELL_SHINGLES = 16 << 20


def _in_cells(rows: DataFrame, limit: int, shingles: int | None = None) -> DataFrame:
    """`rows` (node, bucket and others) with a cell: buckets beyond the limit of rows, or of `shingles` in their sets (n), are dealt to cells so that all of their pairs still meet, each in one small cell."""
    load = F.count(F.lit(1)) / limit
    load = load if shingles is None else F.greatest(load, F.sum("n") / shingles)
    hot = rows.groupBy("bucket").agg(load.alias("load")).where("load > 1").select("bucket", F.ceil("load").cast("int").alias("parts"))
    # The rows of a frequent bucket meet its number of parts in 64 places.
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(F.col("mine"), q) * F.col("parts") + F.greatest(F.col("mine"), q))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(64)).cast("int")).join(hot, ["bucket", "salt"], "left").withColumn("mine", mine)
    return dealt.withColumn("cell", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(cells))).drop("parts", "mine", "salt")


def _maybe_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, cell, n, node, sketch) sorted by the first three to links that join all pairs of a bucket that the sketch does not rule out."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    plain, short = _apart_limit(20, similarity), _apart_limit(1, similarity)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def near(sk: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = np.zeros(np.broadcast(i, j).shape, np.int32)
        for w in range(CHECKS):
            apart += np.bitwise_count(sk[i, w] ^ sk[j, w])
        less, more = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        return (apart <= np.where(less < 20, short, plain)) & (less >= similarity * more - 1e-9)

    def links(key: np.ndarray, n: np.ndarray, node: np.ndarray, sk: np.ndarray) -> pa.RecordBatch | None:
        u, v = [], []
        starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
        sizes = np.diff(np.append(starts, len(key)))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= 16, sizes)
        for s in range(1, 16):
            i = np.flatnonzero((group[s:] == group[:-s]) & small[s:]) if len(key) > s else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[near(sk, n, i, i + s)]
            u.append(i)
            v.append(i + s)
        for g in np.flatnonzero(sizes > 16):
            a, m = int(starts[g]), int(sizes[g])
            todo = np.ones(m, bool)
            for root in range(m):
                if not todo[root]:
                    continue
                todo[root] = False
                front = np.array([root])
                while len(front):
                    rest = np.flatnonzero(todo)
                    new = np.zeros(len(rest), bool)
                    for k in range(0, len(front), 256):
                        left = np.flatnonzero(~new)
                        if not len(left):
                            break
                        new[left] = near(sk, n, a + front[k : k + 256, None], a + rest[left][None, :]).any(axis=0)
                    front = rest[new]
                    todo[front] = False
                    u.append(np.full(len(front), a + root))
                    v.append(a + front)
        if not sum(map(len, u)):
            return None
        kept = []
        for a, b in zip(node[np.concatenate(u)].tolist(), node[np.concatenate(v)].tolist(), strict=True):
            if (x := find(a)) != (y := find(b)):
                parent[max(x, y)] = min(x, y)
                kept.append((a, b))
        return arrow({"u": [a for a, _ in kept], "v": [b for _, b in kept]}, schema) if kept else None

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(c), np.int64) for c in ("bucket", "cell")], axis=1)
        got = [key, np.asarray(batch.column("n"), np.int64), np.asarray(batch.column("node"), np.int64), np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, CHECKS)]
        got = got if rest is None else [np.concatenate(x) for x in zip(rest, got, strict=True)]
        last = int(np.flatnonzero((got[0] != got[0][-1]).any(axis=1))[-1]) + 1 if (got[0] != got[0][-1]).any() else 0
        if last and (out := links(*[x[:last] for x in got])) is not None:
            yield out
        rest = [x[last:] for x in got]
    if rest is not None and (out := links(*rest)) is not None:
        yield out


def _alike(table: pa.Table, similarity: float) -> pa.Table:
    """One group of sets (node, shingles) to links of a spanning forest of its pairs of the similarity or more, each by the shingles themselves."""
    node = table.column("node").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    order = sorted(range(len(node)), key=lambda i: (len(sets[i]), node[i]))
    n = np.array([len(sets[i]) for i in order], np.int64)
    names, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(n)
    starts = ends - n
    label = np.arange(len(n))
    has = np.zeros(len(names), np.int32)
    u, v = [], []
    for i in range(1, len(n)):
        first = int(np.searchsorted(n, similarity * n[i] - 1e-9))
        j = np.arange(first, i)
        mine = ids[starts[i] : ends[i]]
        has[mine] = 1
        # Once a set of a component is like this one, the rest of that component is not looked at.
        step = 16
        while len(j):
            part, j = j[:step], j[step:]
            step = min(4 * step, 4096)
            m = n[part]
            at = np.repeat(starts[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            both = np.add.reduceat(has[ids[at]], np.cumsum(m) - m)
            for k in part[both >= similarity * (m + n[i] - both) - 1e-9].tolist():
                if label[k] != label[i]:
                    u.append(node[order[i]])
                    v.append(node[order[k]])
                    label[label == label[i]] = label[k]
            j = j[label[j] != label[i]]
        has[mine] = 0
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket_limit: int = 2048) -> DataFrame:
    """Every document with its group of near copies: doc_id, component_id (the smallest doc_id of the group).

    text_key and group_id tell apart the texts of a repeated doc_id and the groups of one name. Near copies are texts whose sets of distinct shingles of `words` words have a Jaccard similarity of
    `similarity` or more, and what a chain of such pairs connects. Sets meet by their least shingle
    hashes, frequent ones left out where others suffice (see `_chosen_keys`); pairs that a 512-bit SimHash of the sets does not rule out by far are gathered in rough
    groups, and within these every pair is decided by the shingles themselves before it may link, so
    nothing is thinned out that is not verified. A pair is missed with a chance of about 1e-10 at most (an estimate over keys and sketch bits).
    Texts with the same words in a row are one text from the start; texts without words only
    match themselves. Texts are taken whole, however long. Null texts are empty ones; repeated rows come back as often as they are; null
    doc_ids are grouped but never name a group; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])
    whole = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1024, 1 << 20):
            keys, n, h = _sets(part.column("text"), words)
            starts = np.cumsum(n) - n
            k = np.minimum(n, _LISTED)
            at = np.repeat(starts - (np.cumsum(k) - k), k) + np.arange(k.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), pa.array(h[at].view(np.int64)))
            bits = np.stack([majority(mixed(h, 100 + s), n) for s in range(CHECKS)], axis=1)
            yield arrow({"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "node": keys.view(np.int64), "n": n, "keys": lists, "sketch": [x.tobytes() for x in bits]}, schema)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1024, 1 << 20):
            keys, n, h = _sets(part.column("text"), words)
            ends = np.cumsum(n)
            yield arrow({"node": keys.view(np.int64), "shingles": [h[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]}, whole)

    marked = checkpointed(texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(sketch, "doc_id long, text_key long, node long, n long, keys array<long>, sketch binary"))
    nodes = checkpointed(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")))
    keys = checkpointed(_chosen_keys(nodes, similarity, bucket_limit))
    met = _in_cells(nodes.select("node", "n", "sketch").join(keys, "node").select("node", "n", "sketch", F.explode("keys").alias("bucket")), bucket_limit).select("bucket", "cell", "n", "node", "sketch")
    dealt = met.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "n", "node")
    joined = components(dealt.mapInArrow(lambda b: _maybe_links(b, similarity), "u long, v long"))
    rough = joined.union(joined.select(F.col("root").alias("node"), "root")).distinct()
    # Rough groups of many sets or shingles are taken apart by the keys at which their sets meet.
    members = checkpointed(nodes.select("node", "least", "n").join(rough, "node").join(keys, "node"))
    large = members.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("all")).where((F.col("sets") > 256) | (F.col("all") > 1 << 20)).select("root", F.lit(True).alias("large"))
    keyed = members.join(large, "root", "left").select("node", "n", F.explode(F.when(F.col("large"), F.col("keys")).otherwise(F.array("root"))).alias("bucket"))
    wanted = members.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
    taken = texts.join(wanted, "doc_id", "left_semi").union(texts.where("doc_id is null"))
    arrays = taken.mapInArrow(sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    groups = _in_cells(keyed, bucket_limit, _CELL_SHINGLES).drop("n").join(arrays, "node").groupBy("bucket", "cell")
    close = groups.applyInArrow(lambda t: _alike(t, similarity), "u long, v long")
    roots = components(close)
    named = nodes.select("node", "least", "copies").join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("group_id"))
    ids = named.groupBy("group_id").agg(F.min("least").alias("component_id"))
    by_node = checkpointed(named.join(ids, "group_id").select("node", "component_id", "group_id", "copies"))
    return join_frequent(marked.select("doc_id", "text_key", "node"), by_node, "node", "copies").select("doc_id", "component_id", "text_key", "group_id")


def keep_representatives(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of `docs` that stand for their group in `groups` (as `similar_documents` gives them): one of each group.

    It is a row with the doc_id that names the group; if that id comes with several texts of the group,
    the text with the least key stays, and texts of other groups under the same id are not touched. Rows without
    a doc_id stay. Of repeated rows with one doc_id and text, one stays.
    """
    kept_text = groups.where("doc_id = component_id").groupBy("group_id").agg(F.min("text_key").alias("kept"))
    ids = groups.where("doc_id is not null").select("doc_id", "text_key", "group_id", "component_id").distinct().join(kept_text, "group_id")
    gone = ids.where("doc_id <> component_id or text_key <> kept").select(F.col("doc_id").alias("gone"), F.col("text_key").alias("gone_text")).distinct()
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    kept = keyed.join(gone, (keyed.doc_id.cast("long") == gone.gone) & (keyed.text_key == gone.gone_text), "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text_key"]).union(kept.where("doc_id is null")).drop("text_key")
