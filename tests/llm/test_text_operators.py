"""Sharding, line dedup, SimHash, packing and decontamination against brute force on made-up documents."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cutloom.llm import decontaminate, linededup, packing, sharding, simhash, tokens
from cutloom.operators.components import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLASHING = ["n_lines", "score", "h", "chunk", "shard", "block", "gone_lines", "text_key", "row", "line", "statistics", "n", "w"]


def with_clashes(df):
    return df.withColumns({c: F.lit("mine") for c in CLASHING})


# Sharding.


@pytest.mark.parametrize("n", [1, 3, 16])
def test_shards(docs, rows, n):
    got = sharding.kd_shards(with_clashes(docs), n).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    assert set(slots) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_shards(rows, n_shards):
    """Weighted medians along the widest dimension, point by point. A point is a document with a text of its own."""
    hash64 = lambda x: (v := xxhash.xxh64_intdigest(x, 42)) - (2**64 if v >> 63 else 0)
    place = lambda s: -1 if s is None else hash64(s.encode()) % 2**20
    points = [(len(t.encode()) + 1, (c, place(s), place(la), i), hash64(t.encode()) % 2**20, hash64(i.to_bytes(8, "little")), i) for i, t, la, s, c in rows]
    spans = [(min(p[1][d] for p in points), max(p[1][d] for p in points)) for d in range(4)]
    scaled = {p[4]: [int((p[1][d] - lo) * ((2**30 - 1) / (hi - lo) if hi > lo else 0.0)) for d, (lo, hi) in enumerate(spans)] for p in points}
    out = {}

    def split(part, first, n):
        if n == 1 or not part:
            out.update({p[4]: first for p in part})
            return
        wide = max(range(4), key=lambda d: (max(scaled[p[4]][d] for p in part) - min(scaled[p[4]][d] for p in part), -d))
        key = lambda p: (scaled[p[4]][wide] << 32) + (p[2] << 12) + (p[3] % min(p[0], 4096) if p[0] > 1 else 0)
        part = sorted(part, key=key)
        goal, below = max(1, sum(p[0] for p in part) * (n // 2) // n), 0
        for at, p in enumerate(part):  # noqa: B007
            if below + p[0] >= goal:
                break
            below += p[0]
        at += below + p[0] - goal <= goal - below
        split(part[:at], first, n // 2)
        split(part[at:], first + n // 2, n - n // 2)

    split(points, 0, n_shards)
    return out


@pytest.mark.parametrize("n", [2, 5, 16])
def test_shards_are_those_of_plain_medians(spark, n):
    r = random.Random(n)
    rows = [(i * 7, f"text {i} " * r.randint(1, 40), r.choice(["en", "de", None]), r.choice(["hot", "hot", "a", "b", None]), r.randint(0, 10**r.randint(1, 5))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(df, n, tolerance=0.0).collect()}
    assert got == plain_shards(rows, n)


def test_shards_are_even_under_skew(spark):
    texts = [(i, "same text " * 4, "en", "hot", 1) for i in range(3000)] + [(i, f"text {i} " * (1 + i % 7), "de", f"s{i % 9}", i) for i in range(3000, 6000)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = [r["b"] for r in sharding.kd_shards(df, 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16
    assert max(sizes) < 1.02 * min(sizes)
    few = sharding.kd_shards(df, target_bytes=20_000)
    assert few.agg(F.max("shard")).first()[0] + 1 == -(-sum(sizes) // 20_000)


def test_small_groups_stay_together(docs):
    got = sharding.kd_shards(docs, 4, tolerance=0.5).groupBy("size", "text_crc32").agg(F.countDistinct("shard").alias("n"), F.sum("size").alias("b"))
    limit = docs.select(F.sum(F.octet_length("text"))).first()[0] / 4 * 0.5
    assert got.where(f"b <= {limit}").agg(F.max("n")).first()[0] == 1


def test_sharding_of_nothing(empty):
    assert sharding.kd_shards(empty, 16).count() == 0


# Line dedup.


def plain_lines(rows, least, chars=1):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    held = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < max(1, chars) or held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "keys_per_shard": 50}, {"broadcast_bytes": 0}, {"keys_per_shard": 40}, {"broadcast_bytes": 300, "lines_per_shard": 100}])
def test_line_dedup(docs, rows, options):
    for least, chars in ((10, 1), (2, 5)):
        got = linededup.dedup_lines(with_clashes(docs), least, chars, **options)
        assert got.where(" and ".join(f"{c} = 'mine'" for c in CLASHING if c != "n_lines")).count() == len(rows)
        assert Counter(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in got.collect()) == plain_lines(rows, least, chars)
        assert {hashlib.sha256((r["text"] or "").encode()).hexdigest() == r["kept_sha256"] for r in got.collect()} == {True}


def test_hot_line_beyond_the_broadcast(spark):
    """One line in every document goes where the documents are read; the shards get the others only."""
    rows = [(i, f"hot line\nown {i}\nshared {i % 40}\n Hot Line ") for i in range(1200)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=20_000, keys_per_shard=10, lines_per_shard=800)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in got.collect()) == plain_lines(rows, 10)


def test_line_dedup_of_nothing(empty):
    assert linededup.dedup_lines(empty).count() == 0
    assert linededup.dedup_lines(empty, broadcast_bytes=-1).count() == 0


def test_perfect_hash():
    h = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000))
    mph = linededup.PerfectHash.build(h)
    assert sorted(mph.slots(h).tolist()) == list(range(len(h)))
    assert len(mph.bits) * 8 < 6 * len(h)
    assert linededup.PerfectHash.build(h[:0]).slots(h[:3]).tolist() == [-1] * 3


def test_equal_hashes_are_told_apart():
    row = {"sizes": [64], "levels": np.packbits([1] + [0] * 63, bitorder="little").tobytes(), "prints": b"", "counts": b"", "extra": np.array([[5, 7, 12], [5, 8, 3]], "<i8").tobytes()}
    assert linededup.Shard(row).lookup(np.array([5, 5, 5]), np.array([7, 8, 9])).tolist() == [12, 3, 0]


# SimHash.


def plain_print(text, words):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if s else 0


def plain_components(prints, ids, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("limit", [2048, 1, 3])
def test_simhash(docs, rows, limit):
    prints = [plain_print(t, 4) for _, t, *_ in rows]
    want = Counter(zip([i for i, *_ in rows], [f"{p:016x}" for p in prints], plain_components(prints, [i for i, *_ in rows], 4), strict=True))
    got = simhash.near_duplicates(with_clashes(docs), bucket_limit=limit)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == want


def test_long_texts_and_lanes():
    r = random.Random(5)
    for n in (1, 3, 4, 5, 254, 255, 256, 700):
        t = " ".join(r.choice(["aa", "b", "Cc", "dé"]) + str(r.randint(0, 50)) for _ in range(n))
        assert int(simhash.fingerprints([b"", t.encode(), b"x"], 4)[1]) == plain_print(t, 4)


def test_covering_masks():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    r = random.Random(2)
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(not m & diff for m in masks)


def test_near_links_dense_buckets(spark):
    """A dense ball of fingerprints in large buckets keeps its components."""
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    want = plain_components(fps, list(range(len(fps))), 4)
    for limit in (2, 10, 5000):
        roots = dict((x["node"] % 2**64, x["root"] % 2**64) for x in components(simhash.near_links(df, 4, limit)).collect())
        groups, plain = defaultdict(set), defaultdict(set)
        for i, f in enumerate(fps):
            groups[roots.get(f, f)].add(f)
            plain[want[i]].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(300, 340)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got.get(n, n) == min(seen)


def test_similar_documents(docs, rows):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.similar_documents(docs).collect())
    assert sum(got.values()) == len(rows)
    group = dict(got.keys())
    assert {group[i] for i in range(120, 150)} == {7}
    assert {group[i] for i in range(150, 165)} == {150}
    assert group[174] == 174
    assert group[171] == 170
    assert group[179] == 174
    clean = [i for i in range(120) if i != 7]
    assert all(group[i] == i for i in clean)


def test_representatives(docs, rows):
    kept = simhash.keep_representatives(docs, simhash.similar_documents(docs))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    assert None in ids
    assert {7, 150, 5, 174} <= set(ids)
    assert not set(range(120, 150)) & set(ids)


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.similar_documents(empty).count() == 0


# Tokens and packing.


@pytest.fixture(scope="module")
def plain_tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def test_tokenizer_is_exact(rows, plain_tokenizer):
    r = random.Random(8)
    odd = ["".join(chr(r.choice([r.randint(9, 255), r.randint(32, 126), r.randint(256, 700), r.randint(0x2000, 0x206F), r.randint(0x300, 0x3FF)])) for _ in range(r.randint(1, 60))) for _ in range(300)]
    texts = [t for _, t, *_ in rows] + odd + ["it's they're I'M 12³ ½ don't'll !!'s", "<|endoftext|> <|startoftext|>", "a <|endoftext|> b", "A<|endoftext|>b<|ENDOFTEXT|>", "<|endoftext", "á é", "İstanbul ŉ ǅ", " x  y z　"]
    for limit in (600_000, 50):
        t = tokens.WordTokenizer(TOKENIZER, limit)
        for _ in range(2):
            ids, ends = t.encode(pa.array(texts, pa.string()), 0)
            want = [plain_tokenizer.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
            assert [ids[e - len(w) : e].tolist() for e, w in zip(ends.tolist(), want, strict=True)] == want
            assert ends[-1] == sum(map(len, want))


def test_packing(docs, rows, plain_tokenizer):
    rows = [*rows, (700, "a <|endoftext|> b", None, None, None), (701, "<|startoftext|>", None, None, None)]
    more = docs.union(docs.sparkSession.createDataFrame(rows[-2:], docs.schema))
    for blocks in (100_000, 40):
        got = packing.pack(with_clashes(more), TOKENIZER, pieces_per_block=blocks).collect()
        assert [r["length"] for r in got if r["doc_id"] == 700] == [4]
        want = Counter()
        for i, t, *_ in rows:
            ids = plain_tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
            for p in range(-(-len(ids) // 2048)):
                part = ids[p * 2048 : (p + 1) * 2048]
                want[i, p, p * 2048, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
        places = defaultdict(list)
        for r in got:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for p in places.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(k[3] * n for k, n in want.items())
        assert len(places) <= 1.05 * -(-total // 2048) + 6


def test_sum_of_squares_is_dense():
    r = np.random.default_rng(3)
    lengths = np.concatenate([r.integers(1, 2049, 5000), np.full(300, 2048)])
    sequence, _ = packing.sum_of_squares(lengths)
    assert sequence.max() + 1 <= 1.01 * -(-lengths.sum() // 2048)
    assert packing.sum_of_squares(np.array([], np.int64))[0].tolist() == []


def test_repeated_rows_do_not_fill_one_block(spark):
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.pack(same, TOKENIZER, pieces_per_block=500).groupBy((F.col("sequence_id") % 8).alias("block")).count().collect()
    assert len(got) == 8
    assert max(r["count"] for r in got) < 1000


def test_packing_of_nothing(empty):
    assert packing.pack(empty, TOKENIZER).count() == 0


# Decontamination.


@pytest.fixture(scope="module")
def leaky(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 6))) for _ in range(300)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(r.randint(16, 40)))) for i in range(12)] + [(20, None), (21, ""), (22, "too short item")]
    items.append((30, items[0][1]))
    docs, planted = [], set()
    for i in range(80):
        w = text(r.randint(5, 200))
        if i % 4 == 0:
            q = r.randrange(12)
            part = items[q][1].split()
            if i % 8 == 0:
                for k in range(3, len(part), 6):
                    part[k] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + r.choice(["", ",", "."]) for x in part]
            planted.add((i, q))
            if q == 0:
                planted.add((i, 30))
        docs.append((i, " ".join(w)))
    docs += [(90, None), (91, ""), (92, items[1][1]), (92, items[1][1]), (93, items[2][1] + " " + items[2][1]), (None, items[3][1])]
    planted |= {(92, 1), (93, 2), (None, 3)}
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), planted


@pytest.mark.parametrize("limit", [4 << 20, 0])
def test_leaks(leaky, limit):
    docs, items, planted = leaky
    got = decontaminate.leaked(docs, items, broadcast_bytes=limit).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted
    assert sum(r["doc_id"] == 92 for r in got) == 2
    marked = decontaminate.mark_leaks(docs.withColumn("leaks", F.lit(1)), items, broadcast_bytes=limit)
    assert marked.count() == docs.count()
    assert {r["doc_id"] for r in marked.where(F.size("leaks") > 0).collect()} == {d for d, _ in planted}


def test_frequent_seeds_are_dealt_over_tasks(leaky):
    """The shuffled join with so low a limit that seeds of a common passage are split, and with clashing columns."""
    docs, items, planted = leaky
    many = docs.union(docs.sparkSession.createDataFrame([(i, items.where("item_id = 1").first()["text"]) for i in range(1000, 1200)], docs.schema))
    clash = many.withColumns({c: F.lit("mine") for c in ("row", "doc", "item", "salt", "h", "n", "shifts")})
    got = decontaminate._joined(clash, items.select("item_id", F.col("text").alias("item_text")).where("item_text is not null"), decontaminate.Rule(), seeds_per_task=20)
    assert got.columns == [*clash.columns, "leaks"]
    assert got.where("row = 'mine' and salt = 'mine' and n = 'mine'").count() == many.count()
    assert {(r["doc_id"], x["item_id"]) for r in got.collect() for x in r["leaks"]} == planted | {(i, 1) for i in range(1000, 1200)}


def test_leaks_of_nothing(leaky, empty):
    docs, items, _ = leaky
    for limit in (4 << 20, -1):
        assert decontaminate.leaked(empty, items, broadcast_bytes=limit).count() == 0
        assert decontaminate.leaked(docs, items.limit(0), broadcast_bytes=limit).count() == 0


def test_segments():
    same = np.array([0, 1, 1, 1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 1], bool)
    assert decontaminate.segments(same, 2) == [(1, 4), (5, 7), (12, 14)]
