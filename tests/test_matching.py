"""The greedy matching by blocks of ranks against a search through all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutloom.operators import matching


def plain(dx, dy, close):
    """Take the best free pair again and again."""
    out, dx, dy = [], dict(dx), dict(dy)
    while True:
        best = min(((-(dx[x] + dy[y] - 2 * ((x, y) in close)), x, y) for x in dx for y in dy), default=None)
        if best is None or best[0] >= 0:
            return out
        out.append((best[1], best[2], -best[0]))
        del dx[best[1]], dy[best[2]]


def made(seed):
    r = random.Random(seed)
    spread = r.choice([0, 1, 2, 6, 30])
    n, m = r.randint(0, 60), r.randint(0, 60)
    ids = r.sample(range(1000), n + m)
    dx, dy = {v: r.randint(-1, spread) for v in ids[:n]}, {v: r.randint(-1, spread) for v in ids[n:]}
    share = r.choice([0, 0.02, 0.1, 0.5, 0.95, 1])
    close = {(x, y) for x in dx for y in dy if r.random() < share}
    if r.random() < 0.3:  # chains of neighbours of like rank
        a, b = ([v for _, v in sorted((-d[v], v) for v in d)] for d in (dx, dy))
        close |= {(x, y) for x, y in zip(a, b)} | {(x, y) for x, y in zip(a[1:], b)}  # noqa: B905
    return dx, dy, close


def by_blocks(dx, dy, close, size, margin):
    """What `greedy_pairs` does, without Spark."""
    sides = [sorted((-d[v], v) for v in d) for d in (dx, dy)]
    xs, ys = ([v for _, v in s] for s in sides)
    ranks = {(xs.index(x), ys.index(y)) for x, y in close}
    at, out = 0, []
    k = min(len(xs), len(ys))
    while at < k:
        low = at // size * size
        top = low + size + margin
        near = {}
        for i, j in ranks:
            if low <= i < top and low <= j < top and abs(i - j) <= margin:
                near.setdefault(i - low, set()).add(j - low)
        ends = [np.array(a, np.int64) for s in sides for a in ([v for _, v in s[low:top]], [-d for d, _ in s[low:top]])]
        pairs, _, end = matching.walk(*ends, near, at - low, size, top < len(xs), top < len(ys), margin)
        for p in pairs:
            out += [(int(ends[0][i]), int(ends[2][j]), int(g)) for i, j, g, _ in p.T]
        if end is None:
            break
        at = end + low
    return out


@pytest.mark.parametrize("seed", range(300))
def test_blocks_match_plain_search(seed):
    dx, dy, close = made(seed)
    want = sorted(plain(dx, dy, close))
    assert sorted(by_blocks(dx, dy, close, 1000, 1000)) == want
    for size, margin in ((4, 4), (8, 6), (16, 16), (32, 24)):
        try:
            got = by_blocks(dx, dy, close, size, margin)
        except matching.Short:
            continue
        assert sorted(got) == want


def test_many_blocks_suffice_on_sparse_sides():
    """A block of eight ranks decides most sides with few neighbours."""
    done = 0
    for seed in range(60):
        r = random.Random(seed)
        dx, dy = {v: r.randint(0, 3) for v in range(100)}, {v: r.randint(0, 3) for v in range(100, 200)}
        close = {(x, y) for x in dx for y in dy if r.random() < 0.02}
        try:
            assert sorted(by_blocks(dx, dy, close, 16, 16)) == sorted(plain(dx, dy, close))
            done += 1
        except matching.Short:
            pass
    assert done > 40


@pytest.mark.parametrize(("seed", "block", "margin"), [(1, 8, 8), (2, 16, 4), (3, 8, 2), (4, 1 << 16, 1 << 10)])
def test_greedy_pairs(spark, seed, block, margin):
    """Three pairs of parts at once, over blocks so small that some are gone through again or made larger."""
    r = random.Random(seed)
    d, edges, want = [], [], []
    for k, share in enumerate((0.0, 0.03, 0.3)):
        ids = r.sample(range(1000 * k, 1000 * k + 1000), 170)
        dx, dy = {v: r.randint(-2, 5) for v in ids[:90]}, {v: r.randint(-2, 5) for v in ids[90:]}
        close = [(x, y) for x in dx for y in dy if r.random() < share]
        d += [(2 * k, 2 * k + 1, v, 2 * k + s, x) for s, side in enumerate((dx, dy)) for v, x in side.items()]
        edges += close + [(y, x) for x, y in close] + close[:5]
        want += [(2 * k, 2 * k + 1, *p) for p in plain(dx, dy, set(close))]
    d.append((6, 7, 5000, 6, 3))
    df = spark.createDataFrame(d, "a int, b int, v long, part int, d long")
    got = matching.greedy_pairs(df, spark.createDataFrame(edges, "src long, dst long"), block, margin)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_greedy_pairs_of_nothing(spark):
    d = spark.createDataFrame([], "a int, b int, v long, part int, d long")
    assert matching.greedy_pairs(d, spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_block_holds_only_links_within_the_margin(spark, monkeypatch):
    n, held, run = 8000, [], matching._run

    def seen(rows, links, sizes, *rest):
        held.append((links.count(), rest[1]))
        return run(rows, links, sizes, *rest)

    monkeypatch.setattr(matching, "_run", seen)
    d = spark.range(2 * n).select(F.lit(0).alias("a"), F.lit(1).alias("b"), F.col("id").alias("v"), (F.col("id") % 2).cast("int").alias("part"), F.lit(5).cast("long").alias("d"))
    # Each vertex has four neighbours on the other side; only one in a hundred lies at its own rank.
    links = spark.range(n).select((2 * F.col("id")).alias("src"), F.explode(F.expr("array(id + if(id % 100 = 0, 0, 2000), id + 3000, id + 4000, id + 5000)")).alias("k")).select("src", (2 * (F.col("k") % n) + 1).alias("dst"))
    got = {(r["x"], r["y"]): r["gain"] for r in matching.greedy_pairs(d, links).collect()}
    near = {(r["src"] // 2, r["dst"] // 2) for r in links.collect()}
    want = [(i, i + 1 - 2 * (i % 100) if i % 100 < 2 else i) for i in range(n)]
    assert not any(p in near for p in want) and got == {(2 * i, 2 * j + 1): 10 for i, j in want}
    assert sum(h for h, _ in held) == n // 100
