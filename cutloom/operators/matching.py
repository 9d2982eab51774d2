"""The greedy matching of two sides of a pair of parts, spread over many tasks.

The best free pair is taken again and again: the largest d(x) + d(y), less 2 where y is a neighbour of x,
ties to the smallest x and then y. If both sides are put in order of d, largest first, and then of id, and
no two of them are neighbours, the i-th of one side gets the i-th of the other. A neighbour only matters
where the two would have met: there the order slips, for as long as it takes until all that were passed
over are taken. Then both sides stand at the same rank again, and nothing before that rank matters any
more.

So every task takes a block of ranks, as if both sides stood at its first one, and goes on into the next
block until they do. Where that is not where the next block began, the next block was right all the same
from there on, if both sides stood there in it too; otherwise it is gone through again from the right
rank. What a task holds is bounded by the block; only a slip that does not end within a block's margin
makes blocks larger.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import ranked, saved

#: Ranks of a block, and of its margin, in the first attempt; each further one takes as many times more.
BLOCK, MARGIN, MORE = 1 << 16, 1 << 10, 16
#: Pairs of parts with so many vertices a side at most are put in order where they are matched.
_WHOLE = 1 << 12


class Short(Exception):
    """The window does not decide which pair is best."""


class Near:
    """Neighbours of ranks of x among ranks of y, as two sorted arrays; a rank's are made a set where they are asked for."""

    def __init__(self, i: np.ndarray, j: np.ndarray):
        order = np.argsort(i, kind="stable")
        self.i, self.j = i[order], j[order]
        self.conflicts = np.unique(i[i == j]).tolist()

    def get(self, i: int, default: object = ()) -> set[int] | object:
        low, high = np.searchsorted(self.i, (i, i + 1))
        return set(self.j[low:high].tolist()) if high > low else default


def slip(x: list[int], dx: list[int], y: list[int], dy: list[int], near: Near | dict[int, set[int]], r: int, m: int, n: int, more_x: bool, more_y: bool) -> tuple[list[tuple[int, int, int]], int | None]:
    """Pairs (rank of x, rank of y, gain) from rank r, where both sides stand, to the next such rank; None if no gain is left.

    The sides are known up to the ranks m and n; `more_x` and `more_y` say whether they go on. Raises
    `Short` where what lies beyond could be in the best pair. The best of each x waits in a heap and is
    sought again once it is on top and its y is gone, as a pair only gets worse while y's are taken.
    """
    after = list(range(n + 1 - r))

    def free(j: int) -> int:
        while after[j] != j:
            after[j] = after[after[j]]
            j = after[j]
        return j

    def best(i: int) -> tuple[int, int, int, int, int] | None:
        """(loss, x, y, ranks) of the best for x, y and its rank -1 where it may lie beyond."""
        mine, found, j = near.get(i, ()), None, free(0)
        while j < n - r:
            adjacent = r + j in mine
            one = (-dx[i] - dy[r + j] + 2 * adjacent, x[i], y[r + j], i, r + j)
            found = one if found is None or one < found else found
            if not adjacent or -dx[i] - dy[r + j] > found[0]:
                break
            j = free(j + 1)
        else:
            if more_y and (found is None or -dx[i] - dy[n - 1] <= found[0]):
                found = (-dx[i] - dy[n - 1], x[i], -1, i, -1)
        return found if found is not None and found[0] < 0 else None

    heap = [p for i in range(r, m) if (p := best(i)) is not None]
    heapify(heap)
    pairs, taken, at_x, at_y = [], set(), r, r
    while heap:
        loss, v, _, i, j = heap[0]
        if j < 0:
            raise Short
        first = r + free(0)
        if more_x and first < n and (-dx[m - 1] - dy[first], x[m - 1]) < (loss, v) or more_y and first >= n:
            raise Short
        if after[j - r] == j - r:
            heappop(heap)
            after[j - r] += 1
            taken.add(i)
            pairs.append((i, j, -loss))
            while at_x in taken:
                at_x += 1
            at_y = r + free(0)
            if at_x == at_y == r + len(pairs):
                return pairs, at_x
        elif (p := best(i)) is not None:
            heapreplace(heap, p)
        else:
            heappop(heap)
    first = r + free(0)
    if more_y and first >= n or more_x and first < n and dx[m - 1] + dy[first] > 0:
        raise Short
    return pairs, None


def walk(x: np.ndarray, dx: np.ndarray, y: np.ndarray, dy: np.ndarray, near: Near | dict[int, set[int]], start: int, size: int, more_x: bool, more_y: bool, reach: int) -> tuple[list[np.ndarray], list[tuple[int, int]], int | None]:
    """Pairs from rank `start`, where both sides stand, to the first such rank of `size` or more.

    `near` has the neighbours of each rank of x among the ranks of y, as far as `reach` away. Returns
    pairs as arrays (ranks of x and y, gain, rank where both sides stood last), the slips (first rank,
    rank after) and the last rank, None if no gain is left. Raises `Short` if a slip goes too far.
    """
    k = min(len(x), len(y))
    gainful = int(np.count_nonzero(dx[:k] + dy[:k] > 0))  # d only falls, so these are the first ranks
    conflicts = near.conflicts if isinstance(near, Near) else sorted(i for i, js in near.items() if i in js)
    lists = [a.tolist() for a in (x, dx, y, dy)]
    pairs, slips, r = [], [], start
    while r < size:
        c = bisect_left(conflicts, r)
        stop = min(conflicts[c] if c < len(conflicts) else k, gainful, max(size, r))
        if stop > r:
            ranks = np.arange(r, stop)
            pairs.append(np.stack([ranks, ranks, dx[r:stop] + dy[r:stop], ranks]))
            r = stop
            continue
        if r >= gainful:
            if r >= k and (len(x) == k and more_x or len(y) == k and more_y):
                raise Short
            return pairs, slips, None
        width = 16
        while True:
            m, n = min(len(x), r + width), min(len(y), r + width)
            beyond_x, beyond_y = more_x or m < len(x), more_y or n < len(y)
            try:
                if width > reach and (beyond_x or beyond_y or max(m, n) - r > reach):
                    raise Short
                found, end = slip(*lists, near, r, m, n, beyond_x, beyond_y)
                break
            except Short:
                if m == len(x) and n == len(y) or width > reach:
                    raise
                width *= 4
        if found:
            pairs.append(np.array([(i, j, g, r) for i, j, g in found]).T)
        if end is None:
            return pairs, slips, None
        slips.append((r, end))
        r = end
    return pairs, slips, r


_OUT = "a int, b int, block long, kind int, x long, y long, gain long, at long"
_SCHEMA = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("gain", pa.int64()), ("at", pa.int64())])
#: Kinds of rows: a pair, a slip near the beginning of a block (x to y), the end of a block (x: rank, -1 if no gain is left, -2 if it was too short).
_PAIR, _SLIP, _END = range(3)


def _sides(d: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]]]:
    """(a, b, side, rank, v, d) in order of d, largest first, and id, and how many each side of each pair has."""
    rows = ranked(d.select("a", "b", "side", (-F.col("d")).alias("low"), "v"), "a", "b", "side", "low", "v", name="at")
    starts = rows.groupBy("a", "b", "side").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")).collect()  # two rows for each pair of parts
    sizes: dict[tuple[int, int], tuple[int, int]] = {}
    for s in starts:
        n = [*sizes.get((s["a"], s["b"]), (0, 0))]
        n[s["side"]] = s["n"]
        sizes[s["a"], s["b"]] = tuple(n)
    first = d.sparkSession.createDataFrame([tuple(s)[:4] for s in starts], "a int, b int, side int, start long")
    rows = rows.join(F.broadcast(first), ["a", "b", "side"]).select("a", "b", "side", (F.col("at") - F.col("start")).alias("rank"), "v", (-F.col("low")).alias("d"))
    return rows, sizes


def _blocks(rank: Column, size: int, margin: int) -> Column:
    """The block of a rank, and the one before where the rank lies in its margin."""
    own = F.floor(rank / size)
    return F.explode(F.when((rank % size < margin) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own)))


def _run(rows: DataFrame, links: DataFrame, sizes: dict[tuple[int, int], tuple[int, int]], size: int, margin: int, whole: bool, starts: dict[tuple[int, int, int], int] | None) -> DataFrame:
    """One pass over all blocks, or over those of `starts` from the ranks given there; `whole` if `links` are all of them, and not those within the margin."""
    sides = rows.select("a", "b", _blocks(F.col("rank"), size, margin).alias("block"), "side", F.col("rank").alias("i"), F.col("v").alias("j"), "d")
    near = links.select("a", "b", _blocks(F.least("i", "j"), size, margin).alias("block"), F.lit(2).alias("side"), "i", "j", F.lit(0).cast("long").alias("d"))
    both = sides.unionAll(near)
    if starts is not None:
        wanted = rows.sparkSession.createDataFrame([(a, b, k) for a, b, k in starts], "a int, b int, block long")
        both = both.join(F.broadcast(wanted), ["a", "b", "block"], "left_semi")  # blocks that did not begin right

    def go(table: pa.Table) -> pa.Table:
        a, b, block = (table.column(c)[0].as_py() for c in ("a", "b", "block"))
        if (a, b) not in sizes:  # one side is empty
            return _SCHEMA.empty_table()
        side, i, j, d = (table.column(c).to_numpy() for c in ("side", "i", "j", "d"))
        low = block * size
        ends = []
        for s in (0, 1):
            mine = np.flatnonzero(side == s)
            mine = mine[np.argsort(i[mine])]
            ends += [j[mine], d[mine]]
        near = Near(i[side == 2] - low, j[side == 2] - low)
        nx, ny = sizes[a, b]
        more = low + len(ends[0]) < nx, low + len(ends[2]) < ny
        start = low if starts is None else starts[a, b, block]
        reach = max(margin, nx, ny) if whole else margin
        out: list[tuple] = []
        try:
            pairs, slips, end = walk(*ends, near, start - low, size, *more, reach)
            p = np.concatenate(pairs, axis=1) if pairs else np.zeros((4, 0), np.int64)
            out = [(_SLIP, u + low, v + low, 0, 0) for u, v in slips if u < margin] + [(_END, -1 if end is None else end + low, 0, 0, start)]
        except Short:
            p, out = np.zeros((4, 0), np.int64), [(_END, -2, 0, 0, start)]
        n = p.shape[1] + len(out)
        columns = [np.concatenate([c, np.array(o, np.int64)]) for c, o in zip((np.full(p.shape[1], _PAIR), ends[0][p[0]], ends[2][p[1]], p[2], p[3] + low), zip(*out, strict=True), strict=True)]
        return pa.table([pa.array(np.full(n, x), t.type) for x, t in zip((a, b, block), _SCHEMA, strict=False)] + [pa.array(c, t.type) for c, t in zip(columns, list(_SCHEMA)[3:], strict=True)], schema=_SCHEMA)

    return both.groupBy("a", "b", "block").applyInArrow(go, _OUT)


def _chain(size: int, sizes: dict, ends: dict, slips: dict) -> tuple[dict, dict]:
    """Where each block is entered, and the blocks that were not entered where both sides stood in their run."""
    entered, again = {}, {}
    for (a, b), (nx, ny) in sizes.items():
        at = 0
        for block in range(-(-min(nx, ny) // size)):
            if at >= (block + 1) * size:
                continue
            begun, end = ends[a, b, block]
            if at < begun or any(u < at < v for u, v in slips.get((a, b, block), ())):
                again[a, b, block] = at
                break
            entered[a, b, block] = at
            if end < 0:
                break
            at = end
    return entered, again


def _whole(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The matching of pairs whose sides fit into a block each: they are put in order where they are matched."""
    both = rows.select("a", "b", "side", F.col("v").alias("i"), F.lit(0).cast("long").alias("j"), "d").unionAll(links.select("a", "b", F.lit(2), F.col("x"), F.col("y"), F.lit(0).cast("long")))

    def go(table: pa.Table) -> pa.Table:
        a, b = (table.column(c)[0].as_py() for c in ("a", "b"))
        side, i, j, d = (table.column(c).to_numpy() for c in ("side", "i", "j", "d"))
        ends = []
        for s in (0, 1):
            mine = np.flatnonzero(side == s)
            mine = mine[np.lexsort((i[mine], -d[mine]))]
            ends += [i[mine], d[mine]]
        order = [np.argsort(ends[s]) for s in (0, 2)]
        near = Near(*(at[np.searchsorted(v, w[side == 2], sorter=at)] for at, v, w in zip(order, (ends[0], ends[2]), (i, j), strict=True)))
        n = max(len(ends[0]), len(ends[2]))
        pairs, _, _ = walk(*ends, near, 0, n + 1, False, False, n)
        p = np.concatenate(pairs, axis=1) if pairs else np.zeros((4, 0), np.int64)
        columns = np.full(p.shape[1], a), np.full(p.shape[1], b), ends[0][p[0]], ends[2][p[1]], p[2]
        return pa.table([pa.array(c, t.type) for c, t in zip(columns, _PAIRS, strict=True)], schema=_PAIRS)

    return both.groupBy("a", "b").applyInArrow(go, "a int, b int, x long, y long, gain long")


_PAIRS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("gain", pa.int64())])


def greedy_pairs(d: DataFrame, edges: DataFrame, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """(a, b, x, y, gain): the greedy exchanges of every pair of parts (a, b) over its sides in `d` (a, b, v, part, d)."""
    spark = edges.sparkSession
    d = d.select("a", "b", (F.col("part") == F.col("b")).cast("int").alias("side"), "v", "d")
    known = d.groupBy("a", "b", "side").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("most")).collect()  # two rows for each pair of parts
    if not known:
        return spark.createDataFrame([], "a int, b int, x long, y long, gain long")
    # A vertex whose d with the other side's largest gives no gain is in no exchange.
    top = spark.createDataFrame([(k["a"], k["b"], 1 - k["side"], k["most"]) for k in known], "a int, b int, side int, most long")
    d = d.join(F.broadcast(top), ["a", "b", "side"]).where("d + most > 0").drop("most")
    left, right = (d.where(f"side = {s}").select("a", "b", F.col("v").alias(v)) for s, v in ((0, "src"), (1, "dst")))
    if max(k["n"] for k in known) <= min(block, _WHOLE):
        links = edges.join(left, "src").join(right, ["a", "b", "dst"]).select("a", "b", F.col("src").alias("x"), F.col("dst").alias("y")).distinct()
        return _whole(d, links)
    rows, sizes = _sides(d)
    sizes = {p: n for p, n in sizes.items() if min(n)}
    if not sizes:
        return spark.createDataFrame([], "a int, b int, x long, y long, gain long")
    rows = saved(rows)
    left, right = (rows.where(f"side = {s}").select("a", "b", F.col("v").alias(v), F.col("rank").alias(i)) for s, v, i in ((0, "src", "i"), (1, "dst", "j")))
    links = edges.join(left, "src").join(right, ["a", "b", "dst"]).select("a", "b", "i", "j").distinct()
    widest = max(max(n) for n in sizes.values())
    while True:
        # Only links that a slip within the margin can meet go on to tasks.
        margin = min(margin, block)
        near = saved(links.where(F.abs(F.col("i") - F.col("j")) <= margin))
        runs, ends, slips, starts, short = [], {}, {}, None, False
        while True:
            runs.append(saved(_run(rows, near, sizes, block, margin, widest <= margin, starts).withColumn("run", F.lit(len(runs)))))
            for e in runs[-1].where(F.col("kind") != _PAIR).collect():  # a row for each block, and its slips within the margin
                key = e["a"], e["b"], e["block"]
                if e["kind"] == _SLIP:
                    slips.setdefault((*key, len(runs) - 1), []).append((e["x"], e["y"]))
                else:
                    ends[key] = e["at"], e["x"], len(runs) - 1
            if any(end == -2 for _, end, _ in ends.values()):
                short = True
                break
            entered, starts = _chain(block, sizes, {k: v[:2] for k, v in ends.items()}, {k: slips[(*k, v[2])] for k, v in ends.items() if (*k, v[2]) in slips})
            if not starts:
                break
        if not short:
            break
        block, margin = block * MORE, margin * MORE
    kept = spark.createDataFrame([(*k, ends[k][2], at) for k, at in entered.items()], "a int, b int, block long, run int, enter long")
    found = runs[0]
    for r in runs[1:]:
        found = found.unionAll(r)
    found = found.where(F.col("kind") == _PAIR).join(F.broadcast(kept), ["a", "b", "block", "run"])  # a row for each block
    return found.where("at >= enter").select("a", "b", "x", "y", "gain")
