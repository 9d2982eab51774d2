"""Refinement of pairs of parts by exchanging boundary vertices.

For a pair (a, b), a < b, E(v) counts the entries that reach v from the partner part and
D(v) = 2 E(v) - deg(v). The gain of a pair (x in a, y in b) is D(x) + D(y), less 2 if y is a neighbour
of x. Gains do not change inside a pair of parts (`static`), so taking the best pair again and again is
a matching in a fixed order, which is spread over tasks by rank (see `matching`). Where gains follow the
exchanges (`dynamic`), each depends on the one before, and a pair of parts is one grouped task over the D
values of its boundary, which takes entries of a block of vertices after the other; `window` bounds it. D values come out of counts that are kept up to date while
vertices move (see `counts`).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import check_parts
from . import counts
from .matching import MORE, greedy_pairs
from .metrics import degree, placed
from .rank import Bucketed, bucketed, buckets, ranked, saved

MODES = ("none", "static", "dynamic")
#: Vertices of one side that are sent to all tasks to be paired.
_FEW = 100_000
#: Vertices of each side whose entries a task holds where gains follow the exchanges.
_BLOCK = 1 << 16
_STEPS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("step", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("gain", pa.int64())])


def pair_schedule(spark: SparkSession, k: int, rounds: bool = False) -> DataFrame:
    """All pairs of parts as (step, a, b): one by one in lexicographic order, or in rounds of disjoint pairs."""
    check_parts(k)
    if not rounds:
        pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "step int, a int, b int")
    return spark.createDataFrame([(s, a, b) for s, r in enumerate(disjoint_rounds(k)) for a, b in r], "step int, a int, b int")


def disjoint_rounds(k: int) -> list[list[tuple[int, int]]]:
    """The circle method: k - 1 rounds (k for odd k) in which no part comes twice."""
    ring = list(range(k)) + [-1] * (k % 2)
    rounds = []
    for _ in range(len(ring) - 1):
        pairs = [tuple(sorted(p)) for p in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True)]
        rounds.append(sorted(p for p in pairs if p[0] >= 0))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


def d_values(edges: DataFrame, assignment: DataFrame, pairs: Iterable[tuple[int, int]], kind: str = "all", degrees: DataFrame | None = None) -> DataFrame:
    """(a, b, v, part, deg, ext, d) of the boundary vertices of disjoint or single pairs of parts.

    `kind` all: D = 2E - deg, entries to third parts count as internal. `pair`: D = E - I, where I
    counts entries from the vertex's own part. `degrees` spares counting them again.
    """
    if kind not in ("all", "pair"):
        raise ValueError("kind must be 'all' or 'pair'")
    spark = edges.sparkSession
    wanted = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a int, b int")
    inside = placed(edges, assignment)
    low, high = F.least("ps", "pd"), F.greatest("ps", "pd")
    cut = inside.where("ps <> pd").select(low.alias("a"), high.alias("b"), F.col("dst").alias("v"), F.col("pd").alias("part"))
    ext = cut.join(F.broadcast(wanted), ["a", "b"]).groupBy("a", "b", "v", "part").agg(F.count(F.lit(1)).alias("ext"))
    rows = ext.join(degree(edges) if degrees is None else degrees, "v", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    if kind == "pair":
        own = inside.where("ps = pd").groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("own"))
        rows = rows.join(own, "v", "left").withColumn("d", F.col("ext") - F.coalesce("own", F.lit(0)))
    else:
        rows = rows.withColumn("d", 2 * F.col("ext") - F.col("deg"))
    return rows.select("a", "b", "v", "part", "deg", "ext", "d")


def pair_gains(edges: DataFrame, assignment: DataFrame, a: int, b: int, limit: int = 100) -> DataFrame:
    """The best exchanges of one pair of parts: (x, y, gain), best gain first, then smallest x and y.

    Adjacency lowers a gain by 2 only, so no vertex whose D is more than 2 under that of the `limit`-th
    of its side is in one of the best pairs; and of equal D only the first by id count, as many as
    `limit` and the neighbours that one partner can have on this side, over entries x -> y. Both sides are cut to that before they are paired.
    """
    d = saved(d_values(edges, assignment, [(a, b)]))
    xs = d.where(F.col("part") == min(a, b)).select(F.col("v").alias("x"), F.col("d").alias("dx"))
    ys = d.where(F.col("part") == max(a, b)).select(F.col("v").alias("y"), F.col("d").alias("dy"))

    close = saved(edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(2).alias("c")).distinct().join(xs.select("x"), "x", "left_semi").join(ys.select("y"), "y", "left_semi"))

    def best(side: DataFrame, v: str, dv: str, partner: str) -> DataFrame:
        most = limit + (close.groupBy(partner).count().agg(F.max("count")).first()[0] or 0)
        edge = side.orderBy(F.desc(dv), v).limit(limit).agg(F.min(dv)).first()[0]
        near = side.where(F.col(dv) >= (edge or 0) - 2)
        return near.withColumn("rank", F.row_number().over(W.partitionBy(dv).orderBy(v))).where(F.col("rank") <= most).drop("rank")

    left, right = best(xs, "x", "dx", "y"), best(ys, "y", "dy", "x")
    # Few on one side are sent to all tasks; otherwise Spark deals the two sides into blocks.
    pairs = left.crossJoin(F.broadcast(right) if right.limit(_FEW + 1).count() <= _FEW else right)
    gains = pairs.join(close, ["x", "y"], "left").select("x", "y", (F.col("dx") + F.col("dy") - F.coalesce("c", F.lit(0))).cast("long").alias("gain"))
    return gains.orderBy(F.desc("gain"), "x", "y").limit(limit)


class Side:
    """The free vertices of one side by D: for each value their ids in order, and a moving list of values, largest first."""

    def __init__(self, d: dict[int, int]):
        self.d, self.ids = dict(d), defaultdict(list)
        for v in sorted(d):
            self.ids[d[v]].append(v)
        self.values = sorted(self.ids)

    def take(self, v: int) -> None:
        value = self.d.pop(v)
        ids = self.ids[value]
        del ids[bisect_left(ids, v)]
        if not ids:
            del self.ids[value], self.values[bisect_left(self.values, value)]

    def change(self, v: int, by: int) -> None:
        value = self.d[v] + by
        self.take(v)
        self.d[v] = value
        if value not in self.ids:
            insort(self.values, value)
        insort(self.ids[value], v)


def best_pair(xs: Side, ys: Side, near: dict[int, set[int]]) -> tuple[int, int, int] | None:
    """(loss, x, y) of the best free pair: the largest gain, then the smallest x, then y. Only the vertices of the largest values are looked at, and further ones as far as neighbours are passed over."""
    found = None
    top = ys.values[-1] if ys.values else 0
    for value in reversed(xs.values if ys.values else []):
        if found is not None and -value - top > found[0]:
            break
        for x in xs.ids[value]:
            if found is not None and (-value - top, x) > found[:2]:
                break
            mine, done = near.get(x, ()), False
            for other in reversed(ys.values):
                if done or found is not None and -value - other > found[0]:
                    break
                for y in ys.ids[other]:
                    adjacent = y in mine
                    one = (-value - other + 2 * adjacent, x, y)
                    found = one if found is None or one < found else found
                    if not adjacent:
                        done = True
                        break
    return found if found is not None and found[0] < 0 else None


def dynamic_steps(xs: Side, ys: Side, near: Mapping[int, set[int]], entries: Callable[[int], Iterable[tuple[int, int]]], known: Callable[[int], bool]) -> Iterator[tuple[int, int, int]]:
    """Repeatedly takes the best free pair of positive gain, (x, y, gain), out of the two sides, and changes D by 2 for each entry between a vertex and the two that moved.

    Stops where the best pair has a vertex that is not `known`. Without its neighbours such a vertex only
    looks better than it is, so a pair of known ones that is best is best in truth. `entries` gives the
    (vertex, entries) that a known vertex reaches, `near` the neighbours of a known x.
    """
    while (found := best_pair(xs, ys, near)) is not None:
        loss, x, y = found
        if not (known(x) and known(y)):
            return
        xs.take(x)
        ys.take(y)
        for side, same, other in ((xs, x, y), (ys, y, x)):
            changes: dict[int, int] = defaultdict(int)
            for u, sign in ((same, 2), (other, -2)):
                for v, n in entries(u):
                    if v in side.d:
                        changes[v] += sign * n
            for v, by in changes.items():
                if by:
                    side.change(v, by)
        yield x, y, -loss


def greedy_dynamic(dx: dict[int, int], dy: dict[int, int], near: dict[int, set[int]], weight: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """The exchanges of `dynamic_steps` where all vertices are known; `weight` counts entries (u, v) between boundary vertices of the two parts."""
    linked: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (u, v), n in weight.items():
        linked[u].append((v, n))
    return list(dynamic_steps(Side(dx), Side(dy), near, lambda u: linked.get(u, ()), lambda v: True))


class Entries:
    """Entries between boundary vertices in arrays, in order of their sources; `get` gives the neighbours of one."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.sources, self.first = np.unique(src[order], return_index=True)
        self.last = np.append(self.first[1:], len(src))
        self.dst, self.n = dst[order], n[order]
        self.sets = lru_cache(256)(lambda v: frozenset(self.dst[self.at(v)].tolist()))

    def at(self, v: int) -> slice:
        i = int(np.searchsorted(self.sources, v))
        return slice(self.first[i], self.last[i]) if i < len(self.sources) and self.sources[i] == v else slice(0, 0)

    def of(self, v: int) -> Iterable[tuple[int, int]]:
        at = self.at(v)
        return zip(self.dst[at].tolist(), self.n[at].tolist(), strict=True)

    def get(self, v: int, default: object = ()) -> frozenset[int]:
        return self.sets(v)


def _dynamic(d: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """(a, b, step, x, y, gain) of exchanges whose gains follow them.

    Each depends on the one before, so a pair of parts is matched in one task, which holds the D values of
    its boundary, but the entries of only `block` vertices of each side: those of the largest D, which are
    next to move. It stops at the first exchange of another vertex and leaves the D values of what is free, out of which
    the next ones are taken. Where that comes before any exchange, blocks grow.
    """
    spark, runs, done = edges.sparkSession, [], Counter()
    while True:
        if (d.groupBy("a", "b", "part").count().agg(F.max("count")).first()[0] or 0) > block:
            rows = ranked(d.select("a", "b", "part", (-F.col("d")).alias("low"), "v"), "a", "b", "part", "low", "v", name="at")
            first = rows.groupBy("a", "b", "part").agg(F.min("at").alias("start"))
            top = saved(rows.join(F.broadcast(first), ["a", "b", "part"]).where(F.col("at") - F.col("start") < block).select("a", "b", "v"))  # two rows for each pair of parts
        else:
            top = d.select("a", "b", "v")
        links = saved(edges.join(top.withColumnRenamed("v", "src"), "src").join(d.select("a", "b", F.col("v").alias("dst")), ["a", "b", "dst"]).groupBy("a", "b", "src", "dst").agg(F.count(F.lit(1)).alias("n")))
        own = d.join(top.withColumn("known", F.lit(True)), ["a", "b", "v"], "left").select("a", "b", "v", "part", "d", F.coalesce("known", F.lit(False)).alias("known"))
        before = dict(done)

        def match(own: pa.Table, links: pa.Table) -> pa.Table:
            a, b = own.column("a")[0].as_py(), own.column("b")[0].as_py()
            v, part, x, loaded = (own.column(c).to_numpy() for c in ("v", "part", "d", "known"))
            xs, ys = (Side(dict(zip(v[part == p].tolist(), x[part == p].tolist(), strict=True))) for p in (a, b))
            known = set(v[loaded].tolist())
            entries = Entries(*(links.column(c).to_numpy() for c in ("src", "dst", "n")))
            start = before.get((a, b), 0)
            out = [(a, b, start + i, *one) for i, one in enumerate(dynamic_steps(xs, ys, entries, entries.of, known.__contains__))]
            if best_pair(xs, ys, entries) is not None:
                out += [(a, b, None, v, p, x) for p, side in ((a, xs), (b, ys)) for v, x in side.d.items()]  # what is free: the vertex, its part and D
            return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(_STEPS.types)], schema=_STEPS)

        found = saved(own.groupBy("a", "b").cogroup(links.groupBy("a", "b")).applyInArrow(match, "a int, b int, step int, x long, y long, gain long"))
        runs.append(found.where("step is not null"))
        counted = found.groupBy("a", "b").agg(F.count("step").alias("steps"), F.count(F.lit(1)).alias("n")).collect()  # a row for each pair of parts
        for r in counted:
            done[r["a"], r["b"]] += r["steps"]
        if all(r["steps"] == r["n"] for r in counted):
            break
        if any(r["steps"] == 0 for r in counted):
            block *= MORE
        d = found.where("step is null").select("a", "b", F.col("x").alias("v"), F.col("y").cast("int").alias("part"), F.col("gain").alias("d"))
    for r in runs[1:]:
        runs[0] = runs[0].unionAll(r)
    return runs[0]


def _window(d: DataFrame, size: int, nth: int = 0) -> DataFrame:
    """The `nth` window of `size` vertices, by id, of each side of each pair of parts; the last window again where there are no more."""
    rows = ranked(d, "a", "b", "part", "v", name="at")
    first = rows.groupBy("a", "b", "part").agg(F.min("at").alias("start"), F.expr(f"least({nth}, (count(1) - 1) div {size})").alias("nth"))
    return rows.join(F.broadcast(first), ["a", "b", "part"]).where(F.expr(f"(at - start) div {size} = nth")).drop("at", "start", "nth")  # two rows for each pair


def exchanges(d: DataFrame, edges: DataFrame, mode: str = "static", window: int | None = None, block: int | None = None, nth: int = 0) -> DataFrame:
    """(a, b, x, y, gain) of pairs of parts out of the D values of their boundaries; `dynamic` has the step in its pair as well. `window` takes the `nth` window of so many vertices of each side; `block` is how many ranks of a boundary one task matches, and in `dynamic` how many vertices of a side a task holds the entries of."""
    if window is not None:
        d = _window(d, window, nth)
    if mode == "static":
        return greedy_pairs(d, edges, *([] if block is None else [block, block]))
    return _dynamic(d.select("a", "b", "v", "part", "d"), edges, block or _BLOCK)


def swaps(edges: DataFrame, assignment: DataFrame, pairs: list[tuple[int, int]], mode: str = "static", window: int | None = None, kind: str = "all", degrees: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Exchanges of disjoint pairs of parts in their order: (a, b, step, x, y, gain). `window` keeps the first ids of each side only; `block` is how many ranks of a boundary one task matches."""
    found = exchanges(saved(d_values(edges, assignment, pairs, kind, degrees)), edges, mode, window, block)
    if mode != "static":
        return found
    # Gains only fall, so the order of the exchanges is that of their gains.
    rows = ranked(found.select("a", "b", (-F.col("gain")).alias("loss"), "x", "y"), "a", "b", "loss", "x", "y", name="at")
    first = rows.groupBy("a", "b").agg(F.min("at").alias("start"))
    return rows.join(F.broadcast(first), ["a", "b"]).select("a", "b", (F.col("at") - F.col("start")).cast("int").alias("step"), "x", "y", (-F.col("loss")).alias("gain"))  # a row for each pair


def apply_swaps(assignment: DataFrame, found: DataFrame) -> DataFrame:
    """The assignment after x moved to b and y to a."""
    moved = found.select(F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("b").alias("new")), F.struct(F.col("y").alias("v"), F.col("a").alias("new")))).alias("m")).select("m.*")
    return assignment.join(moved, "v", "left").select("v", F.coalesce("new", "part").cast("int").alias("part"))


def refined_state(edges: DataFrame, assignment: DataFrame, k: int, mode: str = "static", schedule: str = "sequence", window: int | None = None, kind: str = "all", accept: str = "always", cursor: bool = False) -> Bucketed:
    """The state (see `counts`) after all pairs of parts were refined, one by one or in rounds of disjoint pairs.

    With `cursor`, step s takes window s of each boundary and not the first one again.

    Each step is kept as a table, so that the plan does not grow with the number of pairs, and goes once
    the next one is there.
    """
    check_parts(k)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if kind not in ("all", "pair"):
        raise ValueError("kind must be 'all' or 'pair'")
    steps = disjoint_rounds(k) if schedule == "rounds" else [[(a, b)] for a in range(k) for b in range(a + 1, k)]
    n = buckets(edges)
    if mode == "none":
        return counts.count_entries(edges, assignment, n)
    links = bucketed(edges.select("src", "dst"), "src", n=n)
    state = counts.count_entries(links.rows, assignment, n)
    cut = counts.cut_entries(state.rows).first()["cut_entries"] if accept == "improve" else None
    for step, pairs in enumerate(steps):
        found = exchanges(counts.d_values(state.rows, pairs, kind), links.rows, mode, window, nth=step if cursor else 0)
        one = lambda v, old, new: F.struct(F.col(v).alias("v"), F.col(old).alias("old"), F.col(new).alias("new"))
        moved = saved(found.select(F.explode(F.array(one("x", "a", "b"), one("y", "b", "a"))).alias("m")).select("m.*"))
        if moved.isEmpty():
            continue
        after = counts.move(state, links, moved)
        if accept == "improve":
            now = counts.cut_entries(after.rows).first()["cut_entries"]
            if now >= cut:
                after.drop()
                continue
            cut = now
        state.drop()
        state = after
    links.drop()
    return state


def refine(edges: DataFrame, assignment: DataFrame, k: int, mode: str = "static", schedule: str = "sequence", window: int | None = None, kind: str = "all", accept: str = "always", cursor: bool = False) -> DataFrame:
    """The assignment after all pairs of parts were refined, one by one or in rounds of disjoint pairs.

    Modes: `none` leaves it alone, `static` keeps gains while a pair is refined, `dynamic` updates them.
    `accept='improve'` drops a step after which the cut is not smaller. `window` bounds each side of a step
    to so many vertices, the first ones, or with `cursor` those of the step's own window.
    """
    if mode == "none":
        check_parts(k)
        return assignment
    return refined_state(edges, assignment, k, mode, schedule, window, kind, accept, cursor).rows.select("v", "part")
