"""Vertex iteration in supersteps over a frontier of active vertices."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components as star_contraction
from .metrics import degree
from .rank import Bucketed, bucketed, saved


def activate_neighbours(edges: DataFrame, active: DataFrame) -> DataFrame:
    """The vertices that entries of active ones reach: (v)."""
    return edges.join(active.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("dst").alias("v")).distinct()


def active_count(edges: DataFrame, active: DataFrame) -> DataFrame:
    """How many activations a superstep sends: the degrees of the active vertices, targets that repeat included."""
    return degree(edges).join(active.select("v"), "v", "left_semi").agg(F.coalesce(F.sum("deg"), F.lit(0)).alias("n_active"))


def neighbour_states(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Entries with the state of their target."""
    return edges.join(state.withColumnRenamed("v", "dst"), "dst")


def neighbour_sum(edges: DataFrame, state: DataFrame, value: str = "value") -> DataFrame:
    """(v, total): the sum of a state column over all entries of a vertex."""
    return neighbour_states(edges, state).groupBy(F.col("src").alias("v")).agg(F.sum(value).alias("total"))


def superstep(edges: DataFrame, state: DataFrame, message: Column, combine: Callable[[str], Column], update: Column) -> DataFrame:
    """One step over the state (v, value, changed): changed vertices send `message` (over their state) along entries,
    `combine("message")` joins what arrives, and `update` (over the state and `message`) gives the new value. Returns the new state.

    With entries in buckets of src and the state in buckets of v, only messages are shuffled.
    """
    senders = state.where("changed").select(F.col("v").alias("src"), "value")
    arrived = edges.join(senders, "src").select(F.col("dst").alias("v"), message.alias("message")).groupBy("v").agg(combine("message").alias("message"))
    rows = state.join(arrived, "v", "left").withColumn("new", F.when(F.col("message").isNull(), F.col("value")).otherwise(update))
    return rows.select("v", F.col("new").alias("value"), (~F.col("new").eqNullSafe(F.col("value"))).alias("changed"))


def iterate(edges: DataFrame, state: DataFrame, message: Column, combine: Callable[[str], Column], update: Column, active: DataFrame | None = None, max_iter: int | None = None) -> tuple[DataFrame, int]:
    """Supersteps until no vertex changes or `max_iter`; without `active` all vertices start. Returns the state and the steps."""
    if active is None:
        rows = state.select("v", "value", F.lit(True).alias("changed"))
    else:
        rows = state.select("v", "value").join(active.select("v", F.lit(True).alias("changed")), "v", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    links, kept, steps = bucketed(edges, "src"), bucketed(rows, "v"), 0
    while max_iter is None or steps < max_iter:
        after = bucketed(superstep(links.rows, kept.rows, message, combine, update), "v", in_place=True)
        kept.drop()
        kept, steps = after, steps + 1
        if kept.rows.where("changed").isEmpty():
            break
    links.drop()
    return kept.rows.select("v", "value"), steps


#: Up to so many intervals are run round by round.
_FEW = 16
#: Ways between an interval's border vertices are sought from so many at most.
_SEEDS = 64
_REDUCED = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.int64())])
_SETTLED = pa.schema([("block", pa.int64()), ("v", pa.int64()), ("way", pa.int64()), ("changed", pa.bool_())])


def _spread(out: dict[int, list[tuple[int, int]]], way: dict[int, int], new: Iterable[int]) -> set[int]:
    """Shortens `way` over the entries `out`, from the vertices `new`, until nothing gets shorter; returns the vertices whose ways did."""
    heap, shorter = [(way[i], i) for i in new], set()
    heapify(heap)
    while heap:
        far, i = heappop(heap)
        if far > way[i]:
            continue
        for j, w in out.get(i, ()):
            if j not in way or far + w < way[j]:
                way[j] = far + w
                shorter.add(j)
                heappush(heap, (way[j], j))
    return shorter


def _settle(state: pa.Table, links: pa.Table) -> pa.Table:
    """Shortest ways inside one interval, from the vertices whose ways are new."""
    v, way, new = (state.column(c).to_pylist() for c in ("v", "way", "changed"))
    if not any(new):
        return state.select(_SETTLED.names).cast(_SETTLED)
    place = {x: i for i, x in enumerate(v)}
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for s, d, w in zip(*(links.column(c).to_pylist() for c in ("src", "dst", "w")), strict=True):
        if s in place and d in place:
            out[place[s]].append((place[d], w))
    known = {i: far for i, far in enumerate(way) if far is not None}
    for i in _spread(out, known, [i for i in range(len(v)) if new[i]]):
        way[i], new[i] = known[i], True
    return pa.table([state.column("block"), state.column("v"), pa.array(way, pa.int64()), pa.array(new, pa.bool_())], schema=_SETTLED)


def _reduce(state: pa.Table, links: pa.Table) -> pa.Table:
    """An interval by its border: the vertices that stay, without a dst, and the shortest ways from where others enter it to where they leave it.

    An interval where these ways would be more than its entries, or both sides of its border have more than
    `_SEEDS` vertices, stays as it is.
    """
    v, enters, leaves = (state.column(c).to_pylist() for c in ("v", "enters", "leaves"))
    ends = [{x for x, yes in zip(v, side, strict=True) if yes} for side in (enters, leaves)]
    inside, entries = set(v), [e for e in zip(*(links.column(c).to_pylist() for c in _REDUCED.names), strict=True)]
    entries = [e for e in entries if e[0] in inside and e[1] in inside]
    back = len(ends[1]) < len(ends[0])
    seeds, others = (ends[1], ends[0]) if back else ends
    found = None
    if len(seeds) <= _SEEDS:
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, d, w in entries:
            out[d if back else s].append((s if back else d, w))
        found = []
        for seed in seeds:
            way = {seed: 0}
            _spread(out, way, [seed])
            found += [(x, seed, far) if back else (seed, x, far) for x, far in way.items() if x in others and x != seed]
        found = found if len(found) <= len(entries) else None
    kept = inside if found is None else ends[0] | ends[1]
    rows = [(x, None, None) for x in kept] + (entries if found is None else found)
    return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=_REDUCED)


def _rounds(inside: DataFrame, across: DataFrame, start: DataFrame, max_rounds: int | None) -> tuple[Bucketed, int]:
    """The state (block, v, way, changed) after rounds of intervals and of ways that cross between them, until nothing changes."""
    kept, rounds = bucketed(start, "block"), 0
    while max_rounds is None or rounds < max_rounds:
        settled = saved(kept.rows.groupBy("block").cogroup(inside.groupBy("block")).applyInArrow(_settle, "block long, v long, way long, changed boolean").where("block is not null"))
        rounds += 1
        crossing = across.join(settled.where("changed").select(F.col("v").alias("src"), "way"), "src")
        arrived = crossing.groupBy(F.col("dst").alias("v")).agg(F.min(F.col("way") + F.col("w")).alias("new"))
        rows = settled.join(arrived, "v", "left")
        shorter = F.col("new").isNotNull() & (F.col("way").isNull() | (F.col("new") < F.col("way")))
        after = bucketed(rows.select("block", "v", F.when(shorter, F.col("new")).otherwise(F.col("way")).alias("way"), shorter.alias("changed")), "block")
        kept.drop()
        kept = after
        if kept.rows.where("changed").isEmpty():
            break
    return kept, rounds


def shortest_ways(edges: DataFrame, ids: DataFrame, source: int, width: int = 1 << 16, max_rounds: int | None = None) -> tuple[DataFrame, int]:
    """(v, way) of the vertices that are reached over entries (src, dst, w) of weights of 0 or more, and the rounds.

    Vertices lie in intervals of `width` ids. In a round every interval that got shorter ways is run to its
    own fixed point in one task, and then ways cross to other intervals; so there are as many rounds as
    intervals that the longest shortest way enters, not as it has steps. A task holds an interval's
    vertices and the entries inside it.

    Many intervals are first reduced to their borders, all in one round, and what is left is dealt to wider
    intervals that hold about as many vertices as before, until they are few. Rounds then run over
    these, and a round for each reduction carries ways from the borders back inside. Without `max_rounds` the
    rounds therefore grow with the logarithm of the number of intervals, where most vertices are no border;
    where over half stay, nothing is reduced.
    """
    block = lambda c, at: F.floor(F.col(c) / at).alias("block")
    links, vertices, levels, passes = edges.select("src", "dst", F.col("w").cast("long").alias("w")), ids.select("v"), [], 0
    while True:
        same = F.floor(F.col("src") / width) == F.floor(F.col("dst") / width)
        inside = bucketed(links.where(same).groupBy("src", "dst").agg(F.min("w").alias("w")).select(block("src", width), "src", "dst", "w"), "block")
        across = bucketed(links.where(~same), "src")
        n, intervals = vertices.groupBy(block("v", width)).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
        if max_rounds is not None or intervals <= _FEW:
            break
        entered = across.rows.select(F.col("dst").alias("v")).distinct().withColumn("in", F.lit(True))
        left = across.rows.select(F.col("src").alias("v")).distinct().withColumn("out", F.lit(True))
        sides = vertices.join(entered, "v", "left").join(left, "v", "left").select(block("v", width), "v", (F.coalesce("in", F.lit(False)) | (F.col("v") == source)).alias("enters"), F.coalesce("out", F.lit(False)).alias("leaves"))
        reduced = saved(sides.groupBy("block").cogroup(inside.rows.groupBy("block")).applyInArrow(_reduce, "src long, dst long, w long"))
        passes += 1
        border = reduced.where("dst is null").select(F.col("src").alias("v"))
        staying = border.count()
        if 2 * staying > n:
            break
        levels.append((vertices, inside, across, width))
        links, vertices = reduced.where("dst is not null").unionAll(across.rows), border
        width = min(width * max(2, n // max(1, staying)), 1 << 62)
    start = vertices.select(block("v", width), "v", F.when(F.col("v") == source, F.lit(0)).cast("long").alias("way"), (F.col("v") == source).alias("changed"))
    kept, rounds = _rounds(inside.rows, across.rows, start, max_rounds)
    ways = kept.rows.where("way is not null").select("v", "way")
    for t in (inside, across):
        t.drop()
    for vertices, inside, across, width in reversed(levels):
        state = vertices.join(ways, "v", "left").select(block("v", width), "v", "way", F.col("way").isNotNull().alias("changed"))
        ways = saved(state.groupBy("block").cogroup(inside.rows.groupBy("block")).applyInArrow(_settle, "block long, v long, way long, changed boolean").where("way is not null").select("v", "way"))
        passes += 1
        for t in (inside, across):
            t.drop()
    return ways, rounds + passes


def bfs_levels(edges: DataFrame, ids: DataFrame, source: int, max_iter: int | None = None) -> DataFrame:
    """(v, level) of the vertices that are reached from `source`."""
    state = ids.select("v", F.when(F.col("v") == source, F.lit(0)).cast("long").alias("value"))
    out, _ = iterate(edges, state, F.col("value") + 1, F.min, F.least("value", "message"), state.where("value = 0").select("v"), max_iter)
    return out.where("value is not null").select("v", F.col("value").alias("level"))


def components(edges: DataFrame, ids: DataFrame, max_iter: int | None = None) -> DataFrame:
    """(v, component): the smallest id that reaches each vertex over entries, by supersteps; their number is the longest way.

    Where direction does not matter, `connected` needs far fewer rounds.
    """
    out, _ = iterate(edges, ids.select("v", F.col("v").alias("value")), F.col("value"), F.min, F.least("value", "message"), None, max_iter)
    return out.select("v", F.col("value").alias("component"))


def connected(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(v, component): the smallest id that each vertex is connected to, in either direction."""
    roots = star_contraction(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return ids.select("v").join(roots.withColumnRenamed("node", "v"), "v", "left").select("v", F.coalesce("root", "v").alias("component"))
