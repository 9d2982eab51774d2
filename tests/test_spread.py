"""Operators that keep large groups spread, on small graphs with small limits."""

import random
from collections import Counter, defaultdict
from heapq import heappop, heappush

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutloom.operators import assign, coarsen, counts, iterate, metrics, rank, refine, visit
from cutloom.plans import fixtures


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def made(seed, n=60, m=200):
    r = random.Random(seed)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    return pairs + [(0, r.randrange(n)) for _ in range(m)]


def test_bounds_of_any_shape(spark):
    """Touching, empty and far intervals, gaps, and ids before and after all of them."""
    r = random.Random(2)
    bounds, at = [], -50
    for part in range(200):
        at += r.choice([0, 0, 3, 10**6])
        width = r.choice([0, 1, 1, 5, 10**5])
        bounds.append((part, at, at + width))
        at += width
    ids = sorted({b + d for _, lo, hi in bounds for b in (lo, hi) for d in (-1, 0, 1, 2)})
    want = [(v, p) for v in ids for p, lo, hi in bounds if lo <= v < hi]
    got = assign.bounds_assign(spark.createDataFrame([(v,) for v in ids], "v long").repartition(4), spark.createDataFrame(bounds, "part int, lower long, upper long"))
    assert sorted((x["v"], x["part"]) for x in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_heavy_hitters(spark):
    pairs = made(1) + [(7, v) for v in range(150)]
    g = edges_of(spark, pairs).repartition(5)
    deg = Counter(s for s, _ in pairs)
    for size in (2, 3, 5, 30, 1000):
        assert {(x["v"], x["deg"]) for x in metrics.heavy_hitters(g, size).collect()} == {(v, n) for v, n in deg.items() if n * size > len(pairs)}
    assert metrics.heavy_hitters(g.limit(0)).count() == 0
    a = assign.hash_assign(g, 3)
    assert metrics.edge_cut(g, a, metrics.heavy_hitters(g, 5)).first() == metrics.edge_cut(g, a).first()


def test_folds_meet_again(spark):
    """A hub's neighbours in many tasks and batches come to the same as in one bag."""
    r = random.Random(3)
    pairs = [(0, r.randrange(5000)) for _ in range(6000)] + made(4) + [(1, None)]
    g = edges_of(spark, pairs).repartition(6)
    least = lambda x: np.unique(x)[:4]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {x["rank"]: x["nbrs"] for x in metrics.folded(g, least, 4).collect()}
        with pytest.raises(Exception, match="more than 2 ids"):
            metrics.folded(g, least, 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    bags = defaultdict(set)
    for s, d in pairs:
        if d is not None:
            bags[s].add(d)
    assert got == {s: sorted(b)[:4] for s, b in bags.items()}


def test_distinct_by_bitmaps(spark):
    ids = [*range(0, 100_000, 7), -5, -5, 0, 2**40, 2**40 + 1, None]
    assert metrics.count_distinct(spark.createDataFrame([(v,) for v in ids], "v long")).first()["n"] == len({v for v in ids if v is not None})
    assert metrics.count_distinct(spark.createDataFrame([], "v long")).first()["n"] == 0


def test_two_hop_shrinks_stars(spark):
    star = [(0, v) for v in range(1, 102)] + [(200, v) for v in range(201, 232)] + [(300, 300), (301, 301), (302, 302)]
    m = {x["v"]: x["mate"] for x in coarsen.random_matching(edges_of(spark, star + [(b, a) for a, b in star]), two_hop=True).collect()}
    assert all(m[m[v]] == v for v in m)
    assert sum(m[v] == v for v in m) <= 3
    assert {m[300], m[301], m[302]} == {300, 301, 302}
    levels = coarsen.coarsen(edges_of(spark, star[:101]), 10)
    assert levels[-1][1].count() <= 10


def test_visitors_see_parts_in_order(spark):
    class Log:
        def before_refine(self, part):
            self.seen = []
            return [(part, -1, "before")]

        def refine(self, part, rank, nbrs):
            self.seen.append(rank)
            return [(part, rank, ",".join(map(str, nbrs)))]

        def after_refine(self, part, n):
            return [(part, n, "sorted" if self.seen == sorted(self.seen) else "not")]

    pairs = made(6, 20, 50)
    g = edges_of(spark, pairs)
    got = sorted(tuple(x) for x in visit.visit_parts(g, assign.hash_assign(g, 3), Log, "part int, rank long, what string").collect())
    bags = defaultdict(list)
    for s, d in pairs:
        bags[s].append(d)
    want = [(s % 3, s, ",".join(map(str, sorted(b)))) for s, b in bags.items()]
    for part in {s % 3 for s in bags}:
        want += [(part, -1, "before"), (part, sum(s % 3 == part for s in bags), "sorted")]
    assert got == sorted(want)


def test_counts_follow_moves(spark):
    """Counts after moves are those of the new assignment counted anew, and only what moved is shuffled."""
    pairs = made(7)
    g = edges_of(spark, pairs)
    a = assign.hash_assign(g, 4)
    state, links = counts.count_entries(g, a), rank.bucketed(g, "src")
    moved = spark.createDataFrame([(0, 0, 3), (1, 1, 0), (9, 1, 2)], "v long, old int, new int")
    after = counts.move(state, links, moved)
    new = a.join(moved.select("v", "new"), "v", "left").select("v", F.coalesce("new", "part").alias("part"))
    fresh = counts.count_entries(g, new)
    as_set = lambda t: {(x["v"], x["part"], x["deg"], tuple(sorted((x["counts"] or {}).items()))) for x in t.rows.collect()}
    assert as_set(after) == as_set(fresh)
    assert counts.cut_entries(after.rows).first() == metrics.edge_cut(g, new).first()
    for kind in ("all", "pair"):
        want = {tuple(x) for x in refine.d_values(g, new, [(0, 3), (1, 2)], kind).collect()}
        assert {tuple(x) for x in counts.d_values(after.rows, [(3, 0), (1, 2)], kind).collect()} == want
    for t in (state, after, fresh, links):
        t.drop()


def test_steps_do_not_shuffle_entries(spark):
    """Where nothing is small enough to be sent to all tasks, a step shuffles messages and moved vertices only."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        g = edges_of(spark, made(8))
        links = rank.bucketed(g, "src")
        state = rank.bucketed(assign.vertices(g).select("v", F.col("v").alias("value"), F.lit(True).alias("changed")), "v")
        step = iterate.superstep(links.rows, state.rows, F.col("value"), F.min, F.least("value", "message"))
        plan = step._jdf.queryExecution().executedPlan().toString()
        # The only rows that are dealt anew are partial aggregates of messages.
        assert plan.count("Exchange") == 1 and "partial_min" in plan.split("Exchange")[1]
        whole = counts.count_entries(g, assign.hash_assign(g, 2))
        sent = links.rows.join(spark.createDataFrame([(0, 0, 1)], "src long, old int, new int"), "src")
        assert sent._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        for t in (links, state, whole):
            t.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_shortest_ways(spark):
    r = random.Random(9)
    links = [(r.randrange(80), r.randrange(80), r.randrange(9)) for _ in range(200)]
    far, heap, out = {3: 0}, [(0, 3)], defaultdict(list)
    for s, d, w in links:
        out[s].append((d, w))
    while heap:
        n, v = heappop(heap)
        for d, w in out[v] if n == far[v] else ():
            if n + w < far.get(d, 10**9):
                far[d] = n + w
                heappush(heap, (n + w, d))
    g, ids = spark.createDataFrame(links, "src long, dst long, w long"), spark.range(80).withColumnRenamed("id", "v")
    for width in (1, 16, 1000):
        got, rounds = iterate.shortest_ways(g, ids, 3, width)
        assert {x["v"]: x["way"] for x in got.collect()} == far
    assert rounds == 1
    path = spark.range(2000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("w"))
    got, rounds = iterate.shortest_ways(path, spark.range(2001).withColumnRenamed("id", "v"), 0, 500)
    assert rounds == 5 and got.where("v <> way").count() == 0 and got.count() == 2001


def test_shortest_ways_over_many_intervals(spark):
    n, r = 4000, random.Random(4)
    path = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("w"))
    got, rounds = iterate.shortest_ways(path, spark.range(n + 1).withColumnRenamed("id", "v"), 0, 40)
    assert rounds < 20 and got.where("v <> way").count() == 0 and got.count() == n + 1
    # Some intervals stay whole: both sides of their border are wide. Ways go back and forth, and not all vertices are reached.
    links = [(v, v + d, r.randrange(9)) for v in range(n) for d in (-1, 1, 2) if r.random() < 0.9 and 0 <= v + d < n] + [(r.randrange(100), r.randrange(100, 200), 3) for _ in range(300)]
    far, heap, out = {1777: 0}, [(0, 1777)], defaultdict(list)
    for s, d, w in links:
        out[s].append((d, w))
    while heap:
        m, v = heappop(heap)
        for d, w in out[v] if m == far[v] else ():
            if m + w < far.get(d, 10**9):
                far[d] = m + w
                heappush(heap, (m + w, d))
    g, ids = spark.createDataFrame(links, "src long, dst long, w long"), spark.range(n).withColumnRenamed("id", "v")
    got, rounds = iterate.shortest_ways(g, ids, 1777, 100)
    assert {x["v"]: x["way"] for x in got.collect()} == far and rounds < 20


def test_following_reads_rows_where_they_lie(spark):
    """Next rows over tasks, batches, nulls and lone groups; after the rows were dealt by range nothing but a row for each task is shuffled."""
    r = random.Random(11)
    data = [(i, r.choice(["a", "b", "b", "b", None, *map(str, range(30))]), r.choice([None, r.randrange(50)]), r.randrange(400)) for i in range(3000)]
    rows = spark.createDataFrame(data, "id long, kind string, value long, ts long").repartition(5)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    want = []
    groups = defaultdict(list)
    for i, kind, value, ts in data:
        groups[kind].append((ts, i, value))
    for kind, g in groups.items():
        values = [v for _, _, v in sorted(g)]
        want += list(zip([kind] * len(values), values, values[1:] + [None], strict=True))
    try:
        for batch, tasks in ((7, 40), (10_000, 4), (1, 3)):
            for c, v in zip(kept, (batch, "false", tasks), strict=True):
                spark.conf.set(c, str(v))
            got = fixtures.following(rows, "value", "kind", "ts", "id")
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
            assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert fixtures.following(rows.limit(0), "value", "kind", "ts", "id").count() == 0
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_buckets_follow_rows(spark):
    """Tables of a loop do not get more buckets than their rows fill or tasks run at once, and a step keeps them where they lie."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for c, v in zip(kept, ("64", "-1", "false"), strict=True):
        spark.conf.set(c, v)
    try:
        g = edges_of(spark, made(12))
        a = assign.hash_assign(g, 4)
        state = refine.refined_state(g, a, 4, schedule="rounds", kind="pair")
        assert state.n == spark.sparkContext.defaultParallelism
        assert spark.sql(f"DESCRIBE EXTENDED {state.name}").where("col_name = 'Num Buckets'").first()["data_type"] == str(state.n)
        new = state.rows.select("v", "part")
        assert sorted(map(tuple, new.collect())) == sorted(map(tuple, refine.refine(g, a, 4, schedule="rounds", kind="pair").collect()))
        fresh = counts.count_entries(g, new, state.n)
        as_set = lambda t: {(x["v"], x["part"], x["deg"], tuple(sorted(x["counts"].items()))) for x in t.rows.collect()}
        assert as_set(state) == as_set(fresh)
        # The new state is written by the tasks that read the buckets of the old one: a file for each bucket at most.
        assert len(state.rows.inputFiles()) <= state.n
        for t in (state, fresh):
            t.drop()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_moves_send_entries_once(spark):
    """Entries of vertices that moved are added up by way before they become two numbers each."""
    g = edges_of(spark, made(13))
    state, links = counts.count_entries(g, assign.hash_assign(g, 2), 3), rank.bucketed(g, "src", n=3)
    seen = []
    kept = counts.bucketed
    counts.bucketed = lambda df, *a, **b: seen.append(df) or kept(df, *a, **b)
    try:
        after = counts.move(state, links, spark.createDataFrame([(0, 0, 1), (1, 1, 0)], "v long, old int, new int"))
    finally:
        counts.bucketed = kept
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("count(1)")  # upper operators come first
    assert after.n == 3
    for t in (state, links, after):
        t.drop()
