"""Every graph operator as a query over the tables, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import assign, coarsen, counts, iterate, metrics, rank, refine, relabel, store, visit
from ..sources import sinks, text
from .fixtures import G1_SQL, G2_SQL, G3_SQL, GM_SQL, g1, g2, g3, gm
from .job import PartitionJob

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _assigned(graph: str, k: int) -> str:
    return f"""{graph}, a AS (SELECT v, CAST(v % {k} AS INTEGER) AS part FROM (SELECT src AS v FROM g UNION SELECT dst FROM g)),
e AS (SELECT g.src, g.dst, x.part AS ps, y.part AS pd FROM g JOIN a x ON x.v = g.src JOIN a y ON y.v = g.dst)"""


def _d(graph: str, k: int, a: int = 0, b: int = 1) -> str:
    return f"""{_assigned(graph, k)}, n AS (SELECT src AS v, count(*) AS deg FROM g GROUP BY src),
x AS (SELECT dst AS v, pd AS part, count(*) AS ext FROM e WHERE ps <> pd AND least(ps, pd) = {a} AND greatest(ps, pd) = {b} GROUP BY dst, pd),
d AS (SELECT x.v, x.part, coalesce(n.deg, 0) AS deg, x.ext, 2 * x.ext - coalesce(n.deg, 0) AS d FROM x LEFT JOIN n ON n.v = x.v)"""


# Adjacency, counts and degrees.


@_query(f"WITH {GM_SQL} SELECT src AS rank, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS nbrs FROM g GROUP BY src")
def adjacency_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = metrics.adjacency(gm(spark, sf_dir))
    return adj.select("rank", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


@_query(f"WITH {GM_SQL} SELECT src, dst, count(*) AS n FROM g GROUP BY src, dst")
def adjacency_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.flatten(metrics.adjacency(gm(spark, sf_dir))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {GM_SQL} SELECT src AS rank, sum(dst) AS nbrs FROM g GROUP BY src")
def adjacency_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A combine function of one's own in place of the bag."""
    return metrics.adjacency(gm(spark, sf_dir), F.sum("dst"))


def _sample(dst: np.ndarray) -> np.ndarray:
    """The three different ids that an arithmetic hash puts first."""
    ids = np.unique(dst)
    return ids[np.lexsort((ids, ids * 7919 % 1000003))[:3]]


@_query(f"WITH {G3_SQL}, n AS (SELECT DISTINCT src, dst FROM g), r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst * 7919 % 1000003, dst) AS k FROM n) SELECT src AS rank, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY k) AS nbrs FROM r WHERE k <= 3 GROUP BY src")
def adjacency_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A combine function in Python, in two steps: a sample of the neighbours of each source, hubs among them."""
    return metrics.folded(g3(spark, sf_dir), _sample, 3).select("rank", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


@_query(f"WITH {GM_SQL} SELECT count(*) - count(DISTINCT src) AS combined_pairs FROM g")
def combined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.combined_pairs(gm(spark, sf_dir))


@_query(f"WITH {GM_SQL} SELECT count(*) AS n_vertices FROM (SELECT src FROM g UNION SELECT dst FROM g)")
def vertex_count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vertex_count(gm(spark, sf_dir))


@_query(f"WITH {GM_SQL} SELECT count(DISTINCT src) AS n_vertices FROM g")
def vertex_count_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vertex_count(gm(spark, sf_dir), sources_only=True)


@_query(f"WITH {GM_SQL} SELECT max(greatest(src, dst)) AS max_id, count(*) AS n_entries, count(*) // 2 AS n_edges FROM g")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.graph_stats(gm(spark, sf_dir))


@_query(f"WITH {G1_SQL} SELECT src AS v, count(*) AS deg FROM g GROUP BY src")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.degree(g1(spark, sf_dir))


@_query(f"WITH {G1_SQL} SELECT deg, count(*) AS n_vertices FROM (SELECT src, count(*) AS deg FROM g GROUP BY src) GROUP BY deg")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.degree_histogram(g1(spark, sf_dir))


@_query(f"WITH {G3_SQL} SELECT src AS v, count(*) AS deg FROM g GROUP BY src HAVING count(*) >= 1000")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hubs(g3(spark, sf_dir))


@_query(f"WITH {G3_SQL} SELECT src AS v, count(*) AS deg FROM g GROUP BY src HAVING count(*) * 64 > (SELECT count(*) FROM g)")
def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of more than a 64th of all entries, found by counters of bounded number."""
    return metrics.heavy_hitters(g3(spark, sf_dir), 64)


@_query(f"WITH {_assigned(G3_SQL, 8)} SELECT count(*) AS cut_entries, count(*) // 2 AS edge_cut FROM e WHERE ps <> pd")
def edge_cut_with_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of a graph of a few hubs, whose entries stay where they are read."""
    edges = g3(spark, sf_dir)
    return metrics.edge_cut(edges, assign.hash_assign(edges, 8), metrics.heavy_hitters(edges, 64))


@_query(f"WITH {G3_SQL}, n AS (SELECT src, count(*) AS n_entries, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS nbrs FROM g GROUP BY src) SELECT src, n_entries, nbrs, CASE WHEN n_entries >= 1000 THEN 16 ELSE 1 END AS n_buckets FROM n")
def hub_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattering a hub's entries fills all buckets and keeps them all; other vertices stay in one."""
    edges = g3(spark, sf_dir)
    rows = assign.scatter_hubs(edges, metrics.hubs(edges), 16).groupBy("src").agg(F.count(F.lit(1)).alias("n_entries"), F.sort_array(F.collect_list("dst")).alias("nbrs"), F.countDistinct("bucket").alias("n_buckets"))
    return rows.withColumn("nbrs", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " "))


@_query(f"WITH {G3_SQL} SELECT src, dst, CAST(CASE WHEN (SELECT count(*) FROM g h WHERE h.src = g.src) >= 1000 THEN 0 ELSE 1 END AS INTEGER) AS whole FROM g")
def hub_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjacency in chunks: hubs over several rows, other vertices whole."""
    edges = g3(spark, sf_dir)
    adj = metrics.adjacency_chunks(edges, metrics.hubs(edges), 16)
    n = adj.groupBy("rank").agg(F.count(F.lit(1)).alias("n_rows"))
    return adj.join(n, "rank").select(F.col("rank").alias("src"), F.explode("nbrs").alias("dst"), (F.col("n_rows") == 1).cast("int").alias("whole"))


# Assignment.


@_query(f"WITH {_assigned(G1_SQL, 8)} SELECT v, part FROM a")
def hash_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.hash_assign(g1(spark, sf_dir), 8)


@_query(f"WITH {_assigned(G1_SQL, 8)} SELECT part, count(*) AS n_vertices FROM a GROUP BY part")
def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.part_sizes(assign.hash_assign(g1(spark, sf_dir), 8))


@_query(f"WITH {G1_SQL}, a AS (SELECT src AS v FROM g UNION SELECT dst FROM g) SELECT v, CAST(least(v // 100, 7) AS INTEGER) AS part FROM a")
def range_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.range_assign(assign.vertices(g1(spark, sf_dir)), 8, 800)


@_query(f"WITH {G1_SQL}, a AS (SELECT src AS v FROM g UNION SELECT dst FROM g) SELECT v, CAST(CASE WHEN v < 10 THEN 0 WHEN v < 150 THEN 1 ELSE 2 END AS INTEGER) AS part FROM a WHERE v < 1000")
def bounds_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = spark.createDataFrame([(0, 0, 10), (1, 10, 150), (2, 150, 1000)], "part int, lower long, upper long")
    return assign.bounds_assign(assign.vertices(g1(spark, sf_dir)), bounds)


@_query("WITH a AS (SELECT DISTINCT l_orderkey * 4 + l_linenumber % 4 AS v FROM lineitem) SELECT a.v, CAST(o_orderkey % 1000 AS INTEGER) AS part FROM a JOIN orders ON a.v >= o_orderkey * 4 AND a.v < o_orderkey * 4 + 3")
def bounds_assign_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval for each order, with gaps between them, and the lines that fall into one."""
    bounds = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 1000).alias("part"), (F.col("o_orderkey") * 4).alias("lower"), (F.col("o_orderkey") * 4 + 3).alias("upper"))
    ids = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 4 + F.col("l_linenumber") % 4).alias("v")).distinct()
    return assign.bounds_assign(ids, bounds)


@_query(f"WITH {_assigned(G2_SQL, 4)} SELECT v, CAST(CASE WHEN v < 50 THEN 0 ELSE part END AS INTEGER) AS part FROM a")
def overlay_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assign.hash_assign(g2(spark, sf_dir), 4)
    return assign.overlay(a, a.where("v < 50").select("v", F.lit(0).alias("part")))


@_query(f"WITH {_assigned(G2_SQL, 2)} SELECT v, part, (row_number() OVER (PARTITION BY part ORDER BY v) - 1) // 20 AS \"window\" FROM a")
def key_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.key_windows(assign.hash_assign(g2(spark, sf_dir), 2))


@_query(f"WITH {G2_SQL} SELECT DISTINCT src AS v FROM g ORDER BY v LIMIT 1 OFFSET 7")
def nth_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nth_vertex(assign.vertices(g2(spark, sf_dir)), 7)


def _scheduled(spark: SparkSession, sf_dir: str, rounds: bool) -> DataFrame:
    """The pairs of eight parts of a graph in the order of their steps, with the entries between the two."""
    edges = g2(spark, sf_dir)
    between = metrics.cut_matrix(edges, assign.hash_assign(edges, 8)).where("ps < pd").select(F.col("ps").alias("a"), F.col("pd").alias("b"), "n_entries")
    return refine.pair_schedule(spark, 8, rounds).join(between, ["a", "b"], "left").select("step", "a", "b", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


_BETWEEN = f"{_assigned(G2_SQL, 8)}, m AS (SELECT ps, pd, count(*) AS n FROM e GROUP BY ps, pd)"


@_query(f"WITH {_BETWEEN}, sch AS (SELECT CAST((row_number() OVER (ORDER BY a.range, b.range)) - 1 AS INTEGER) AS step, CAST(a.range AS INTEGER) AS a, CAST(b.range AS INTEGER) AS b FROM range(8) a JOIN range(8) b ON a.range < b.range) SELECT step, sch.a, sch.b, coalesce(m.n, 0) AS n_entries FROM sch LEFT JOIN m ON m.ps = sch.a AND m.pd = sch.b")
def pair_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of parts one by one."""
    return _scheduled(spark, sf_dir, False)


@_query(
    f"""WITH {_BETWEEN}, r AS (SELECT CAST(w.range AS INTEGER) AS step, CASE WHEN i.range = 0 THEN 0 ELSE (i.range - 1 - w.range + 14) % 7 + 1 END AS u, (6 - i.range - w.range + 14) % 7 + 1 AS v FROM range(7) w, range(4) i),
sch AS (SELECT step, CAST(least(u, v) AS INTEGER) AS a, CAST(greatest(u, v) AS INTEGER) AS b FROM r) SELECT step, sch.a, sch.b, coalesce(m.n, 0) AS n_entries FROM sch LEFT JOIN m ON m.ps = sch.a AND m.pd = sch.b"""
)
def pair_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circle method: seven rounds of four disjoint pairs of eight parts."""
    return _scheduled(spark, sf_dir, True)


# Cuts and boundaries.


@_query(f"WITH {_assigned(G1_SQL, 8)} SELECT count(*) AS cut_entries, count(*) // 2 AS edge_cut FROM e WHERE ps <> pd")
def edge_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g1(spark, sf_dir)
    return metrics.edge_cut(edges, assign.hash_assign(edges, 8))


@_query(f"WITH {_assigned(G1_SQL, 8)} SELECT ps AS part, CAST(sum(CASE WHEN ps <> pd THEN 1 ELSE 0 END) AS BIGINT) AS cut_entries FROM e GROUP BY ps")
def edge_cut_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g1(spark, sf_dir)
    return metrics.edge_cut_per_part(edges, assign.hash_assign(edges, 8))


@_query(f"WITH {_assigned(G1_SQL, 8)}, c AS (SELECT ps AS part, CAST(sum(CASE WHEN ps <> pd THEN 1 ELSE 0 END) AS BIGINT) AS cut_entries FROM e GROUP BY ps) SELECT part, cut_entries FROM c ORDER BY cut_entries DESC, part LIMIT 1")
def largest_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g1(spark, sf_dir)
    return metrics.largest_cut(edges, assign.hash_assign(edges, 8))


@_query(f"WITH {_assigned(G1_SQL, 4)} SELECT ps, pd, count(*) AS n_entries FROM e GROUP BY ps, pd")
def cut_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g1(spark, sf_dir)
    return metrics.cut_matrix(edges, assign.hash_assign(edges, 4))


@_query(f"WITH {_assigned(G2_SQL, 3)} SELECT dst AS v, pd AS part, count(*) AS ext FROM e WHERE ps <> pd GROUP BY dst, pd")
def boundary_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g2(spark, sf_dir)
    return metrics.boundary_vertices(edges, assign.hash_assign(edges, 3))


@_query(f"WITH {_assigned(G2_SQL, 3)} SELECT ps AS part, dst AS v, count(*) AS ext_cnt FROM e WHERE ps <> pd GROUP BY ps, dst")
def external_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g2(spark, sf_dir)
    return metrics.external_counts(edges, assign.hash_assign(edges, 3))


# Gains and refinement.


@_query(f"WITH {_d(G2_SQL, 2)} SELECT v, part, deg, ext, d FROM d")
def d_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rank.saved(g2(spark, sf_dir))
    return refine.d_values(edges, assign.hash_assign(edges, 2), [(0, 1)]).select("v", "part", "deg", "ext", "d")


@_query(f"WITH {_d(G2_SQL, 3)}, i AS (SELECT dst AS v, count(*) AS own FROM e WHERE ps = pd GROUP BY dst) SELECT d.v, d.part, d.deg, d.ext, d.ext - coalesce(i.own, 0) AS d FROM d LEFT JOIN i ON i.v = d.v")
def d_values_pair_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rank.saved(g2(spark, sf_dir))
    return refine.d_values(edges, assign.hash_assign(edges, 3), [(0, 1)], "pair").select("v", "part", "deg", "ext", "d")


_GAINS = """xs AS (SELECT v AS x, d AS dx FROM d WHERE part = 0), ys AS (SELECT v AS y, d AS dy FROM d WHERE part = 1),
c AS (SELECT x, y, CAST(dx + dy - CASE WHEN q.src IS NULL THEN 0 ELSE 2 END AS BIGINT) AS gain FROM xs CROSS JOIN ys LEFT JOIN (SELECT DISTINCT src, dst FROM g) q ON q.src = x AND q.dst = y)"""


@_query(f"WITH {_d(G2_SQL, 2)}, {_GAINS} SELECT x, y, gain FROM c ORDER BY gain DESC, x, y LIMIT 100")
def pair_gains_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rank.saved(g2(spark, sf_dir))
    return refine.pair_gains(edges, assign.hash_assign(edges, 2), 0, 1, 100)


_GREEDY = f"""WITH RECURSIVE {_d(G2_SQL, 2)}, {_GAINS},
r AS MATERIALIZED (SELECT x, y, gain, row_number() OVER (ORDER BY gain DESC, x, y) AS rn FROM c WHERE gain > 0),
w(step, x, y, gain, ux, uy) AS (
  (SELECT 0, x, y, gain, [x], [y] FROM r WHERE rn = 1)
  UNION ALL
  SELECT w.step + 1, n.x, n.y, n.gain, list_append(w.ux, n.x), list_append(w.uy, n.y)
  FROM w, LATERAL (SELECT x, y, gain FROM r WHERE NOT list_contains(w.ux, r.x) AND NOT list_contains(w.uy, r.y) ORDER BY rn LIMIT 1) n)"""


@_query(f"{_GREEDY} SELECT CAST(step AS INTEGER) AS step, x, y, gain FROM w")
def greedy_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rank.saved(g2(spark, sf_dir))
    return refine.swaps(edges, assign.hash_assign(edges, 2), [(0, 1)]).select("step", "x", "y", "gain")


_SPARSE = f"WITH RECURSIVE {_d(G1_SQL, 2)}, " + _GAINS.replace("FROM d WHERE part = 0", "FROM d WHERE part = 0 ORDER BY v LIMIT 200").replace("FROM d WHERE part = 1", "FROM d WHERE part = 1 ORDER BY v LIMIT 200")


@_query(f"""{_SPARSE}, r AS MATERIALIZED (SELECT x, y, gain, row_number() OVER (ORDER BY gain DESC, x, y) AS rn FROM c WHERE gain > 0),
w(step, x, y, gain, ux, uy) AS (
  (SELECT 0, x, y, gain, [x], [y] FROM r WHERE rn = 1)
  UNION ALL
  SELECT w.step + 1, n.x, n.y, n.gain, list_append(w.ux, n.x), list_append(w.uy, n.y)
  FROM w, LATERAL (SELECT x, y, gain FROM r WHERE NOT list_contains(w.ux, r.x) AND NOT list_contains(w.uy, r.y) ORDER BY rn LIMIT 1) n) SELECT CAST(step AS INTEGER) AS step, x, y, gain FROM w""")
def greedy_swaps_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges among the first two hundred boundary vertices of each part, matched by tasks of 16 ranks each."""
    edges = rank.saved(g1(spark, sf_dir))
    return refine.swaps(edges, assign.hash_assign(edges, 2), [(0, 1)], window=200, block=16).select("step", "x", "y", "gain")


_REFINED = f"{_GREEDY}, f AS (SELECT a.v, CAST(CASE WHEN p.x IS NOT NULL THEN 1 WHEN q.y IS NOT NULL THEN 0 ELSE a.part END AS INTEGER) AS part FROM a LEFT JOIN w p ON p.x = a.v LEFT JOIN w q ON q.y = a.v)"


@_query(f"{_REFINED} SELECT v, part FROM f")
def refined_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rank.saved(g2(spark, sf_dir))
    a = assign.hash_assign(edges, 2)
    return refine.apply_swaps(a, refine.swaps(edges, a, [(0, 1)]))


@_query(f"{_REFINED} SELECT count(*) AS cut_entries, count(*) // 2 AS edge_cut FROM g JOIN f p ON p.v = g.src JOIN f q ON q.v = g.dst WHERE p.part <> q.part")
def refined_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rank.saved(g2(spark, sf_dir))
    return metrics.edge_cut(edges, refine.refine(edges, assign.hash_assign(edges, 2), 2))


def _chain(name: str, before: str, pairs: list[tuple[int, int]], window: str = "") -> str:
    """SQL of one step: the greedy exchanges of disjoint pairs of parts under D = E - I, from assignment `before` to `name`. `window` says which boundary vertices take part."""
    parts = ", ".join(f"({a}, {b})" for a, b in pairs)
    return f"""{name}e AS (SELECT g.src, g.dst, x.part AS ps, y.part AS pd FROM g JOIN {before} x ON x.v = g.src JOIN {before} y ON y.v = g.dst),
{name}p(a, b) AS (VALUES {parts}),
{name}i AS (SELECT dst AS v, count(*) AS own FROM {name}e WHERE ps = pd GROUP BY dst),
{name}x AS (SELECT p.a, p.b, e.dst AS v, e.pd AS part, count(*) AS ext FROM {name}e e JOIN {name}p p ON p.a = least(e.ps, e.pd) AND p.b = greatest(e.ps, e.pd) WHERE e.ps <> e.pd GROUP BY p.a, p.b, e.dst, e.pd),
{name}d AS (SELECT x.a, x.b, x.v, x.part, x.ext - coalesce(i.own, 0) AS d FROM {name}x x LEFT JOIN {name}i i ON i.v = x.v {window}),
{name}c AS (SELECT l.a, l.b, l.v AS x, r.v AS y, l.d + r.d - CASE WHEN q.src IS NULL THEN 0 ELSE 2 END AS gain FROM {name}d l JOIN {name}d r ON r.a = l.a AND r.b = l.b AND l.part = l.a AND r.part = r.b LEFT JOIN (SELECT DISTINCT src, dst FROM g) q ON q.src = l.v AND q.dst = r.v),
{name}r AS MATERIALIZED (SELECT a, b, x, y, row_number() OVER (PARTITION BY a, b ORDER BY gain DESC, x, y) AS rn FROM {name}c WHERE gain > 0),
{name}w(a, b, x, y, ux, uy) AS (
  SELECT a, b, x, y, [x], [y] FROM {name}r WHERE rn = 1
  UNION ALL
  SELECT w.a, w.b, n.x, n.y, list_append(w.ux, n.x), list_append(w.uy, n.y) FROM {name}w w,
    LATERAL (SELECT x, y FROM {name}r r WHERE r.a = w.a AND r.b = w.b AND NOT list_contains(w.ux, r.x) AND NOT list_contains(w.uy, r.y) ORDER BY rn LIMIT 1) n),
{name} AS MATERIALIZED (SELECT t.v, CAST(coalesce(m.b, n.a, t.part) AS INTEGER) AS part FROM {before} t LEFT JOIN {name}w m ON m.x = t.v LEFT JOIN {name}w n ON n.y = t.v)"""


_IN_ROUNDS = f"WITH RECURSIVE {_assigned(G2_SQL, 4)}, {_chain('s1', 'a', [(0, 3), (1, 2)])}, {_chain('s2', 's1', [(0, 2), (1, 3)])}, {_chain('s3', 's2', [(0, 1), (2, 3)])} SELECT v, part FROM s3"


@_query(_IN_ROUNDS)
def refined_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refinement of four parts in three rounds of two disjoint pairs."""
    edges = rank.saved(g2(spark, sf_dir))
    return refine.refine(edges, assign.hash_assign(edges, 4), 4, schedule="rounds", kind="pair")


def _nth_window(step: int) -> str:
    return f"QUALIFY (row_number() OVER (PARTITION BY x.a, x.b, x.part ORDER BY x.v) - 1) // 5 = least({step}, (count(*) OVER (PARTITION BY x.a, x.b, x.part) - 1) // 5)"


@_query(f"WITH RECURSIVE {_assigned(G2_SQL, 4)}, {_chain('s1', 'a', [(0, 3), (1, 2)], _nth_window(0))}, {_chain('s2', 's1', [(0, 2), (1, 3)], _nth_window(1))}, {_chain('s3', 's2', [(0, 1), (2, 3)], _nth_window(2))} SELECT v, part FROM s3")
def refined_window_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of exchanges, each over the next window of five boundary vertices."""
    edges = rank.saved(g2(spark, sf_dir))
    return refine.refine(edges, assign.hash_assign(edges, 4), 4, schedule="rounds", kind="pair", window=5, cursor=True)


@_query(
    f"""{_IN_ROUNDS.rsplit(" SELECT ", 1)[0]}, fe AS (SELECT g.src, g.dst, x.part AS ps, y.part AS pd FROM g JOIN s3 x ON x.v = g.src JOIN s3 y ON y.v = g.dst),
n AS (SELECT src AS v, count(*) AS deg FROM g GROUP BY src)
SELECT fe.dst AS v, fe.pd AS part, n.deg, count(*) FILTER (ps <> pd) AS ext, 2 * count(*) FILTER (ps <> pd) - n.deg AS d, count(*) FILTER (ps = pd) AS own FROM fe JOIN n ON n.v = fe.dst WHERE pd < 2 AND ps < 2 GROUP BY fe.dst, fe.pd, n.deg HAVING count(*) FILTER (ps <> pd) > 0"""
)
def maintained_d_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E, D and inner entries of the boundary between parts 0 and 1 after three rounds of exchanges, as they were kept up to date."""
    edges = rank.saved(g2(spark, sf_dir))
    state = refine.refined_state(edges, assign.hash_assign(edges, 4), 4, schedule="rounds", kind="pair").rows
    own = state.select(F.col("v").alias("u"), counts.entries_from(F.col("part")).alias("own"))
    return counts.d_values(state, [(0, 1)]).join(own, F.col("v") == F.col("u")).select("v", "part", "deg", "ext", "d", "own")


@_query(f"{_IN_ROUNDS.rsplit(' SELECT ', 1)[0]} SELECT count(*) AS cut_entries, count(*) // 2 AS edge_cut FROM g JOIN s3 p ON p.v = g.src JOIN s3 q ON q.v = g.dst WHERE p.part <> q.part")
def maintained_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut after three rounds of exchanges, from the counts that were kept up to date."""
    edges = rank.saved(g2(spark, sf_dir))
    return counts.cut_entries(refine.refined_state(edges, assign.hash_assign(edges, 4), 4, schedule="rounds", kind="pair").rows)


def _rounds_sql(k: int) -> str:
    """SQL of all rounds of disjoint pairs of k parts."""
    rounds = refine.disjoint_rounds(k)
    steps = [_chain(f"s{i + 1}", f"s{i}" if i else "a", pairs) for i, pairs in enumerate(rounds)]
    return f"WITH RECURSIVE {_assigned(G2_SQL, k)}, {', '.join(steps)} SELECT v, part FROM s{len(rounds)}"


@_query(_rounds_sql(8))
def refined_eight_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refinement of eight parts in seven rounds of four disjoint pairs."""
    edges = rank.saved(g2(spark, sf_dir))
    return refine.refine(edges, assign.hash_assign(edges, 8), 8, schedule="rounds", kind="pair")


_WINDOW = _GREEDY.replace("xs AS (SELECT v AS x, d AS dx FROM d WHERE part = 0)", "xs AS (SELECT v AS x, d AS dx FROM d WHERE part = 0 ORDER BY v LIMIT 20)").replace("ys AS (SELECT v AS y, d AS dy FROM d WHERE part = 1)", "ys AS (SELECT v AS y, d AS dy FROM d WHERE part = 1 ORDER BY v LIMIT 20)")


@_query(f"{_WINDOW} SELECT CAST(step AS INTEGER) AS step, x, y, gain FROM w")
def greedy_swaps_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges among the first twenty boundary vertices of each part."""
    edges = rank.saved(g2(spark, sf_dir))
    return refine.swaps(edges, assign.hash_assign(edges, 2), [(0, 1)], window=20).select("step", "x", "y", "gain")


def _dynamic(limit: str) -> str:
    """Exchanges whose gains follow them: the state is the list of free vertices with their D, changed by the entries to the two that moved."""
    best = """(SELECT p.v AS x, q.v AS y, p.d + q.d - CASE WHEN coalesce(k.m[p.v * 1000000 + q.v], 0) > 0 THEN 2 ELSE 0 END AS gain
    FROM (SELECT unnest(st.free, recursive := true)) p, (SELECT unnest(st.free, recursive := true)) q WHERE p.part = 0 AND q.part = 1 ORDER BY gain DESC, x, y LIMIT 1)"""
    return f"""WITH RECURSIVE {_d(G2_SQL, 2)}, f AS MATERIALIZED ((SELECT v, part, d FROM d WHERE part = 0 ORDER BY v {limit}) UNION ALL (SELECT v, part, d FROM d WHERE part = 1 ORDER BY v {limit})),
k AS MATERIALIZED (SELECT map(list(u), list(n)) AS m FROM (SELECT g.src * 1000000 + g.dst AS u, count(*) AS n FROM g JOIN f p ON p.v = g.src JOIN f q ON q.v = g.dst GROUP BY ALL)),
st(step, x, y, gain, free) AS (
  SELECT -1, 0::BIGINT, 0::BIGINT, 1::BIGINT, (SELECT list({{'v': v, 'part': part, 'd': d}}) FROM f)
  UNION ALL
  SELECT st.step + 1, b.x, b.y, b.gain, list_transform(list_filter(st.free, lambda e: e.v <> b.x AND e.v <> b.y), lambda e: {{'v': e.v, 'part': e.part, 'd': e.d
    + CASE WHEN e.part = 0 THEN 2 ELSE -2 END * (coalesce(k.m[b.x * 1000000 + e.v], 0) - coalesce(k.m[b.y * 1000000 + e.v], 0))}})
  FROM st, k, LATERAL {best} b WHERE b.gain > 0)"""


@_query(f"{_dynamic('')} SELECT CAST(step AS INTEGER) AS step, x, y, CAST(gain AS BIGINT) AS gain FROM st WHERE step >= 0")
def dynamic_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges with gains that follow them, over whole boundaries."""
    edges = rank.saved(g2(spark, sf_dir))
    return refine.swaps(edges, assign.hash_assign(edges, 2), [(0, 1)], "dynamic").select("step", "x", "y", "gain")


@_query(
    f"""{_dynamic('LIMIT 20')}, t AS (SELECT a.v, CASE WHEN a.v IN (SELECT x FROM st WHERE step >= 0) THEN 1 WHEN a.v IN (SELECT y FROM st WHERE step >= 0) THEN 0 ELSE a.part END AS part FROM a),
c AS (SELECT (SELECT count(*) FROM e WHERE ps <> pd) AS before, (SELECT count(*) FROM g JOIN t p ON p.v = g.src JOIN t q ON q.v = g.dst WHERE p.part <> q.part) AS after)
SELECT least(before, after) AS cut_entries, least(before, after) // 2 AS edge_cut FROM c"""
)
def refined_dynamic_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut with gains that follow the exchanges, over windows of 20 vertices, never worse than before."""
    edges = rank.saved(g2(spark, sf_dir))
    return metrics.edge_cut(edges, refine.refine(edges, assign.hash_assign(edges, 2), 2, "dynamic", window=20, accept="improve"))


# Relabelling.

_RELABEL = f"{_assigned(G1_SQL, 8)}, m AS (SELECT v, part, row_number() OVER (ORDER BY part, v) AS new_id FROM a)"


@_query(f"WITH {_RELABEL} SELECT v, part, new_id FROM m")
def relabel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabel.relabel_map(assign.hash_assign(g1(spark, sf_dir), 8))


@_query(f"WITH {_RELABEL} SELECT v, part, new_id - 1 AS new_id FROM m")
def relabel_map_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabel.relabel_map(assign.hash_assign(g1(spark, sf_dir), 8), base=0)


@_query(f"WITH {_RELABEL} SELECT DISTINCT p.new_id AS src, q.new_id AS dst FROM g JOIN m p ON p.v = g.src JOIN m q ON q.v = g.dst")
def relabel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g1(spark, sf_dir)
    return relabel.relabel_edges(edges, relabel.relabel_map(assign.hash_assign(edges, 8)))


@_query(f"WITH {_RELABEL} SELECT part, max(new_id) + 1 AS upper FROM m GROUP BY part")
def part_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabel.part_boundaries(assign.hash_assign(g1(spark, sf_dir), 8))


@_query(f"WITH {_RELABEL} SELECT max(new_id) AS new_id FROM m WHERE v = 0")
def source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabel.source_id(relabel.relabel_map(assign.hash_assign(g1(spark, sf_dir), 8)))


@_query(f"WITH {_RELABEL}, u AS (SELECT part, max(new_id) + 1 AS upper FROM m GROUP BY part), l AS (SELECT upper, lag(upper) OVER (ORDER BY part) AS lower FROM u) SELECT max(upper - coalesce(lower, 0)) AS width FROM l")
def longest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = relabel.part_boundaries(assign.hash_assign(g1(spark, sf_dir), 8))
    from pyspark.sql import Window as W

    return metrics.longest_interval(bounds.withColumn("lower", F.coalesce(F.lag("upper").over(W.orderBy("part")), F.lit(0))))


# Sets and text.


@_query(f"WITH {GM_SQL} SELECT DISTINCT src, dst FROM g")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm(spark, sf_dir).distinct()


@_query(f"WITH {GM_SQL}, h AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g) SELECT src, dst, count(*) AS n FROM h GROUP BY src, dst")
def edge_symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.symmetrize(gm(spark, sf_dir)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {G2_SQL}, n AS (SELECT max(greatest(src, dst)) AS n FROM g), l AS (SELECT src, ' ' || string_agg(CAST(dst AS VARCHAR), '  ' ORDER BY dst) || ' ' AS line FROM g GROUP BY src)
SELECT 0::BIGINT AS v, '#' || count(DISTINCT src) || ' ' || count(*) // 2 AS line FROM g
UNION ALL SELECT CAST(r.range AS BIGINT), coalesce(l.line, '') FROM range(1, (SELECT n + 1 FROM n)) r LEFT JOIN l ON l.src = r.range""")
def metis_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.metis_lines(g2(spark, sf_dir), ordered=False)


@_query(f"WITH {GM_SQL} SELECT src, dst FROM g WHERE dst <= (SELECT count(DISTINCT src) FROM g)")
def etoa_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.neighbour_filter(gm(spark, sf_dir))


@_query(f"WITH {_assigned(G2_SQL, 4)} SELECT part, v, v || chr(9) || part AS line FROM a")
def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.part_lines(assign.hash_assign(g2(spark, sf_dir), 4))


@_query(f"WITH {GM_SQL} SELECT src, dst, count(*) AS n FROM g GROUP BY src, dst")
def parse_edgelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = gm(spark, sf_dir).select(F.concat_ws("\t", "src", "dst", F.lit("x")).alias("value")).unionAll(spark.createDataFrame([("# a comment",), ("",)], "value string"))
    return text.parse_edgelist(lines).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _comma_lines(lines: DataFrame) -> DataFrame:
    """Lines `from,to` in the other direction."""
    w = F.split("value", ",")
    return lines.select(w[1].cast("long").alias("src"), w[0].cast("long").alias("dst"))


@_query(f"WITH {GM_SQL} SELECT dst AS src, src AS dst, count(*) AS n FROM g GROUP BY src, dst")
def parse_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line parser of one's own in place of the built-in ones."""
    path = _folder(spark)
    sinks.write_lines(gm(spark, sf_dir).select(F.concat_ws(",", "src", "dst").alias("line")), path)
    return text.read_graph(spark, path, "edgelist", parse=_comma_lines).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {GM_SQL} SELECT src, dst, count(*) AS n FROM g GROUP BY src, dst")
def parse_adjlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = metrics.adjacency(gm(spark, sf_dir))
    lines = adj.select(F.concat_ws(" ", F.col("rank").cast("string"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), "  ")).alias("value"))
    return text.parse_adjlist(lines).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {G2_SQL} SELECT src, dst FROM g WHERE src > 0 AND dst > 0")
def parse_metis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of neighbours, written in order and parsed."""
    path = _folder(spark)
    sinks.write_ordered(sinks.metis_lines(g2(spark, sf_dir).where("src > 0 and dst > 0"), ordered=False), path, "v")
    return text.parse_metis(text.file_lines(spark, path))


# Files that are written and read back.


def _folder(spark: SparkSession) -> str:
    return rank.table(spark)


@_query(f"WITH {G2_SQL} SELECT count(DISTINCT src) AS n, count(*) // 2 AS m FROM g")
def metis_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_metis(g2(spark, sf_dir), path)
    return text.metis_header(text.file_lines(spark, path)).select("n", "m")


@_query(f"WITH {G2_SQL} SELECT count(DISTINCT src) AS n, count(*) // 2 AS m, count(DISTINCT src) AS n_sources, count(*) AS n_entries FROM g WHERE src > 0 AND dst > 0")
def metis_header_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a graph in four files against its lines."""
    path = _folder(spark)
    sinks.write_metis(g2(spark, sf_dir).where("src > 0 and dst > 0"), path, files=4)
    return text.check_metis(text.file_lines(spark, path)).drop("file")


@_query(f"WITH {G2_SQL} SELECT src, dst FROM g WHERE src > 0 AND dst > 0")
def metis_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """METIS lines written and read by splits."""
    path = _folder(spark)
    sinks.write_metis(g2(spark, sf_dir).where("src > 0 and dst > 0"), path)
    return text.read_graph(spark, path, "metis")


@_query(f"WITH {G2_SQL} SELECT src, dst FROM g WHERE src > 0 AND dst > 0")
def metis_eight_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """METIS lines that go on over eight files."""
    path = _folder(spark)
    sinks.write_metis(g2(spark, sf_dir).where("src > 0 and dst > 0"), path, files=8)
    return text.read_graph(spark, path, "metis")


@_query(f"WITH {_assigned(G2_SQL, 4)} SELECT v, part FROM a WHERE v BETWEEN 1 AND 1200")
def part_list_eight_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of parts that goes on over eight files, with vertices that have none."""
    path = _folder(spark)
    sinks.write_part_list(assign.hash_assign(g2(spark, sf_dir), 4), path, 1200, files=8)
    return text.read_parts(spark, path, "list")


@_query(f"WITH {_assigned(G2_SQL, 4)} SELECT v, part FROM a")
def write_read_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_parts(assign.hash_assign(g2(spark, sf_dir), 4), path)
    return text.read_parts(spark, f"{path}/part=*")


@_query("SELECT row_number() OVER (ORDER BY c_custkey) AS v, CAST(c_nationkey AS INTEGER) AS part FROM customer")
def read_part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of parts, five to a line, in order of the vertices."""
    path = _folder(spark)
    rows = rank.ranked(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), "c_custkey")
    lines = rows.groupBy(F.floor(F.col("rank") / 5).alias("at")).agg(F.sort_array(F.collect_list(F.struct("rank", "c_nationkey"))).alias("w"))
    sinks.write_ordered(lines.select("at", F.array_join(F.transform("w", lambda x: x["c_nationkey"].cast("string")), " ").alias("line")), path, "at", files=3)
    return text.read_parts(spark, path, "list")


@_query(f"WITH {G2_SQL} SELECT DISTINCT src, dst FROM g")
def pair_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that run on over line breaks and files: three numbers to a line, five files."""
    path = _folder(spark)
    words = rank.ranked(g2(spark, sf_dir), "src", "dst").select(F.posexplode(F.array("src", "dst")).alias("side", "n"), "rank").select((F.col("rank") * 2 + F.col("side")).alias("at"), "n")
    lines = words.groupBy(F.floor(F.col("at") / 3).alias("line_at")).agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("w"))
    sinks.write_ordered(lines.select("line_at", F.array_join(F.transform("w", lambda x: x["n"].cast("string")), " ").alias("line")), path, "line_at", files=5)
    return text.pair_scan(text.file_lines(spark, path))


@_query(f"WITH {_assigned(G1_SQL, 8)}, m AS (SELECT part, count(*) AS n FROM a GROUP BY part), u AS (SELECT part, CAST(sum(n) OVER (ORDER BY part) + 1 AS BIGINT) AS upper FROM m) SELECT part, coalesce(lag(upper) OVER (ORDER BY part), 0) AS lower, upper FROM u")
def write_read_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_bounds(relabel.part_boundaries(assign.hash_assign(g1(spark, sf_dir), 8)), path)
    return text.read_bounds(spark, path)


@_query(f"WITH {G2_SQL} SELECT src, dst FROM g")
def write_read_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_edges(g2(spark, sf_dir), path)
    return text.read_graph(spark, path, "edgelist")


@_query(f"WITH {GM_SQL} SELECT count(*) + 1 AS n_lines FROM g")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no comments; a blank one counts."""
    path = _folder(spark)
    lines = gm(spark, sf_dir).select(F.concat_ws(" ", "src", "dst").alias("line"))
    sinks.write_lines(lines.unionAll(spark.createDataFrame([("# a comment",), ("",)], "line string")), path)
    return text.count_lines(spark.read.text(path))


_FILES = "f AS (SELECT n_nationkey AS i, 40 * (n_nationkey + 1) AS bytes FROM nation)"


def _sized(spark: SparkSession, sf_dir: str) -> str:
    """A folder of 25 files of 40, 80, 120, … bytes, by name."""
    path = _folder(spark)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("i"), F.repeat(F.lit("x"), (40 * F.col("n_nationkey") + 39).cast("int")).alias("value"))
    nations.repartition("i").write.partitionBy("i").text(path)
    return path


@_query(f"WITH {_FILES} SELECT i, bytes FROM f")
def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and their sizes, as a list that is written and read back."""
    path, listed = _sized(spark, sf_dir), _folder(spark)
    files = text.list_files(spark, f"{path}/*")
    sinks.write_file_list(files, listed)
    names = spark.read.text(listed).select(F.col("value").alias("file"))
    return files.join(names, "file").select(F.regexp_extract("file", r"i=(\d+)/", 1).cast("int").alias("i"), "bytes")


@_query(f"WITH {_FILES}, c AS (SELECT i, bytes, coalesce(sum(bytes) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) SELECT i, bytes FROM c WHERE before <= 3000")
def capped_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first files whose sizes pass 3,000 bytes."""
    files = text.capped_files(text.list_files(spark, f"{_sized(spark, sf_dir)}/*"), 3000 / 2**30)
    return files.select(F.regexp_extract("file", r"i=(\d+)/", 1).cast("int").alias("i"), "bytes")


# Contraction.

_MATCH = f"{G2_SQL}, q AS (SELECT src AS v FROM g UNION SELECT dst FROM g), p AS (SELECT v, CASE WHEN xor(v, 1) IN (SELECT v FROM q) THEN least(v, xor(v, 1)) ELSE v END AS head FROM q), h AS (SELECT v, dense_rank() OVER (ORDER BY head) - 1 AS cv FROM p)"


def _matching(edges: DataFrame) -> DataFrame:
    ids = assign.vertices(edges)
    mates = ids.select(F.col("v").alias("mate"))
    return ids.withColumn("m", F.col("v").bitwiseXOR(F.lit(1))).join(mates, F.col("m") == F.col("mate"), "left").select("v", F.coalesce("mate", "v").alias("mate"))


@_query(f"WITH {_MATCH} SELECT v, cv FROM h")
def coarse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen.number(_matching(g2(spark, sf_dir)))


@_query(f"WITH {_MATCH} SELECT x.cv AS src, y.cv AS dst, count(*) AS w FROM g JOIN h x ON x.v = g.src JOIN h y ON y.v = g.dst WHERE x.cv <> y.cv GROUP BY x.cv, y.cv")
def contract_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g2(spark, sf_dir)
    return coarsen.contract(coarsen.weighted(edges), coarsen.number(_matching(edges)))


@_query(f"WITH {_MATCH} SELECT cv AS v, count(*) AS vwgt FROM h GROUP BY cv")
def contract_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g2(spark, sf_dir)
    return coarsen.contract_weights(coarsen.unit_weights(edges), coarsen.number(_matching(edges)))


@_query(f"WITH {GM_SQL}, w AS (SELECT count(*) AS w FROM g GROUP BY src, dst) SELECT min(w) = max(w) AS equal_weights FROM w")
def equal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen.equal_weights(coarsen.weighted(gm(spark, sf_dir)))


def _matched_sql(rounds: int = 4, graph: str = G2_SQL, g: str = "g", p: str = "") -> str:
    """Rounds of mutual first choices by an arithmetic rank of links of table `g`, as tables m0, m1, …; q is the whole matching. Names begin with `p`."""
    sql = [graph, f"{p}z0 AS (SELECT src, dst FROM {g} WHERE src <> dst)"]
    for r in range(rounds):
        order = f"(least(src, dst) * 7919 + greatest(src, dst) * 104729 + {r}) % 1000003"
        sql.append(f"{p}c{r} AS (SELECT src, arg_min(dst, {{'o': {order}, 'd': dst}}) AS mate FROM {p}z{r} GROUP BY src)")
        sql.append(f"{p}m{r} AS MATERIALIZED (SELECT x.src AS v, x.mate FROM {p}c{r} x JOIN {p}c{r} y ON y.src = x.mate AND y.mate = x.src)")
        sql.append(f"{p}z{r + 1} AS MATERIALIZED (SELECT src, dst FROM {p}z{r} WHERE src NOT IN (SELECT v FROM {p}m{r}) AND dst NOT IN (SELECT v FROM {p}m{r}))")
    pairs = " UNION ALL ".join(f"SELECT v, mate FROM {p}m{r}" for r in range(rounds))
    return ", ".join([*sql, f"{p}p AS ({pairs}), {p}q AS (SELECT n.v, coalesce({p}p.mate, n.v) AS mate FROM (SELECT src AS v FROM {g} UNION SELECT dst FROM {g}) n LEFT JOIN {p}p ON {p}p.v = n.v)"])


def _rank(low, high, r: int):  # noqa: ANN001, ANN202
    return (low * 7919 + high * 104729 + r) % 1000003


@_query(f"WITH {_matched_sql()} SELECT v, mate FROM q")
def matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of vertices that name each other, under a rank that SQL can compute."""
    return coarsen.random_matching(rank.saved(g2(spark, sf_dir)), rank=_rank)


@_query(
    f"""WITH {_matched_sql(2, G3_SQL)}, u AS (SELECT q.v FROM q WHERE q.mate = q.v),
w AS (SELECT u.v, arg_min(z.dst, {{'o': (least(z.src, z.dst) * 7919 + greatest(z.src, z.dst) * 104729 + 2) % 1000003, 'd': z.dst}}) AS centre FROM u JOIN z0 z ON z.src = u.v GROUP BY u.v),
y AS (SELECT u.v, coalesce(w.centre, -1) AS centre, row_number() OVER (PARTITION BY coalesce(w.centre, -1) ORDER BY u.v) - 1 AS at FROM u LEFT JOIN w ON w.v = u.v),
k AS (SELECT a.v, b.v AS mate FROM y a JOIN y b ON b.centre = a.centre AND b.at = xor(a.at, 1))
SELECT q.v, coalesce(k.mate, q.mate) AS mate FROM q LEFT JOIN k ON k.v = q.v"""
)
def matching_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds on a graph of a few stars, then those that are left, over the star that they share."""
    return coarsen.random_matching(rank.saved(g3(spark, sf_dir)), rounds=2, rank=_rank, two_hop=True)


@_query(f"WITH {_matched_sql()}, h AS (SELECT v, dense_rank() OVER (ORDER BY least(v, mate)) - 1 AS cv FROM q) SELECT x.cv AS src, y.cv AS dst, count(*) AS w FROM g JOIN h x ON x.v = g.src JOIN h y ON y.v = g.dst WHERE x.cv <> y.cv GROUP BY x.cv, y.cv")
def coarse_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of coarsening: matched, numbered and contracted."""
    edges = rank.saved(g2(spark, sf_dir))
    return coarsen.contract(coarsen.weighted(edges), coarsen.number(coarsen.random_matching(edges, rank=_rank)))


_TWO_LEVELS = f"""WITH {_matched_sql()}, h AS (SELECT v, dense_rank() OVER (ORDER BY least(v, mate)) - 1 AS cv FROM q),
f AS (SELECT x.cv AS src, y.cv AS dst, count(*) AS w FROM g JOIN h x ON x.v = g.src JOIN h y ON y.v = g.dst WHERE x.cv <> y.cv GROUP BY x.cv, y.cv),
{_matched_sql(4, "unused AS (SELECT 1)", "f", "k")}, kh AS (SELECT v, dense_rank() OVER (ORDER BY least(v, mate)) - 1 AS cv FROM kq)"""


@_query(f"{_TWO_LEVELS} SELECT x.cv AS src, y.cv AS dst, CAST(sum(w) AS BIGINT) AS w FROM f JOIN kh x ON x.v = f.src JOIN kh y ON y.v = f.dst WHERE x.cv <> y.cv GROUP BY x.cv, y.cv")
def coarse_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of coarsening: the second one matches, numbers and contracts what the first has made."""
    fine = rank.saved(coarsen.weighted(g2(spark, sf_dir)))
    for _ in range(2):
        fine = rank.saved(coarsen.contract(fine, rank.saved(coarsen.number(coarsen.random_matching(fine, rank=_rank)))))
    return fine


@_query(f"WITH {G2_SQL} SELECT count(DISTINCT src) AS total_weight, count(*) AS entries_kept_or_inside, true AS ends_small, true AS ids_gapless FROM g")
def coarsen_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarsening to 40 vertices: all vertex weight is on the last level, all entry weight in it or inside its vertices, and it is small or stopped shrinking."""
    edges = rank.saved(g2(spark, sf_dir))
    levels = coarsen.coarsen(edges, 40)
    last, weights, _ = levels[-1]
    maps = levels[0][2]
    for _, _, cmap in levels[1:]:
        maps = maps.join(cmap.select(F.col("v").alias("cv"), F.col("cv").alias("up")), "cv").select("v", F.col("up").alias("cv"))
    a, b = maps.select(F.col("v").alias("src"), F.col("cv").alias("a")), maps.select(F.col("v").alias("dst"), F.col("cv").alias("b"))
    inside = edges.join(a, "src").join(b, "dst").where("a = b").count()
    sizes = [w.count() for _, w, _ in levels]
    stopped = sizes[-1] <= 40 or (len(sizes) > 1 and sizes[-1] >= 0.85 * sizes[-2]) or len(sizes) == 1
    n = weights.agg(F.sum("vwgt").alias("total_weight"), (F.max("v") + 1 == F.count(F.lit(1))).alias("ids_gapless"))
    return n.crossJoin(last.agg((F.coalesce(F.sum("w"), F.lit(0)) + inside).alias("entries_kept_or_inside"))).withColumn("ends_small", F.lit(stopped))  # one row each


# Iteration.


@_query(f"WITH {G2_SQL} SELECT DISTINCT dst AS v FROM g WHERE src < 3")
def frontier_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g2(spark, sf_dir)
    return iterate.activate_neighbours(edges, assign.vertices(edges).where("v < 3"))


@_query(f"WITH {G2_SQL} SELECT count(*) AS n_active FROM g WHERE src < 3")
def active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g2(spark, sf_dir)
    return iterate.active_count(edges, assign.vertices(edges).where("v < 3"))


@_query(f"WITH RECURSIVE {G1_SQL}, l(v, level) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT g.dst, l.level + 1 FROM l JOIN g ON g.src = l.v WHERE l.level < 8) SELECT v, min(level) AS level FROM l GROUP BY v")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rank.saved(g1(spark, sf_dir))
    return iterate.bfs_levels(edges, assign.vertices(edges), 0)


@_query(f"WITH RECURSIVE {G1_SQL}, l(v, level) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT g.dst, l.level + 1 FROM l JOIN g ON g.src = l.v WHERE l.level < 8), m AS (SELECT v, min(level) AS level FROM l GROUP BY v) SELECT max(level) + 1 AS supersteps, count(*) AS n_reached FROM m")
def superstep_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many supersteps a search from one vertex takes until nothing changes."""
    edges = rank.saved(g1(spark, sf_dir))
    state = assign.vertices(edges).select("v", F.when(F.col("v") == 0, F.lit(0)).cast("long").alias("value"))
    out, steps = iterate.iterate(edges, state, F.col("value") + 1, F.min, F.least("value", "message"), state.where("value = 0").select("v"))
    return out.where("value is not null").agg(F.lit(steps).cast("long").alias("supersteps"), F.count(F.lit(1)).alias("n_reached"))


@_query("SELECT o_orderkey AS v, CAST(coalesce(sum(o_custkey % 7) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS way FROM orders")
def shortest_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways along all orders, each linked to the next, by intervals of orders that are settled in one task each."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 7).alias("w"))
    rows = rank.saved(rank.ranked(orders, "o_orderkey"))
    nexts = rows.select(F.col("o_orderkey").alias("dst"), (F.col("rank") - 1).alias("rank"))
    links = rows.join(nexts, "rank").select(F.col("o_orderkey").alias("src"), "dst", "w")
    first = rows.where("rank = 0").first()["o_orderkey"]
    return iterate.shortest_ways(links, rows.select(F.col("o_orderkey").alias("v")), first, width=4096)[0]


class _Gaps:
    """What a part's vertices, their entries and the widest gap between their ids come to."""

    def before_refine(self, part: int) -> list[tuple]:
        self.last, self.entries, self.gap = None, 0, 0
        return []

    def refine(self, part: int, rank: int, nbrs: list[int]) -> list[tuple]:
        self.gap = max(self.gap, 0 if self.last is None else rank - self.last)
        self.last, self.entries = rank, self.entries + len(nbrs)
        return []

    def after_refine(self, part: int, n: int) -> list[tuple]:
        return [(part, n, self.entries, self.gap)]


@_query(f"WITH {_assigned(G2_SQL, 4)}, n AS (SELECT src AS v, count(*) AS deg FROM g GROUP BY src), l AS (SELECT a.part, n.deg, a.v - lag(a.v) OVER (PARTITION BY a.part ORDER BY a.v) AS gap FROM a JOIN n ON n.v = a.v) SELECT part, count(*) AS n_vertices, CAST(sum(deg) AS BIGINT) AS n_entries, coalesce(max(gap), 0) AS widest_gap FROM l GROUP BY part")
def visit_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks of one's own, called for every part and each of its records in order."""
    edges = g2(spark, sf_dir)
    return visit.visit_parts(edges, assign.hash_assign(edges, 4), _Gaps, "part int, n_vertices long, n_entries long, widest_gap long")


@_query(f"WITH {G1_SQL} SELECT src AS v, sum(dst) AS total FROM g GROUP BY src")
def neighbour_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = g1(spark, sf_dir)
    return iterate.neighbour_sum(edges, assign.vertices(edges).withColumn("value", F.col("v")))


#: Customers and the one of half their number, but for every fifth: a forest of small trees.
_FOREST = "t AS (SELECT c_custkey AS v, c_custkey // 2 AS up FROM customer)"


def _forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("v"))
    links = ids.where("v % 5 <> 0 and v > 1").select(F.col("v").alias("src"), F.expr("v div 2").alias("dst"))
    return links, ids


_ROOTS = f"""WITH RECURSIVE {_FOREST}, r(v, here) AS (SELECT v, v FROM t UNION ALL SELECT r.v, r.here // 2 FROM r WHERE r.here % 5 <> 0 AND r.here > 1)
SELECT v, min(here) AS component FROM r GROUP BY v"""


@_query(_ROOTS)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label propagation in supersteps over a forest of many trees."""
    links, ids = _forest(spark, sf_dir)
    return iterate.components(rank.saved(text.symmetrize(links)), ids)


@_query(_ROOTS)
def connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components by star contraction, over links of one direction."""
    return iterate.connected(*_forest(spark, sf_dir))


# Record store.


def _orders(spark: SparkSession, sf_dir: str) -> store.RecordStore:
    """Customers' orders as versions of one record each: first all, then those of status F again, then keys below 5 deleted."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    box = store.RecordStore(spark, rank.table(spark))
    box.put(orders.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").cast("string").alias("value")))
    box.put(orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.concat(F.lit("F"), F.max("o_orderkey").cast("string")).alias("value")))
    return box


_KV = """f AS (SELECT o_custkey AS key, max(o_orderkey) AS m, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS f FROM orders GROUP BY o_custkey),
k AS (SELECT key, CASE WHEN f IS NULL THEN CAST(m AS VARCHAR) ELSE 'F' || f END AS value FROM f)"""


@_query(f"WITH {_KV} SELECT key, value FROM k")
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).scan().select("key", "value")


@_query(f"WITH {_KV} SELECT key, value FROM k WHERE key BETWEEN 10 AND 60")
def kv_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).get_range(10, 60).select("key", "value")


@_query(f"WITH {_KV} SELECT key, value FROM k WHERE key = 10")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).get(10).select("key", "value")


@_query(f"WITH {_KV} SELECT key, value FROM k WHERE key >= 20")
def kv_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = _orders(spark, sf_dir)
    box.delete(box.get_range(0, 19).select("key"))
    return box.scan().select("key", "value")


@_query("SELECT 1::BIGINT AS version, count(DISTINCT o_custkey) AS n_records, 0::BIGINT AS n_deletes FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 0, count(DISTINCT o_custkey), 0 FROM orders UNION ALL SELECT 2, 0, count(DISTINCT o_custkey) FROM orders WHERE o_custkey < 20")
def kv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each write of the store has written."""
    box = _orders(spark, sf_dir)
    box.delete(box.get_range(0, 19).select("key"))
    return box.stats()


@_query(f"WITH {G2_SQL}, n AS (SELECT src AS v, CAST(sum(dst) AS BIGINT) AS total FROM g GROUP BY src) SELECT v AS key, CASE WHEN v % 2 = 1 THEN total ELSE v END AS value FROM n")
def vertex_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex states in the store: all are put, neighbours' sums computed, and only the changed ones written back."""
    edges = rank.saved(g2(spark, sf_dir))
    box = store.RecordStore(spark, rank.table(spark))
    box.put(assign.vertices(edges).select(F.col("v").alias("key"), F.col("v").alias("value")))
    state = box.scan().select(F.col("key").alias("v"), "value")
    box.put(iterate.neighbour_sum(edges, state).where("v % 2 = 1").select(F.col("v").alias("key"), F.col("total").alias("value")))
    return box.scan().select("key", "value")


# Scalars and reports.


@_query("""SELECT c_custkey AS id, CASE WHEN c_custkey <= 1 THEN 0 ELSE length(ltrim(bin(c_custkey), '0')) - 1 END::INTEGER AS log2, CASE WHEN c_custkey = 0 THEN 0 ELSE length(CAST(c_custkey AS VARCHAR)) END::INTEGER AS digits,
lpad(CAST(c_custkey AS VARCHAR), 19, '0') AS padded, CAST(list_sum(list_transform(string_split(c_name, ''), lambda x: ascii(x))) AS BIGINT) AS hash, least(c_custkey, c_nationkey) AS low, greatest(c_custkey, c_nationkey) AS high FROM customer""")
def scalar_utils(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(c.alias("id"), scalars.log2_floor(c).alias("log2"), scalars.num_digits(c).alias("digits"), scalars.zero_padded(c).alias("padded"), scalars.string_hash(F.col("c_name")).alias("hash"), F.least(c, "c_nationkey").alias("low"), F.greatest(c, "c_nationkey").alias("high"))


@_query(f"WITH {G2_SQL} SELECT src, dst, least(src, dst) AS one, CASE WHEN least(src, dst) = src THEN dst ELSE src END AS other, src < dst AS before, src + dst AS total, true AS random_inside FROM g")
def edge_utils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The helpers of edges, and random numbers in their range."""
    u, v = F.col("src"), F.col("dst")
    one = scalars.edge_either(u, v)
    drawn = g2(spark, sf_dir).withColumn("r", scalars.random_number(3, 9, 7))
    return drawn.select("src", "dst", one.alias("one"), scalars.edge_other(u, v, one).alias("other"), (scalars.edge_order(u, v) < scalars.edge_order(v, u)).alias("before"), scalars.plus(u, v).alias("total"), F.col("r").between(3, 8).alias("random_inside"))


@_query(
    f"""{_REFINED}, zc AS (SELECT count(*) AS m, count(DISTINCT src) AS n_sources, max(greatest(src, dst)) AS top FROM g), bc AS (SELECT count(*) AS c FROM e WHERE ps <> pd),
hc AS (SELECT count(*) AS c FROM (SELECT src FROM g GROUP BY src HAVING count(*) >= 1000)), tc AS (SELECT count(*) AS c FROM g JOIN f p ON p.v = g.src JOIN f q ON q.v = g.dst WHERE p.part <> q.part)
SELECT u.name, CAST(u.value AS DOUBLE) AS value FROM zc, bc, hc, tc, LATERAL (VALUES ('n_entries', m), ('n_edges', m // 2), ('combined_pairs', m - n_sources), ('hub_degree', 1000), ('n_hubs', hc.c), ('batch_size', top // 8 + top % 8),
  ('cut_entries_before', bc.c), ('edge_cut_before', bc.c // 2), ('cut_entries', tc.c), ('edge_cut', tc.c // 2)) u(name, value)"""
)
def job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a whole job over a graph of many files reports, but for its seconds."""
    path = rank.table(spark)
    sinks.write_edges(g2(spark, sf_dir), path)
    return PartitionJob(path, "edgelist", 2, threads=4, output=rank.table(spark)).run(spark).metrics.where("not endswith(name, '_s')")


@_query("SELECT event_type AS name, max(value) AS longest, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY event_type")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name"), "value")
    return metrics.run_report(rows).join(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name").select("name", "longest", F.round("total", 2).alias("total"), "n")
