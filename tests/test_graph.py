"""The seven-vertex graph and small made-up ones against values worked out by hand or by plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cutloom.functions import scalars
from cutloom.model import batch_size, check_format, check_parts, check_range, hub_degree
from cutloom.operators import assign, coarsen, iterate, metrics, refine, relabel, store
from cutloom.plans.job import PartitionJob
from cutloom.sources import sinks, text
from cutloom.streaming import edges as streams

LINES = ["#7 11", " 5 3 2", " 1 3 4", " 5 4 2 1", " 2 3 6 7", " 1 3 6", " 5 4 7", " 6 4"]


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("graph") / "g"
    path.write_text("\n".join(LINES) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def metis(spark, sample):
    return text.read_graph(spark, sample, "metis").cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_metis_counts(metis):
    assert metis.count() == 22
    assert metrics.vertex_count(metis).first()[0] == 7
    assert metrics.combined_pairs(metis).first()[0] == 15
    assert tuple(metrics.graph_stats(metis).first()) == (7, 22, 11)


@pytest.mark.parametrize(("k", "sizes", "cut"), [(2, [3, 4], 12), (3, [2, 3, 2], 20), (4, [1, 2, 2, 2], 20)])
def test_hash_partition(metis, k, sizes, cut):
    a = assign.hash_assign(metis, k)
    assert [n for _, n in rows(metrics.part_sizes(a), "part", "n_vertices")] == sizes
    assert tuple(metrics.edge_cut(metis, a).first()) == (cut, cut // 2)
    assert sum(n for _, n in rows(metrics.edge_cut_per_part(metis, a), "part", "cut_entries")) == cut


def test_d_values(metis):
    a = assign.hash_assign(metis, 2)
    assert rows(refine.d_values(metis, a, [(0, 1)]), "v", "d") == [(1, -1), (2, 1), (3, 0), (4, 0), (5, -1), (6, 1), (7, 2)]
    a = assign.hash_assign(metis, 3)
    assert rows(refine.d_values(metis, a, [(0, 1)]), "v", "d") == [(1, -1), (3, 0), (4, 0), (6, 1), (7, 0)]
    assert rows(refine.d_values(metis, a, [(0, 2)]), "v", "d") == [(2, -1), (3, 0), (5, 1), (6, -1)]
    assert rows(refine.d_values(metis, a, [(1, 2)]), "v", "d") == [(1, 1), (2, 1), (4, -2), (5, -1)]


def test_static_refinement(metis):
    a = assign.hash_assign(metis, 2)
    assert rows(refine.swaps(metis, a, [(0, 1)]), "step", "x", "y", "gain") == [(0, 2, 7, 3), (1, 6, 3, 1)]
    final = refine.refine(metis, a, 2)
    assert {v for v, p in rows(final, "v", "part") if p == 1} == {1, 2, 5, 6}
    assert metrics.edge_cut(metis, final).first()["edge_cut"] == 6
    for k in (3, 4):
        a = assign.hash_assign(metis, k)
        assert rows(refine.refine(metis, a, k), "v", "part") == rows(a, "v", "part")
    assert refine.refine(metis, a, 4, "none") is a


def test_adjlist_reading(spark, sample):
    g = text.read_graph(spark, sample, "adjlist")
    assert sorted({s for s, _ in rows(g, "src", "dst")}) == [1, 2, 5, 6]
    assert g.count() == 15
    assert metrics.combined_pairs(g).first()[0] == 11
    a = assign.hash_assign(g, 2)
    assert tuple(metrics.edge_cut(g, a).first()) == (8, 4)
    assert rows(refine.swaps(g, a, [(0, 1)]), "step", "x", "y", "gain") == [(0, 4, 3, 8), (1, 6, 7, 3)]
    assert metrics.edge_cut(g, refine.refine(g, a, 2)).first()["edge_cut"] == 3


def test_relabel(metis):
    m = relabel.relabel_map(assign.hash_assign(metis, 2))
    assert rows(m, "v", "new_id") == [(1, 4), (2, 1), (3, 5), (4, 2), (5, 6), (6, 3), (7, 7)]
    assert rows(relabel.part_boundaries(assign.hash_assign(metis, 2)), "part", "upper") == [(0, 4), (1, 8)]
    assert rows(relabel.part_boundaries(assign.hash_assign(metis, 3)), "part", "upper") == [(0, 3), (1, 6), (2, 8)]
    new = rows(relabel.relabel_edges(metis, m), "src", "dst")
    assert new[:8] == [(1, 2), (1, 4), (1, 5), (2, 1), (2, 3), (2, 5), (2, 7), (3, 2)]
    assert len(new) == 22
    assert relabel.source_id(m).first()[0] is None


def test_contraction(spark, metis):
    cmap = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2), (7, 3)], "v long, cv long")
    got = {(s, d): w for s, d, w in rows(coarsen.contract(coarsen.weighted(metis), cmap), "src", "dst", "w")}
    want = {(0, 1): 3, (0, 2): 1, (1, 2): 2, (1, 3): 1, (2, 3): 1}
    assert got == want | {(b, a): w for (a, b), w in want.items()}
    assert [w for _, w in rows(coarsen.contract_weights(coarsen.unit_weights(metis), cmap), "v", "vwgt")] == [2, 2, 2, 1]
    m = dict(rows(coarsen.random_matching(metis), "v", "mate"))
    assert all(m[m[v]] == v for v in m)
    assert coarsen.coarsen(metis, 3)[-1][1].agg(F.sum("vwgt")).first()[0] == 7


def plain_greedy(dx, dy, near):
    out, dx, dy = [], dict(dx), dict(dy)
    while True:
        best = min(((-(dx[x] + dy[y] - 2 * (y in near.get(x, ()))), x, y) for x in dx for y in dy), default=None)
        if best is None or best[0] >= 0:
            return out
        out.append((best[1], best[2], -best[0]))
        del dx[best[1]], dy[best[2]]


def plain_dynamic(dx, dy, near, weight):
    """`plain_greedy`, one exchange at a time, with D recounted after each."""
    out, dx, dy = [], dict(dx), dict(dy)
    while (found := plain_greedy(dx, dy, near)[:1]):
        x, y, gain = found[0]
        del dx[x], dy[y]
        for side, same, other in ((dx, x, y), (dy, y, x)):
            for v in side:
                side[v] += 2 * weight.get((same, v), 0) - 2 * weight.get((other, v), 0)
        out.append((x, y, gain))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_buckets_of_gains_match_plain_search(seed):
    r = random.Random(seed)
    dx = {v: r.randint(-3, 4) for v in range(r.randint(0, 14))}
    dy = {100 + v: r.randint(-3, 4) for v in range(r.randint(0, 14))}
    ids = [*dx, *dy]
    weight = {(u, v): r.randint(1, 3) for u in ids for v in ids if u != v and r.random() < r.choice([0.1, 0.5, 0.9])}
    near = defaultdict(set)
    for x, y in weight:
        if x in dx and y in dy:
            near[x].add(y)
    assert refine.greedy_dynamic(dx, dy, near, weight) == plain_dynamic(dx, dy, near, weight)
    assert refine.greedy_dynamic(dx, dy, near, {}) == plain_greedy(dx, dy, near)


def test_dynamic_takes_entries_of_a_block_after_the_other(spark):
    r = random.Random(6)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(500)]
    g = edges_of(spark, [p for u, v in links if u != v for p in ((u, v), (v, u))])
    a = assign.hash_assign(g, 2)
    d = refine.d_values(g, a, [(0, 1)]).collect()
    dx, dy = ({x["v"]: x["d"] for x in d if x["part"] == p} for p in (0, 1))
    near, weight = defaultdict(set), defaultdict(int)
    for e in g.collect():
        if {e["src"], e["dst"]} <= dx.keys() | dy.keys():
            weight[e["src"], e["dst"]] += 1
            if e["src"] in dx and e["dst"] in dy:
                near[e["src"]].add(e["dst"])
    want = plain_dynamic(dx, dy, near, weight)
    assert len(want) > 10
    got = rows(refine.swaps(g, a, [(0, 1)], "dynamic", block=16), "step", "x", "y", "gain")
    assert got == [(i, *w) for i, w in enumerate(want)]
    # A task that knows some vertices only stops before the first exchange of another one.
    linked = defaultdict(list)
    for (u, v), n in weight.items():
        linked[u].append((v, n))
    known = {v for x, y, _ in want[:5] for v in (x, y)}
    some = list(refine.dynamic_steps(refine.Side(dx), refine.Side(dy), {x: n for x, n in near.items() if x in known}, lambda u: linked[u], known.__contains__))
    assert some == want[:5]


def test_dynamic_keeps_sizes_and_improves(metis):
    a = assign.hash_assign(metis, 3)
    b = refine.refine(metis, a, 3, "dynamic", accept="improve")
    assert rows(metrics.part_sizes(a), "part", "n_vertices") == rows(metrics.part_sizes(b), "part", "n_vertices")
    assert metrics.edge_cut(metis, b).first()[0] <= metrics.edge_cut(metis, a).first()[0]
    c = refine.refine(metis, a, 3, schedule="rounds", window=2)
    assert rows(metrics.part_sizes(c), "part", "n_vertices") == rows(metrics.part_sizes(a), "part", "n_vertices")


def test_rounds_are_disjoint():
    for k in (2, 3, 4, 7, 8):
        seen = [p for r in refine.disjoint_rounds(k) for p in r]
        assert sorted(seen) == [(a, b) for a in range(k) for b in range(a + 1, k)]
        assert all(len({v for p in r for v in p}) == 2 * len(r) for r in refine.disjoint_rounds(k))


def test_edge_cases(spark):
    empty = edges_of(spark, [])
    assert metrics.edge_cut(empty, assign.hash_assign(empty, 2)).first()[0] == 0
    assert refine.refine(empty, assign.hash_assign(empty, 2), 2).count() == 0
    g = edges_of(spark, [(1, 1), (1, 2), (1, 2), (3, 2)])
    a = assign.hash_assign(g, 2)
    assert tuple(metrics.edge_cut(g, a).first()) == (3, 1)
    assert rows(metrics.degree(g), "v", "deg") == [(1, 3), (3, 1)]
    assert assign.hash_assign(g, 2, 5).count() == 6
    assert assign.hash_assign(g, 100).count() == 3
    with pytest.raises(ValueError, match="outside"):
        check_range(g, 2)
    with pytest.raises(ValueError, match="two parts"):
        check_parts(1)
    with pytest.raises(ValueError, match="format"):
        check_format("csv")
    assert (hub_degree(10), hub_degree(5000), hub_degree(10, 1), batch_size(1000, 4, 8)) == (1000, 5000, 10, 31 + 8)


def plain_rounds(pairs, part, k):
    """Refinement in rounds under D = E - I, walked through vertex by vertex."""
    part = dict(part)
    into = defaultdict(list)
    for u, v in pairs:
        into[v].append(u)
    close = set(pairs)
    for step in refine.disjoint_rounds(k):
        was = dict(part)
        for a, b in step:
            sides = []
            for own, other in ((a, b), (b, a)):
                ext = {v: sum(was[u] == other for u in into[v]) for v in was if was[v] == own}
                sides.append({v: n - sum(was[u] == own for u in into[v]) for v, n in ext.items() if n})
            left, right = sides
            gains = sorted((-(left[x] + right[y] - 2 * ((x, y) in close)), x, y) for x in left for y in right)
            gone = set()
            for loss, x, y in gains:
                if loss < 0 and not gone & {x, y}:
                    gone |= {x, y}
                    part[x], part[y] = b, a
    return part


def test_many_parts(spark):
    r = random.Random(5)
    pairs = sorted({(u, v) for a, b in ((r.randrange(48), r.randrange(48)) for _ in range(150)) if a != b for u, v in ((a, b), (b, a))})
    g = edges_of(spark, pairs)
    a = assign.hash_assign(g, 8)
    want = plain_rounds(pairs, rows(a, "v", "part"), 8)
    assert dict(rows(refine.refine(g, a, 8, schedule="rounds", kind="pair"), "v", "part")) == want != dict(rows(a, "v", "part"))


def test_estimates_do_not_grow_with_steps(spark):
    g = edges_of(spark, [(v, v + 1) for v in range(6)])
    state = assign.vertices(g).withColumn("value", F.col("v"))
    out, _ = iterate.iterate(g, state, F.col("value"), F.min, F.least("value", "message"), max_iter=6)
    assert int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


def test_line_parsers(spark):
    lines = spark.createDataFrame([("# c",), ("% c",), ("",), ("1 2 9",), (" 3\t4 ",), ("5",), ("x 1",), ("6 7 8",)], "value string")
    assert rows(text.parse_edgelist(lines), "src", "dst") == [(1, 2), (3, 4), (6, 7)]
    assert rows(text.parse_adjlist(lines), "src", "dst") == [(1, 2), (1, 9), (3, 4), (6, 7), (6, 8)]
    assert text.count_lines(lines).first()[0] == 6
    whole = text.text_lines(spark.createDataFrame([("f", "3 2\n2\n\n% c\n1 1\n\n")], "file string, value string"))
    assert rows(text.parse_metis(whole), "src", "dst") == [(1, 2), (3, 1), (3, 1)]
    assert rows(text.parse_metis(whole, dedup=True), "src", "dst") == [(1, 2), (3, 1)]
    assert tuple(text.metis_header(whole).first())[1:] == (3, 2)
    pairs = text.text_lines(spark.createDataFrame([("f", "1 2 3\n4 1 2")], "file string, value string"))
    assert rows(text.pair_scan(pairs), "src", "dst") == [(1, 2), (3, 4)]


def test_files_and_round_trips(spark, metis, tmp_path):
    a = assign.hash_assign(metis, 3)
    sinks.write_parts(a, f"{tmp_path}/parts")
    got = text.read_parts(spark, f"{tmp_path}/parts/part=*")
    assert rows(got, "v", "part") == rows(a, "v", "part")
    (tmp_path / "plain").write_text("1\n0\n1\n")
    assert rows(text.read_parts(spark, f"{tmp_path}/plain", "list"), "v", "part") == [(1, 1), (2, 0), (3, 1)]
    (tmp_path / "plain").write_text("0 1\n1 -1\n")
    assert rows(text.read_parts(spark, f"{tmp_path}/plain", "list"), "v", "part") == [(1, 0), (2, 1), (3, 1)]
    assert rows(text.read_parts(spark, f"{tmp_path}/plain"), "v", "part") == [(0, 1), (1, -1)]
    with pytest.raises(ValueError, match="pairs or list"):
        text.read_parts(spark, f"{tmp_path}/plain", "guess")
    (tmp_path / "bounds").write_text("4\n8\n")
    bounds = text.read_bounds(spark, f"{tmp_path}/bounds")
    assert rows(assign.bounds_assign(spark.range(10).withColumnRenamed("id", "v"), bounds), "v", "part")[3:5] == [(3, 0), (4, 1)]
    lines = sinks.metis_lines(metis)
    assert [r["line"].split() for r in lines.collect()][1:] == [sorted(x.split()) for x in LINES[1:]]
    sinks.write_ordered(lines, f"{tmp_path}/metis", "v")
    assert rows(text.read_graph(spark, f"{tmp_path}/metis", "metis"), "src", "dst") == rows(metis, "src", "dst")
    sinks.write_edges(metis, f"{tmp_path}/edges")
    assert rows(text.read_graph(spark, f"{tmp_path}/edges", "edgelist"), "src", "dst") == rows(metis, "src", "dst")
    files = text.list_files(spark, f"{tmp_path}/edges/part-*")
    assert text.capped_files(files, 0).count() == 1
    gap = sinks.metis_lines(edges_of(spark, [(1, 3), (3, 1)]))
    assert [r["line"] for r in gap.collect()] == ["#2 1", " 3 ", "", " 1 "]
    assert rows(sinks.neighbour_filter(edges_of(spark, [(1, 2), (1, 3), (2, 1)])), "src", "dst") == [(1, 2), (2, 1)]
    assert sinks.file_list_name(3) == "input_3gb.list"


def test_files_are_split(spark, tmp_path):
    """METIS lines, part lists and pairs of one file that many tasks read."""
    n = 3000
    (tmp_path / "g").write_text("\n\n#%d 9\n" % n + "\n".join("% comment" if i % 10 == 3 else f"{i} {i + 1}" if i % 3 else "" for i in range(n)))
    (tmp_path / "p").write_text("\n".join(" ".join(str((i + j) % 7) for j in range(1 + i % 4)) for i in range(n)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert text.file_lines(spark, f"{tmp_path}/g").rdd.getNumPartitions() > 4
        data = [i for i in range(n) if i % 10 != 3]
        want = sorted((at + 1, d) for at, i in enumerate(data) if i % 3 for d in (i, i + 1))
        assert rows(text.read_graph(spark, f"{tmp_path}/g", "metis"), "src", "dst") == want
        assert tuple(text.metis_header(text.file_lines(spark, f"{tmp_path}/g")).first())[1:] == (n, 9)
        words = (tmp_path / "p").read_text().split()
        assert rows(text.read_parts(spark, f"{tmp_path}/p", "list"), "v", "part") == [(i + 1, int(w)) for i, w in enumerate(words)]
        pairs = {(int(a), int(b)) for a, b in zip(words[::2], words[1::2], strict=False)}
        assert rows(text.pair_scan(text.file_lines(spark, f"{tmp_path}/p")), "src", "dst") == sorted(pairs)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


def test_ordered_files(spark, metis, tmp_path):
    """METIS lines and part lists over many files: their manifest orders them, and without a fitting one they are refused."""
    path = f"{tmp_path}/metis"
    sinks.write_metis(metis, path, files=5)
    assert len(list((tmp_path / "metis").glob("part-*"))) >= 5
    want = rows(metis, "src", "dst")
    assert rows(text.read_graph(spark, path, "metis"), "src", "dst") == want
    assert tuple(text.check_metis(text.file_lines(spark, path)).first())[1:] == (7, 11, 7, 22)
    both = rows(text.read_graph(spark, [path, path], "metis"), "src", "dst")
    assert both == sorted(want * 2)
    a = assign.hash_assign(metis, 3)
    sinks.write_part_list(a.where("v <> 4"), f"{tmp_path}/list", 9, files=4)
    assert rows(text.read_parts(spark, f"{tmp_path}/list", "list"), "v", "part") == [x for x in rows(a, "v", "part") if x[0] != 4]
    sinks.write_lines(sinks.metis_lines(metis).repartition(3), f"{tmp_path}/loose")
    with pytest.raises(ValueError, match="no _manifest"):
        text.read_graph(spark, f"{tmp_path}/loose", "metis")
    (tmp_path / "metis" / "part-99999-more.txt").write_text("1 2\n")
    with pytest.raises(ValueError, match="not those of its"):
        text.read_graph(spark, path, "metis")
    (tmp_path / "metis" / "part-99999-more.txt").unlink()
    next(f for f in (tmp_path / "metis").glob("part-00002*")).unlink()
    with pytest.raises(ValueError, match="not those of its"):
        text.read_graph(spark, path, "metis")
    (tmp_path / "wrong").write_text("#7 12\n2 3\n1\n1\n")
    with pytest.raises(ValueError, match="header"):
        text.check_metis(text.file_lines(spark, f"{tmp_path}/wrong"))
    none = edges_of(spark, [])
    sinks.write_metis(none, f"{tmp_path}/none", files=2)
    assert text.read_graph(spark, f"{tmp_path}/none", "metis").count() == 0


def test_two_files_share_a_vertex(spark, tmp_path):
    (tmp_path / "a").write_text("1 2\n1 3\n")
    (tmp_path / "b").write_text("1 2\n4 1\n")
    assert rows(metrics.adjacency(text.read_graph(spark, str(tmp_path), "edgelist")), "rank", "nbrs") == [(1, [2, 2, 3]), (4, [1])]


def test_job(spark, sample, tmp_path):
    seen = []

    def sizes(batches):
        for b in batches:
            yield b.assign(deg=b["nbrs"].map(len))[["rank", "part", "deg"]]

    job = PartitionJob(sample, "metis", 2, 7, output=f"{tmp_path}/out", before_refine=lambda a: seen.append(a.count()), after_refine=lambda a: seen.append(a.count()), on_vertices=(sizes, "rank long, part int, deg long"))
    result = job.run(spark)
    m = {r["name"]: r["value"] for r in result.metrics.collect()}
    assert (m["edge_cut_before"], m["edge_cut"], m["combined_pairs"], m["n_hubs"]) == (6, 6, 15, 0)
    assert seen == [7, 7]
    assert rows(result.visited, "rank", "part", "deg")[:2] == [(1, 1, 3), (2, 1, 3)]
    assert rows(text.read_parts(spark, f"{tmp_path}/out/part=*"), "v", "part") == rows(result.assignment, "v", "part")


def test_iteration(spark, metis):
    ids = assign.vertices(metis)
    assert dict(rows(iterate.bfs_levels(metis, ids, 1), "v", "level")) == {1: 0, 2: 1, 3: 1, 5: 1, 4: 2, 6: 2, 7: 3}
    assert {c for _, c in rows(iterate.components(metis, ids), "v", "component")} == {1}
    assert rows(iterate.activate_neighbours(metis, ids.where("v = 7")), "v") == [(4,), (6,)]
    assert iterate.active_count(metis, ids.where("v in (1, 4)")).first()[0] == 7
    assert dict(rows(iterate.neighbour_sum(metis, ids.withColumn("value", F.col("v"))), "v", "total"))[7] == 10
    assert iterate.bfs_levels(metis, ids, 1, max_iter=1).where("level > 1").count() == 0


def test_store(spark, tmp_path):
    box = store.RecordStore(spark, f"{tmp_path}/kv")
    assert box.scan().count() == 0
    box.put(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key long, value string"))
    box.put(spark.createDataFrame([(2, "B")], "key long, value string"))
    box.delete(spark.createDataFrame([(3,)], "key long"))
    assert rows(box.scan(), "key", "value") == [(1, "a"), (2, "B")]
    box.put(spark.createDataFrame([(3, "again")], "key long, value string"))
    assert rows(box.get_range(2, 9), "key", "value") == [(2, "B"), (3, "again")]
    assert rows(box.get(1), "key", "value") == [(1, "a")]


def test_scalars(spark):
    df = spark.createDataFrame([(0, "ab"), (1, ""), (1023, "z"), (1024, "A")], "x long, s string")
    got = df.select("x", scalars.log2_floor(F.col("x")).alias("l"), scalars.num_digits(F.col("x")).alias("d"), scalars.zero_padded(F.col("x")).alias("z"), scalars.string_hash(F.col("s")).alias("h"), scalars.random_number(3, 5, 1).alias("r"))
    assert rows(got, "x", "l", "d", "h") == [(0, 0, 0, 195), (1, 0, 1, 0), (1023, 9, 4, 122), (1024, 10, 4, 65)]
    assert all(r["r"] in (3, 4) and len(r["z"]) == 19 for r in got.collect())
    e = spark.createDataFrame([(5, 2)], "u long, v long").select(scalars.edge_either(F.col("u"), F.col("v")).alias("e"), scalars.edge_other(F.col("u"), F.col("v"), F.lit(5)).alias("o"))
    assert tuple(e.first()) == (2, 2)


def test_hubs_and_scatter(spark):
    g = edges_of(spark, [(0, i) for i in range(1, 40)] + [(1, 2)])
    assert rows(metrics.hubs(g, 10, 5), "v", "deg") == [(0, 39)]
    assert metrics.hubs(g).count() == 0
    placed = assign.scatter_hubs(g, metrics.hubs(g, 10, 5), 8)
    assert placed.where("src = 0").select("bucket").distinct().count() > 1
    assert placed.count() == 40
    chunks = metrics.adjacency_chunks(g, metrics.hubs(g, 10, 5), 8).collect()
    assert sorted((r["rank"], d) for r in chunks for d in r["nbrs"]) == rows(g, "src", "dst")
    assert sum(r["rank"] == 0 for r in chunks) > 4


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1 2\n1 3\n2 3\n")
    q = streams.running_degree(streams.stream_graph(spark, f"{tmp_path}/in", "edgelist")).writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(60)
    assert rows(spark.table("degrees"), "v", "deg") == [(1, 2), (2, 1)]
    with pytest.raises(ValueError, match="stream"):
        streams.stream_graph(spark, str(tmp_path), "metis")
