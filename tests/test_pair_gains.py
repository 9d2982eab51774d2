"""The best exchanges on a directed graph with a hub."""

from cutloom.operators import refine


def test_hub_of_incoming_entries(spark):
    """One y takes entries from more x of equal D and lower id than `limit` and the degree of any x."""
    limit = 10
    hub, others = 10_000, range(1000, 1020)
    edges = [(x, hub) for x in range(100)] + [(x, hub + 1) for x in others] + [(hub + 2 + x, x) for x in [*range(100), *others]]
    part = {v: 1 if v >= hub else 0 for e in edges for v in e}
    e = spark.createDataFrame(edges, "src long, dst long")
    a = spark.createDataFrame(list(part.items()), "v long, part int")
    d = {(r["part"], r["v"]): r["d"] for r in refine.d_values(e, a, [(0, 1)]).collect()}
    close = set(edges)
    want = sorted((-(dx + dy - 2 * ((x, y) in close)), x, y) for (p, x), dx in d.items() for (q, y), dy in d.items() if p == 0 and q == 1)[:limit]
    got = [(-r["gain"], r["x"], r["y"]) for r in refine.pair_gains(e, a, 0, 1, limit).collect()]
    assert got == want
