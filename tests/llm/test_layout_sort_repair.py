"""Bitmap layout, content sort and conversation repair against plain Python, with odd rows and small limits."""

import hashlib
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from cutloom.llm import bitmaps, contentsort, conversations

# Bitmap layout.


def plain_layout(rows, reach, bins, file_rows):
    """rows: (id, *values) to (id, z, position, file, touched, matching, bounds)."""
    dims, n = len(reach), len(rows)
    low = lambda v: (v is not None, v if v is None or not isinstance(v, str) else v.encode(), 0)
    less = [[sum(low(o[1 + d]) < low(r[1 + d]) for o in rows) for d in range(dims)] for r in rows]
    cells = [tuple(bins * s // n for s in x) for x in less]
    bits = max(1, (bins - 1).bit_length())
    z = [int("".join(f"{c:0{bits}b}"[b] for b in range(bits) for c in cell), 2) for cell in cells]
    order = sorted(range(n), key=lambda i: (z[i], rows[i][0] is not None, rows[i][0] or 0))
    files = {}
    for at, i in enumerate(order):
        files.setdefault(at // file_rows, []).append(cells[i])
    bounds = {f: [(min(c[d] for c in x), max(c[d] for c in x)) for d in range(dims)] for f, x in files.items()}
    out = []
    for at, i in enumerate(order):
        q = cells[i]
        touched = sum(all(lo <= q[d] + reach[d] and hi >= q[d] - reach[d] for d, (lo, hi) in enumerate(b)) for b in bounds.values())
        matching = sum(any(all(abs(c[d] - q[d]) <= reach[d] for d in range(dims)) for c in x) for x in files.values())
        out.append((rows[i][0], z[i], at, at // file_rows, touched, matching, ",".join(f"{lo},{hi}" for lo, hi in bounds[at // file_rows])))
    return out


@pytest.mark.parametrize(("bins", "file_rows", "n"), [(16, 2, 300), (8, 5, 200), (5, 1000, 90)])
def test_bitmap_layout(spark, bins, file_rows, n):
    r = random.Random(n)
    rows = [(r.choice([i, i, None]), "hot" if r.random() < 0.5 else r.choice(["é", "z", "a", "", None, f"s{i}"]), r.choice([None, 1, 2, r.randrange(10**6)])) for i in range(n)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, s string, v long").withColumns({"z": F.lit(1), "position": F.lit("x"), "file": F.lit(2)}).repartition(3)
    got = [tuple(x) for x in bitmaps.bitmap_layout(df, ("s", "v"), (0, 2), bins, file_rows).collect()]
    assert sorted(got, key=repr) == sorted(plain_layout(rows, (0, 2), bins, file_rows), key=repr)


def test_bitmap_layout_edges(spark):
    one = spark.createDataFrame([(7, "a", None)], "doc_id long, s string, v long")
    assert [tuple(x) for x in bitmaps.bitmap_layout(one, ("s", "v"), (1, 1)).collect()] == [(7, 0, 0, 0, 1, 1, "0,0,0,0")]
    assert bitmaps.bitmap_layout(one.limit(0), ("s", "v"), (1, 1)).count() == 0
    with pytest.raises(ValueError, match="cells"):
        bitmaps.clustered(one, ("s", "v"), bins=2048)


# Content sort.


def plain_dedup(rows, largest):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out, kept = [], set()
    for i, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        first = i == keep and low(t) not in kept
        if first:
            kept.add(low(t))
        out.append((i, keep, len(groups[low(t)]), first, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("largest", "least"), [(True, 1 << 15), (True, 200), (False, 300)])
def test_content_dedup(spark, rows, monkeypatch, largest, least):
    """Also with so low a limit that many groups are dealt over several places."""
    monkeypatch.setattr(contentsort, "_LEAST", least)
    mine = [(r[0], r[1]) for r in rows] + [(1000 + i, "COPY of É one") for i in range(60)] + [(1000, "copy OF É one"), (1001, "copy of é one"), (None, "copy of É one"), (None, "nameless"), (None, "NAMELESS")]
    mine += [(2000 + i, "a" * 70 + f"{i % 7:05d}" + "Z" * 70) for i in range(50)]
    df = spark.createDataFrame(mine, "doc_id long, text string").withColumns({"place": F.lit(1), "norm": F.lit("x"), "KEY": F.lit(2)}).repartition(5)
    got = sorted((tuple(x) for x in contentsort.content_dedup(df, "largest" if largest else "smallest").collect()), key=repr)
    assert got == plain_dedup(mine, largest)


def test_content_dedup_edges(spark, empty):
    assert contentsort.content_dedup(empty).count() == 0
    with pytest.raises(ValueError, match="keep"):
        contentsort.content_dedup(empty, "first")


def test_content_dedup_is_native(spark, docs):
    plan = contentsort.content_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Conversation repair.


def all_repairs(rows):
    """The cheapest and then least audit by listing every way to edit up to three rows (initial, fault)."""
    best = None
    fills = ["", "u", "a", "ua", "au"]
    for gaps in product(fills, repeat=len(rows) + 1):
        for ways in product(*[["D"] if f in (1, 2) else ["D", "K", "Ru", "Ra"] for _, f in rows]):
            cost, audit, roles = 0, "", ""
            for gap, way, row in zip(gaps, (*ways, None), (*rows, None), strict=True):
                cost, audit, roles = cost + 2 * len(gap), audit + "I" * len(gap), roles + gap
                if way is None:
                    continue
                audit += way[0]
                if way == "D":
                    cost += 3
                else:
                    cost += (row[1] == 3) + 2 * (way != "K")
                    roles += row[0] if way == "K" else way[1]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_trie_finds_the_least_audit():
    words = [w for n in range(3) for w in product(*[[(r, f) for r in range(4) for f in range(4)]] * n)] + random.Random(4).sample(list(product(*[[(r, f) for r in range(4) for f in (0, 1, 3)]] * 3)), 150)
    trie, got = conversations.Trie(), {}
    for w in sorted("".join(conversations.letter(r, f) for r, f in reversed(w)) for w in words):
        got[w] = trie.answer(w)[:2]
    for w in words:
        key = "".join(conversations.letter(r, f) for r, f in reversed(w))
        assert got[key] == all_repairs([("sua?"[r], f) for r, f in w]), w
    assert trie.made < sum(map(len, got)) / 2


def plain_faults(turns):
    """Rows (turn, role, text) in order, with faults, and the counts."""
    order = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
    seen, out = set(), []
    for turn, role, text in order:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


@pytest.fixture(scope="module")
def talks():
    r = random.Random(8)
    texts = ["Hello.", "Yes!\n", "cut", "  ", "", "Why?", "日本。", "x" * 30_000 + ".", "a. \x85"]
    rows = []
    for c in [*range(60), None]:
        turns = [(r.choice([i, i, i, 3, None]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), r.choice([*texts, None])) for i in range(r.randrange(9))]
        rows += [(c, *t) for t in turns]
    rows += [(77, i, "user" if i % 2 else "assistant", f"turn {i}.") for i in range(1500)]
    rows += rows[:20]
    return rows


def test_repair(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumns({"digest": F.lit(1), "kind": F.lit("x"), "copy": F.lit(2)}).repartition(4)
    ids = spark.createDataFrame([(500,), (500,), (3,)], "conv_id long")
    found = conversations.audits(df, ids).cache()
    assert {tuple(x) for x in found.where("conv_id = 500").collect()} == {(500, 0, 0, 0, 0, 0, 0, "")}
    convs = {}
    for c, turn, role, text in talks:
        convs.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    digests = {x[0]: x[1] for x in conversations.repaired_digests(df, found).collect()}
    repaired = {}
    for x in conversations.repaired_turns(df, found).orderBy("place").collect():
        repaired.setdefault(x["conv_id"], []).append((x["edit"], x["role"], x["text"]))
    got = {x["conv_id"]: x for x in found.collect()}
    assert set(got) == {*convs, 500, 3}
    assert digests[500] == hashlib.sha256().hexdigest()
    for c, turns in convs.items():
        marked, x = plain_faults(turns), got[c]
        counts = [sum(m[3] == f for m in marked) for f in (1, 2, 3)]
        initials = [m[1][:1] for m in marked]
        numbers = [m[0] for m in marked if m[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905
        assert [x["gaps"], x["blank"], x["duplicate"], x["truncated"], x["illegal"]] == [gaps, *counts, illegal], c
        word = "".join(conversations.letter("sua".find(m[1][:1]) if m[1][:1] and m[1][0] in "sua" else 3, m[3]) for m in reversed(marked))
        assert (x["cost"], x["audit"]) == conversations.Trie().answer(word)[:2]
        # The edits, carried out one by one.
        left, out, cost = list(marked), [], 0
        for e in x["audit"]:
            row = left.pop(0) if e != "I" else None
            cost += {"K": 0, "R": 2, "D": 3, "I": 2}[e] + (e in "KR" and row[3] == 3)
            if e == "D":
                continue
            due = "ua"[(len(out) - (1 if out and out[0][0][:1] == "s" else 0)) % 2]
            out.append((row[1], row[2]) if e == "K" else ({"u": "user", "a": "assistant"}[due], row[2] if row else ""))
        assert not left and cost == x["cost"]
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in out))
        assert [(role, text) for _, role, text in repaired.get(c, [])] == out
        assert digests[c] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = conversations.audits(conversations.damaged(none))
    assert found.count() == 0 and conversations.repaired_turns(none, found).count() == 0


def test_damage(spark):
    """crc32('0:38') % 20 and others worked out by zlib."""
    import zlib

    rows = [(c, t, "assistant", "A. b!") for c in (0, None) for t in (*range(60), None)]
    want = []
    for c, t, role, text in rows:
        hurt = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if hurt == 4 else role, {1: "", 2: "A b"}.get(hurt, text))
        want += [row] * {0: 0, 3: 2}.get(hurt, 1)
    got = [tuple(x) for x in conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
