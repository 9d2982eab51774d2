"""Sharding by a k-d tree over document metadata. DataFrame operations only.

The points of the tree are groups of equal texts, weighted by their bytes. Every level splits all
nodes at once: the widest metadata dimension of each node is found by one aggregation, and its
weighted median by a few histogram passes, each of which returns one row for each open node. A group
of copies that weighs more than the tolerance is dealt into chunks, neighbours in every dimension,
so that it stays together unless a cut must go through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, looked_up

BUCKETS = 1 << 11
DIMENSION_BITS = 30
TIE_BITS = 20
CHUNK_BITS = 12


def _position(kinds: dict[str, str], name: str) -> Column:
    """A metadata column as a number; categories are placed by their hash."""
    c = F.col(name)
    if kinds[name] in ("string", "binary", "boolean"):
        return F.when(c.isNull(), F.lit(-1.0)).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 20)).cast("double"))
    return F.coalesce(c.cast("double"), F.lit(-1.0))


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("n_chars", "source", "lang", "doc_id"), tolerance: float = 0.002) -> DataFrame:
    """Puts every document into one of `n_shards` shards of nearly equal bytes.

    `n_shards`, or as many leaves as keep each at `target_bytes` at most (rounded up). Weights are
    UTF-8 bytes plus 1; `tolerance` is the part of a leaf's bytes that an undivided group of equal
    texts may hold.

    Returns doc_id, size, text_crc32, law ("bytes"), shard, slot (gapless from 0 in a shard) and
    grown_shard (null: the law is not `key`). Null texts count as empty ones; null metadata take the
    lowest position; of a text, however long, only its size and hashes go on; repeated rows and repeated doc_ids each get a slot; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    dims = [d for d in dimensions if d in kinds]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            *[_position(kinds, d).alias(f"d{i}") for i, d in enumerate(dims)],
        )
    )
    groups_key = ["h", "size", "text_crc32"]
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes)) if target_bytes else 1
    limit = max(1.0, total / n_shards * tolerance)

    groups = rows.groupBy(*groups_key).agg(F.sum("size").alias("w"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(len(dims))])
    # At most n_shards / tolerance groups are heavy; they alone are divided, by a hash of doc_id. Few are sent to all tasks.
    heavy = checkpointed(
        groups.where(F.col("w") > limit).select(*groups_key, F.least(F.ceil(F.col("w") / F.lit(limit)), F.lit(1 << CHUNK_BITS)).alias("chunks"), *[F.col(f"d{i}").alias(f"g{i}") for i in range(len(dims))])
    )
    dealt = rows.join(F.broadcast(heavy) if n_shards <= 100_000 * tolerance else heavy, groups_key, "left").select(
        "doc_id", *groups_key,
        F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).cast("int").alias("chunk"),
        *[F.coalesce(F.col(f"g{i}"), F.col(f"d{i}")).alias(f"d{i}") for i in range(len(dims))],
    )
    points = dealt.groupBy(*groups_key, "chunk").agg(F.sum("size").alias("w"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(len(dims))])

    scale = points.agg(F.count(F.lit(1)), *[f(f"d{i}") for i in range(len(dims)) for f in (F.min, F.max)]).first()[1:]
    top = float((1 << DIMENSION_BITS) - 1)
    tie = F.shiftleft(F.pmod("h", F.lit(1 << TIE_BITS)), CHUNK_BITS) + F.col("chunk")
    for i in range(len(dims)):
        low, high = (scale[2 * i], scale[2 * i + 1]) if scale[0] is not None else (0.0, 0.0)
        step = top / (high - low) if high > low else 0.0
        points = points.withColumn(f"d{i}", F.floor((F.col(f"d{i}") - F.lit(low)) * F.lit(step)).cast("long"))
    if not dims:
        points = points.withColumn("d0", F.lit(0).cast("long"))
    n_dims = max(1, len(dims))
    points = checkpointed(points.select(*groups_key, "chunk", "w", tie.alias("tie"), *[f"d{i}" for i in range(n_dims)], F.lit(0).alias("node"), F.lit(0).alias("first")))

    leaves = {0: n_shards}
    while any(k > 1 for k in leaves.values()):
        cuts = _cuts(points, leaves, n_dims, limit)
        width = max(leaves) + 1
        dim = looked_up([cuts[n][0] if n in cuts else None for n in range(width)], F.col("node"))
        cut = looked_up([cuts[n][1] if n in cuts else None for n in range(width)], F.col("node"))
        half = looked_up([leaves.get(n, 1) // 2 for n in range(width)], F.col("node"))
        right = F.coalesce((_key(n_dims, dim) > cut).cast("int"), F.lit(0))
        points = points.withColumns({"first": F.col("first") + (right * half).cast("int"), "node": F.col("node") * 2 + right})
        leaves = {m: k for n, k0 in leaves.items() for m, k in ([(2 * n, k0 // 2), (2 * n + 1, k0 - k0 // 2)] if n in cuts else [(2 * n, 1)])}

    placed = dealt.join(points.select(*groups_key, "chunk", F.col("first").alias("shard")), [*groups_key, "chunk"])
    blocks = max(1, min(4096, -(-n_rows // (n_shards * 20_000))))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)).cast("int"))
    starts = placed.groupBy("shard", "block").count().select("shard", "block", (F.sum("count").over(W.partitionBy("shard").orderBy("block")) - F.col("count")).alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "h")) - 1
    return placed.withColumn("inside", inside).join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _key(n_dims: int, dim: Column) -> Column:
    """The place of a point along the dimension that its node is split by; ties are told apart by the text's hash."""
    d = F.element_at(F.array(*[F.col(f"d{i}") for i in range(n_dims)]), dim.cast("int") + 1)
    return F.shiftleft(d, TIE_BITS + CHUNK_BITS) + F.col("tie")


def _cuts(points: DataFrame, leaves: dict[int, int], n_dims: int, limit: float) -> dict[int, tuple[int, int]]:
    """For each node of several leaves, the widest dimension and the key up to which points go left."""
    stats = points.groupBy("node").agg(F.sum("w").alias("w"), *[f(f"d{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    open_, cuts = {}, {}
    for s in stats:
        if leaves.get(s["node"], 1) < 2:
            continue
        dim = max(range(n_dims), key=lambda i: (s[f"hi{i}"] - s[f"lo{i}"], -i))
        shift = TIE_BITS + CHUNK_BITS
        open_[s["node"]] = {"dim": dim, "lo": s[f"lo{dim}"] << shift, "hi": ((s[f"hi{dim}"] + 1) << shift) - 1, "below": 0, "goal": max(1, s["w"] * (leaves[s["node"]] // 2) // leaves[s["node"]])}
    while open_:
        width = max(open_) + 1
        get = lambda k: looked_up([open_[n][k] if n in open_ else None for n in range(width)], F.col("node"))  # noqa: B023, E731
        for x in open_.values():
            x["width"] = max(1, -(-(x["hi"] - x["lo"] + 1) // BUCKETS))
        near = points.withColumns({"key": _key(n_dims, get("dim")), "lo": get("lo"), "hi": get("hi"), "width": get("width")}).where("key between lo and hi")
        hist = near.groupBy("node", F.expr("(key - lo) div width").alias("b")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("w").over(W.partitionBy("node").orderBy("b")) + get("below")
        median = hist.withColumns({"upto": upto, "goal": get("goal")}).where("upto >= goal and upto - w < goal").collect()
        for r in median:
            x = open_[r["node"]]
            lo = x["lo"] + r["b"] * x["width"]
            hi = min(x["hi"], lo + x["width"] - 1)
            below = r["upto"] - r["w"]
            if x["width"] == 1 or r["n"] < 2 or r["w"] <= limit / 4:
                cuts[r["node"]] = (x["dim"], hi if r["upto"] - x["goal"] <= x["goal"] - below else lo - 1)
                del open_[r["node"]]
            else:
                x |= {"lo": lo, "hi": hi, "below": below}
    return cuts
