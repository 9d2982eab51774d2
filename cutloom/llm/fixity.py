"""Merkle fixity audit of WARC replicas.

Every record is digested where it is read; from there on only digests travel. They are dealt by ranges
of segment (one file) and place, so that a segment of any size is spread over tasks, and give positions
and byte offsets by sums over tasks. 16 neighbours at a time become a node over their ordered offset
range, first inside a segment, then over segments, up to one root. Two replicas are compared at the root,
and only the children of nodes that differ are compared further, down to single records. Nodes have 16
children at most, so nothing unbounded is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

FAN = 16


def warc_records(pages: DataFrame, pages_per_segment: int = 512, segment: Column | None = None) -> DataFrame:
    """WARC resource records of web pages: segment, page_id, record.

    `segment` names the file of a page; by default a run of page_ids. Null html is an empty payload, null
    urls are empty, pages without page_id or segment share segment -1; repeated rows are records of their
    own; very long pages are one record each; other columns are ignored.
    """
    payload, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    where = F.floor(F.col("page_id") / pages_per_segment) if segment is None else segment
    return pages.select(F.coalesce(where.cast("long"), F.lit(-1)).alias("segment"), F.col("page_id").cast("long").alias("page_id"), F.concat(head, payload, F.lit("\r\n\r\n")).alias("record"))


def manifest(records: DataFrame) -> DataFrame:
    """The places of records (segment, page_id, record) in their files: segment, position, page_id, offset, length, digest.

    In a segment records follow page_id (null first), then digest; equal ones are interchangeable. A null
    record is an empty one with a null digest. An empty table gives an empty manifest.
    """
    length = F.coalesce(F.octet_length("record").cast("long"), F.lit(0))
    rows = checkpointed(records.select("segment", "page_id", length.alias("length"), F.sha2("record", 256).alias("digest"), F.monotonically_increasing_id().alias("row")))
    order = ("page_id", "digest", "row")
    # The row number also spreads repeated rows over ranges.
    dealt = checkpointed(rows.repartitionByRange("segment", *order).withColumn("task", F.spark_partition_id()))
    run = W.partitionBy("segment", "task").orderBy(*order)
    sums = dealt.groupBy("segment", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    upto = W.partitionBy("segment").orderBy("task")
    before = sums.select("segment", "task", (F.sum("n").over(upto) - F.col("n")).alias("n_before"), (F.sum("bytes").over(upto) - F.col("bytes")).alias("bytes_before"))
    inside = dealt.withColumns({"at": F.row_number().over(run) - 1, "end": F.sum("length").over(run.rowsBetween(W.unboundedPreceding, 0))})
    placed = inside.join(before, ["segment", "task"])
    return placed.select("segment", (F.col("n_before") + F.col("at")).cast("long").alias("position"), "page_id", (F.col("bytes_before") + F.col("end") - F.col("length")).alias("offset"), "length", "digest")


def leaves(places: DataFrame) -> DataFrame:
    """A manifest with a leaf for each record: the hash of its digest and of its offset range."""
    stop = F.col("offset") + F.col("length")
    rows = places.select("segment", "position", "page_id", "offset", "length", "digest")
    return rows.select("*", F.col("offset").alias("start"), stop.alias("stop"), F.sha2(F.concat_ws(":", "offset", stop, F.coalesce("digest", F.lit(""))), 256).alias("hash"))


def _up(over_segments: bool) -> dict[str, Column]:
    """The parent of a node: by 16 neighbours in a segment, or by 16 segments."""
    return {"segment": (F.floor(F.col("segment") / FAN) if over_segments else F.col("segment")).cast("long"), "position": (F.lit(0) if over_segments else F.floor(F.col("position") / FAN)).cast("long")}


def _parents(nodes: DataFrame, over_segments: bool) -> DataFrame:
    """One level up."""
    up = _up(over_segments)
    rows = nodes.select(up["segment"].alias("segment"), up["position"].alias("position"), F.col("segment" if over_segments else "position").alias("child"), "start", "stop", "hash")
    ordered = F.sort_array(F.collect_list(F.struct("child", "start", "stop", "hash")))
    joined = F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", c["child"], c["start"], c["stop"], c["hash"])), ",")
    return rows.groupBy("segment", "position").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(joined, 256).alias("hash"))


def tree(leaf: DataFrame, inner: int, outer: int) -> list[DataFrame]:
    """All levels, leaves first: `inner` levels inside segments, then `outer` levels over segments."""
    levels = [leaf.select("segment", "position", "start", "stop", "hash")]
    for i in range(inner + outer):
        levels.append(checkpointed(_parents(levels[-1], i >= inner)))
    return levels


def _depth(n: int) -> int:
    d = 0
    while FAN**d < n:
        d += 1
    return d


def audit(expected: DataFrame, actual: DataFrame) -> tuple[DataFrame, list[int]]:
    """Records that differ between two replicas, and the number of nodes compared on each level, root first.

    Both are manifests (segment, position, page_id, offset, length, digest). Returns segment, position,
    page_id, offset, length, finding (corrupt: other bytes; moved: other range; missing; extra),
    expected_digest and actual_digest. A null digest counts as corrupt against any other. A manifest that
    names one place twice is no replica and raises ValueError. Empty replicas are no error. Other columns
    are ignored.
    """
    a, b = (checkpointed(leaves(x)) for x in (expected, actual))
    for x in (a, b):
        if not x.groupBy("segment", "position").count().where("count > 1").isEmpty():
            raise ValueError("a manifest names a place twice")
    most = a.select("segment", "position").union(b.select("segment", "position")).agg(F.max("position"), F.max("segment"), F.min("segment")).first()
    inner = _depth((most[0] or 0) + 1)
    outer = _depth(max(1, (most[1] or 0) + 1)) + (1 if (most[2] or 0) < 0 else 0)
    left, right = tree(a, inner, outer), tree(b, inner, outer)
    compared, differing = [], None
    for level in range(inner + outer, -1, -1):
        x, y = left[level], right[level]
        if differing is not None:
            up = _up(level >= inner)
            x, y = (z.withColumns({"up_segment": up["segment"], "up_position": up["position"]}).join(differing, ["up_segment", "up_position"], "left_semi") for z in (x, y))
        both = x.select("segment", "position", F.col("hash").alias("hash_x")).join(y.select("segment", "position", F.col("hash").alias("hash_y")), ["segment", "position"], "full_outer")
        both = checkpointed(both)
        compared.append(both.count())
        differing = both.where("not (hash_x <=> hash_y)").select(F.col("segment").alias("up_segment"), F.col("position").alias("up_position"))
    keys = differing.select(F.col("up_segment").alias("segment"), F.col("up_position").alias("position"))
    x = a.join(keys, ["segment", "position"], "left_semi").select("segment", "position", "page_id", "offset", "length", F.col("digest").alias("expected_digest"), F.lit(1).alias("in_x"))
    y = b.join(keys, ["segment", "position"], "left_semi").select("segment", "position", F.col("page_id").alias("page_y"), F.col("offset").alias("offset_y"), F.col("length").alias("length_y"), F.col("digest").alias("actual_digest"), F.lit(1).alias("in_y"))
    finding = F.when(F.col("in_y").isNull(), "missing").when(F.col("in_x").isNull(), "extra").when(~F.col("expected_digest").eqNullSafe(F.col("actual_digest")), "corrupt").otherwise("moved")
    rows = x.join(y, ["segment", "position"], "full_outer")
    return rows.select("segment", "position", *[F.coalesce(n, f"{n.split('_')[0]}_y").alias(n) for n in ("page_id", "offset", "length")], finding.alias("finding"), "expected_digest", "actual_digest"), compared
