"""One query for each text operator, over whole tables and with production settings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps, contentsort, conversations, decontaminate, fixity, html, linededup, packing, quality, rollups, search, sharding, simhash
from .common import checkpoint_dir, checkpointed, read_table, remove

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model, threshold=0.3).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the whole text of every document whose id is divisible by 100."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(search.build_index(docs), queries, k=10).withColumn("score", F.round("score", 4))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(read_table(spark, sf_dir, "documents"), n_shards=16)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, radius=4)


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their words, then revised to tokenizer ids, then without toxic ones; the revision is sent twice."""
    docs = read_table(spark, sf_dir, "documents")
    toxic = read_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    root = f"{checkpoint_dir(spark)}/rollups-{uuid.uuid4().hex}"
    book = rollups.TokenRollup(spark, root)
    book.commit("1-words", rollups.word_counts(docs))
    for _ in range(2):
        book.commit("2-bpe", rollups.tokenizer_counts(docs, TOKENIZER, "word_bpe_49k"))
    takedown = toxic.select(F.lit("delete").alias("op"), "doc_id", *[F.lit(None).cast("string").alias(k) for k in rollups.KEYS], F.lit(0).alias("tokens"))
    book.commit("3-takedown", takedown)
    totals = checkpointed(book.totals())
    remove(spark, root)
    return totals


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, min_docs=10, min_chars=1, keep_text=False)


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records against a replica in which every page of a url ending in 7 has its last character lost."""
    pages = read_table(spark, sf_dir, "pages")
    hurt = F.when(F.col("url").endswith("7"), F.expr("left(html, greatest(char_length(html) - 1, 0)) || '#'")).otherwise(F.col("html"))
    expected, actual = (fixity.manifest(fixity.warc_records(x)) for x in (pages, pages.withColumn("html", hurt)))
    found, _ = fixity.audit(expected, actual)
    return found


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op10_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_bitmap_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    length = F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")
    date = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 365
    rows = docs.select("doc_id", "source", "lang", length.alias("length"), date.alias("date"))
    return bitmaps.bitmap_layout(rows, ("source", "lang", "length", "date"), reach=(0, 0, 2, 2), bins=16, file_rows=1000)


def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.content_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged row by row, with their faults, the cheapest edits and a digest of the repaired turns."""
    whole = read_table(spark, sf_dir, "conversations")
    turns = conversations.damaged(whole)
    found = checkpointed(conversations.audits(turns, whole.select("conv_id")))
    digests = conversations.repaired_digests(turns, found).withColumnRenamed("conv_id", "repaired_id")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("repaired_id"))).drop("repaired_id")


def queries() -> dict[str, Query]:
    ops = (op1_rule_quality, op2_bm25_top_k, op3_kd_shards, op4_best_fit_packing, op5_simhash_near_dedup, op6_token_rollups, op7_line_dedup, op8_warc_fixity, op9_html_main_text, op10_spaced_seed_leaks, op11_bitmap_layout, op12_content_sort, op13_conversation_repair)
    return {f.__name__: f for f in ops}


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32 in SQL: the table of 256 values, and the value of an ASCII string.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


def _layout_sql() -> str:
    dims = ("source", "lang", "length", "date")
    cs = ", ".join(f"16 * (rank() OVER (ORDER BY {d} NULLS FIRST) - 1) // (SELECT count(*) FROM v) AS c{i}" for i, d in enumerate(dims))
    z = " + ".join(f"((c{i} >> {b}) & 1) * {1 << (4 * b + 3 - i)}" for b in range(4) for i in range(4))
    near = (0, 0, 2, 2)
    meets = " AND ".join(f"lo{i} <= q.c{i} + {r} AND hi{i} >= q.c{i} - {r}" for i, r in enumerate(near))
    inside = " AND ".join(f"m.c{i} BETWEEN q.c{i} - {r} AND q.c{i} + {r}" for i, r in enumerate(near))
    bounds = " || ',' || ".join(f"lo{i} || ',' || hi{i}" for i in range(4))
    return f"""
WITH {_CRC_TABLE}, v AS (SELECT doc_id, source, lang, coalesce(strlen(text), -1) AS length, {_crc("coalesce(CAST(doc_id AS VARCHAR), '')")} % 365 AS date FROM documents, crc),
c AS (SELECT doc_id, {cs} FROM v), z AS (SELECT *, CAST({z} AS BIGINT) AS z FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position, position // 1000 AS file FROM z),
f AS (SELECT file, {", ".join(f"min(c{i}) AS lo{i}, max(c{i}) AS hi{i}" for i in range(4))} FROM p GROUP BY file),
q AS (SELECT DISTINCT z, c0, c1, c2, c3 FROM p), m AS (SELECT DISTINCT file, c0, c1, c2, c3 FROM p),
t AS (SELECT q.z, count(*) AS n FROM q JOIN f ON {meets} GROUP BY q.z), h AS (SELECT q.z, count(DISTINCT m.file) AS n FROM q JOIN m ON {inside} GROUP BY q.z)
SELECT p.doc_id, p.z, p.position, p.file, t.n AS files_touched, h.n AS files_matching, {bounds} AS file_bounds FROM p JOIN f ON f.file = p.file JOIN t ON t.z = p.z JOIN h ON h.z = p.z"""


def _repair_sql() -> str:
    """The repair from the last row to the first, all conversations at once: for each state (f0 nothing yet, f1 after the system turn, f2 user due, f3 assistant due) the least (cost, audit) of the rest."""
    add = lambda q, cost, edit: f"{{'c': b.f{q}.c + {cost}, 'e': '{edit}' || b.f{q}.e}}"
    own = []
    for q in range(4):
        due = 2 if q == 3 else 3
        keep = f"CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN i = '{'a' if q == 3 else 'u'}' THEN {add(due, 'cut', 'K')}" + (f" WHEN i = 's' THEN {add(1, 'cut', 'K')}" if q == 0 else "") + " END"
        rerole = f"CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE {add(due, 'cut + 2', 'R')} END"
        own.append(f"list_min([{add(q, 3, 'D')}, {keep}, {rerole}]) AS g{q}")
    into = {0: (3, 2), 1: (3, 2), 2: (3, 2), 3: (2, 3)}
    best = ", ".join(f"list_min([g{q}, {{'c': g{a}.c + 2, 'e': 'I' || g{a}.e}}, {{'c': g{b}.c + 4, 'e': 'II' || g{b}.e}}])" for q, (a, b) in into.items())
    space = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    core = f"rtrim(text, {_SPACE})"
    return f"""
WITH RECURSIVE {_CRC_TABLE}, x AS (SELECT conv_id, turn, {space('role')} AS role, {space('text')} AS text, {_crc(space('conv_id') + " || ':' || " + space('turn'))} % 20 AS hurt FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role, CASE hurt WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN hurt = 3 THEN 2 ELSE 1 END)) AS copy FROM x WHERE hurt <> 0),
o AS (SELECT *, left(role, 1) AS i, row_number() OVER w AS nr, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
r AS MATERIALIZED (SELECT *, CASE WHEN {core} = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right({core}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'ok' END AS fault, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut, lag(i) OVER (PARTITION BY conv_id ORDER BY nr) || i AS pair FROM o),
b(conv_id, nr, f0, f1, f2, f3) AS (
  SELECT DISTINCT conv_id, n + 1, {{'c': 0::BIGINT, 'e': ''}}, {{'c': 4::BIGINT, 'e': 'II'}}, {{'c': 0::BIGINT, 'e': ''}}, {{'c': 2::BIGINT, 'e': 'I'}} FROM o
  UNION ALL
  SELECT conv_id, nr, {best} FROM (SELECT r.conv_id, r.nr, {", ".join(own)} FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.nr = b.nr - 1)),
e AS (SELECT conv_id, f0.c AS cost, f0.e AS audit FROM b WHERE nr = 1),
l AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, length(replace(left(audit, j), 'I', '')) AS nr FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM e)),
k AS (SELECT l.conv_id, l.j, l.edit, r.role, r.i, r.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.j) - 1 AS place FROM l LEFT JOIN r ON l.edit <> 'I' AND r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.nr = l.nr WHERE l.edit <> 'D'),
y AS (SELECT *, max(CASE WHEN place = 0 AND edit = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM k),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS repaired_sha256 FROM y GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit, coalesce(h.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""


#: DuckDB SQL for the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_bm25_top_k": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents),
f AS (SELECT doc_id, w, count(*) AS f FROM t GROUP BY doc_id, w), l AS (SELECT doc_id, sum(f) AS len FROM f GROUP BY doc_id),
a AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(len) FROM l) / (SELECT count(*) FROM documents) AS mean_len),
d AS (SELECT w, count(*) AS n FROM f GROUP BY w), q AS (SELECT doc_id AS query_id, w, f AS qf FROM f WHERE doc_id % 100 = 0),
s AS (SELECT q.query_id, f.doc_id, sum(q.qf * ln(1 + (a.n_docs - d.n + 0.5) / (d.n + 0.5)) * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * l.len / a.mean_len))) AS score
  FROM q JOIN d ON d.w = q.w JOIN f ON f.w = q.w JOIN l ON l.doc_id = f.doc_id CROSS JOIN a GROUP BY q.query_id, f.doc_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
SELECT query_id, rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 10""",
    "op7_line_dedup": f"""
WITH l AS (SELECT doc_id, u.i AS i, u.line AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
  LATERAL (SELECT unnest(d.parts) AS line, unnest(range(len(d.parts))) AS i) u),
k AS (SELECT doc_id, i, line, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
n AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(n.key) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN n.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN n ON n.key = k.key GROUP BY k.doc_id""",
    "op8_warc_fixity": """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS a, CASE WHEN url LIKE '%7' THEN left(html, greatest(length(html) - 1, 0)) || '#' ELSE html END AS b FROM pages),
h AS (SELECT page_id, coalesce(page_id // 512, -1) AS segment, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
  chr(13) || chr(10) || chr(13) || chr(10) AS gap, a, coalesce(b, '') AS b FROM p),
r AS (SELECT segment, page_id, 'x' AS side, head || strlen(a) || gap || a || gap AS r FROM h UNION ALL SELECT segment, page_id, 'y', head || strlen(b) || gap || b || gap FROM h),
d AS (SELECT segment, page_id, side, CAST(strlen(r) AS BIGINT) AS length, sha256(r) AS digest FROM r),
o AS (SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length) OVER w - length AS BIGINT) AS "offset" FROM d WINDOW w AS (PARTITION BY side, segment ORDER BY page_id NULLS FIRST, digest))
SELECT x.segment, x.position, x.page_id, x."offset", x.length, CASE WHEN x.digest = y.digest THEN 'moved' ELSE 'corrupt' END AS finding, x.digest AS expected_digest, y.digest AS actual_digest
FROM o x JOIN o y ON x.side = 'x' AND y.side = 'y' AND y.segment = x.segment AND y.position = x.position WHERE x.digest <> y.digest OR x."offset" <> y."offset" OR x.length <> y.length""",
    "op11_bitmap_layout": _layout_sql(),
    "op12_content_sort": f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {_UPPER}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM n WINDOW w AS (PARTITION BY t)""",
    "op13_conversation_repair": _repair_sql(),
}
