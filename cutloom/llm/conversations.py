"""Repair of damaged conversations by the cheapest edits.

The roles of a repaired conversation read `(s?(ua)+)?` by their initials: an optional system turn, then
user and assistant in turns. Every row of a conversation is a letter for its role and its fault, and a
conversation is the string of its letters, the last row first. Which edits are cheapest for all rows
from one on depends only on these letters, so the strings are sorted and walked as a prefix trie: the
layer of the dynamic programme that belongs to a prefix is computed once for all strings that share it,
and an answer is read off wherever a string ends. Layers go from the last row to the first because of
ties: of two audits of equal cost the smaller is the one whose first edit is smaller or, if that is the
same, whose rest is, and so only the order of the four states' best rests has to be kept.

Neither step gathers a conversation's texts: letters come out of sorted tasks in pieces, and texts are
merged with their edits as a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, checkpointed

FAULTS = ("ok", "blank", "duplicate", "truncated")
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Classes of roles by initial; others have the last.
INITIALS = "sua"
LEGAL = frozenset(("su", "ua", "au"))
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States: nothing yet, after the system turn, a user turn is due, an assistant turn is due.
START, SYSTEM, USER, ASSISTANT = range(4)
_INSERTED = {START: ASSISTANT, SYSTEM: ASSISTANT, USER: ASSISTANT, ASSISTANT: USER}

#: A layer: for each state what the cheapest edits from here on cost over the cheapest of all, and the place of their audit among the four.
Layer = tuple[tuple[int, ...], tuple[int, ...]]
#: After the last row: nothing, or the turns that are missing.
_END_EDITS = ("", "II", "", "I")
_END: Layer = ((0, 4, 0, 2), (0, 2, 0, 1))


def letter(role: int, fault: int) -> str:
    return chr(65 + 4 * fault + role)


@cache
def step(below: Layer, sign: str) -> tuple[Layer, int, tuple[tuple[str, int], ...]]:
    """The layer of a row in front of `below`, by how much its costs are above those, and for each state the edits and the state they lead to.

    Costs are kept relative to the least of them, so there are few different layers, however long the conversations.
    """
    fault, role = divmod(ord(sign) - 65, 4)
    cost, place = below
    own = []
    for q in range(4):
        ways = [(cost[q] + DELETE, "D", place[q], q)]
        if fault not in (BLANK, DUPLICATE):
            more = CUT if fault == TRUNCATED else 0
            due = USER if q == ASSISTANT else ASSISTANT  # the state after the turn that is due
            if role == 0 and q == START:
                ways.append((cost[SYSTEM] + more, "K", place[SYSTEM], SYSTEM))
            elif role == (2 if q == ASSISTANT else 1):
                ways.append((cost[due] + more, "K", place[due], due))
            ways.append((cost[due] + more + REROLE, "R", place[due], due))
        own.append(min(ways))
    best = []
    for q in range(4):
        ways, at, edits = [], q, ""
        for inserts in range(3):
            c, e, p, to = own[at]
            ways.append((c + INSERT * inserts, edits + e, p, to))
            at, edits = _INSERTED[at], edits + "I"
        best.append(min(ways))
    least = min(b[0] for b in best)
    order = sorted({(b[1], b[2]) for b in best})
    layer = tuple(b[0] - least for b in best), tuple(order.index((b[1], b[2])) for b in best)
    return layer, least, tuple((b[1], b[3]) for b in best)


class Trie:
    """The path of a prefix trie that sorted strings are walked along: a node for each letter of the last one."""

    def __init__(self) -> None:
        self.word = ""
        #: For each depth the layer, the cost that all states have paid, the edits, and how many blank, duplicate, truncated and illegal there are.
        self.path: list[tuple[Layer, int, tuple, tuple[int, int, int, int]]] = [(_END, 0, (), (0, 0, 0, 0))]
        #: Layers computed so far.
        self.made = 0

    def answer(self, word: str) -> tuple[int, str, tuple[int, int, int, int]]:
        """Cost, audit and counts of the conversation with these letters, the last row's first."""
        same = 0
        for a, b in zip(word, self.word):  # noqa: B905
            if a != b:
                break
            same += 1
        del self.path[same + 1 :]
        for i in range(same, len(word)):
            layer, paid, _, counts = self.path[-1]
            layer, more, edits = step(layer, word[i])
            fault, role = divmod(ord(word[i]) - 65, 4)
            bad = i > 0 and (INITIALS + "?")[role] + (INITIALS + "?")[(ord(word[i - 1]) - 65) % 4] not in LEGAL
            n = [*counts]
            if fault:
                n[fault - 1] += 1
            n[3] += bad
            self.path.append((layer, paid + more, edits, tuple(n)))
        self.made += len(word) - same
        self.word = word
        q, audit = START, []
        for _, _, edits, _ in reversed(self.path[1:]):
            done, q = edits[q]
            audit.append(done)
        layer, paid, _, counts = self.path[-1]
        return paid + layer[0][START], "".join(audit) + _END_EDITS[q], counts


def marked(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, fault, text): every row with its first fault; null roles and texts are one space."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    core = F.rtrim("text", F.lit(SPACES.decode()))
    own = F.when(core == "", F.lit(BLANK)).when(~F.right(core, F.lit(1)).isin(".", "!", "?"), F.lit(TRUNCATED)).otherwise(F.lit(OK))
    rows = rows.select("conv_id", "turn", "role", "digest", own.alias("own"))
    return rows.select("conv_id", "turn", "role", "digest", F.when((F.col("own") != BLANK) & seen, F.lit(DUPLICATE)).otherwise(F.col("own")).alias("fault"))


_PIECE = pa.schema([("conv_id", pa.int64()), ("task", pa.int64()), ("word", pa.string()), ("turns", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row for each conversation of a task: its letters and what is needed to count its turns."""
    held: list | None = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([held[0], held[1], "".join(held[2]), *held[3:]], _PIECE, strict=True)], schema=_PIECE)

    done: list[pa.RecordBatch] = []
    for batch in batches:
        for conv, task, turn, sign in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "task", "turn", "sign")], strict=True):
            if held is None or held[0] != conv:
                if held is not None:
                    done.append(row())
                held = [conv, task, [], 0, None, None]
            held[2].append(sign)
            if turn is not None and turn != held[5]:
                held[3] += 1
                held[4], held[5] = turn if held[4] is None else held[4], turn
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
    if held is not None:
        yield row()


def words(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, word): the letters of every conversation, the last row's first.

    Rows are dealt by range of conversation and turn, so a long conversation is spread over tasks; only
    one letter for each of its rows comes together. `ids` (conv_id) are conversations that are returned even without rows.
    """
    role = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    sign = F.chr(65 + 4 * F.col("fault") + F.when((role > 0) & (F.col("role") != ""), role - 1).otherwise(F.lit(3)))
    rows = marked(turns).withColumns({"sign": sign, "again": F.col("fault") == DUPLICATE})
    # Rows of one turn go by role and digest; of equal ones the first comes before its duplicates.
    order = ("conv_id", "turn", "role", "digest", "again")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().cast("long").alias("task"), "turn", "sign")
    pieces = dealt.mapInArrow(_pieces, "conv_id long, task long, word string, turns long, first long, last long")
    if ids is not None:
        empty = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        pieces = pieces.union(empty.select("conv_id", F.lit(-1).cast("long"), F.lit(""), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")))
    p = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("task", "word", "turns", "first", "last"))).alias("p"))
    known = F.filter("p", lambda x: x["first"].isNotNull())
    p = p.select("conv_id", F.reverse(F.array_join(F.transform("p", lambda x: x["word"]), "")).alias("word"), known.alias("p"))
    ends = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: (a["last"] == b["first"]).cast("long"))
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    gaps = F.array_max(F.transform("p", lambda x: x["last"])) - F.array_min(F.transform("p", lambda x: x["first"])) + 1 - add(F.transform("p", lambda x: x["turns"])) + add(ends)
    return p.select("conv_id", F.coalesce(gaps, F.lit(0)).alias("gaps"), "word")


_ANSWER = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *[(f, pa.int64()) for f in FAULTS[1:]], ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        got = [trie.answer(w) for w in batch.column("word").to_pylist()]
        if got:
            cost, audit, counts = zip(*got, strict=True)
            columns = [batch.column("conv_id"), batch.column("gaps"), *[pa.array(c, pa.int64()) for c in zip(*counts, strict=True)], pa.array(cost, pa.int64()), pa.array(audit, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=_ANSWER)


def audits(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Every conversation with its faults and its cheapest repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    `turns` has conv_id, turn, role, text. A row's first fault counts: blank (nothing but white space),
    duplicate (role and text came earlier), truncated (the last character that is no white space is
    none of . ! ?). Edits are Keep 0, Rerole 2, Delete 3 (a must for blank and duplicate rows) and Insert
    2; a truncated row that is not deleted costs 1 more. The audit is the initials of the cheapest
    edits, the ASCII-least of several. gaps are turn numbers that are missing between the least and the
    largest, illegal the neighbours whose initials are none of su, ua, au.

    Rows go by turn, null turns first, and rows of one turn by role and text digest. Null roles and
    texts are one space, rows without a conv_id are one conversation, repeated rows are duplicates, very
    long texts are looked at whole, an empty table gives an empty result but for `ids`; other columns
    are ignored.
    """
    strings = checkpointed(words(turns, ids))
    # Strings that begin alike are neighbours; one that many conversations share is spread by their ids.
    dealt = strings.withColumns({"head": F.substring("word", 1, 64), "h": F.xxhash64("word")}).repartitionByRange("head", "h", "conv_id").sortWithinPartitions("word")
    return dealt.select("conv_id", "gaps", "word").mapInArrow(_answers, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _ANSWER))


def _merged(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and rows as one sorted stream: a conversation's audit (head) comes before its rows."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    heads = found.select("conv_id", F.lit(0), F.lit(None).cast("long"), F.lit(""), F.col("audit"))
    both = rows.withColumn("digest", F.sha2("text", 256)).unionAll(heads.withColumn("digest", F.lit("")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "kind", "turn", "role", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, str, str, str] | None]:
    """The turns of repaired conversations (conv_id, place, edit, role, text); a tuple of place -1 begins each."""
    conv, audit, at, place, system = None, "", 0, 0, 0

    def put(edit: str, role: str, text: str) -> tuple:
        nonlocal place, system
        if place == 0 and edit == "K" and role[:1] == "s":
            system = 1
        elif edit != "K":
            role = "assistant" if (place - system) % 2 else "user"
        place += 1
        return conv, place - 1, edit, role, text

    def inserted() -> Iterator[tuple]:
        nonlocal at
        while audit[at : at + 1] == "I":
            at += 1
            yield put("I", "", "")

    for batch in batches:
        for c, kind, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text")], strict=True):
            if kind == 0:
                yield from inserted()
                conv, audit, at, place, system = c, text, 0, 0, 0
                yield conv, -1, "", "", ""
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                yield put(edit, role, text)
    yield from inserted()


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, load = [], 0
    for r in rows:
        held.append(r)
        load += len(r[-1])
        if len(held) >= size or load >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, load = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of all conversations after the edits of `audits`: conv_id, place (from 0), edit, role, text."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _merged(turns, found).mapInArrow(lambda b: _batched((r for r in _edited(b) if r[1] >= 0), schema), "conv_id long, place long, edit string, role string, text string")


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired turns as `role:text` lines, read as a stream: no conversation is held whole."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, h = None, None
        for c, place, _, role, text in _edited(batches):
            if place < 0:
                if h is not None:
                    yield conv, h.hexdigest()
                conv, h = c, hashlib.sha256()
                continue
            h.update((("\n" if place else "") + role + ":" + text).encode())
        if h is not None:
            yield conv, h.hexdigest()

    return _merged(turns, found).mapInArrow(lambda b: _batched(digests(b), schema), "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with every row damaged by crc32('conv_id:turn') modulo 20; nulls are one space.

    0 drops a row, 1 empties its text, 2 removes its . ! ?, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20)).alias("hurt"))
    text = F.when(F.col("hurt") == 1, F.lit("")).when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("hurt <> 0").select("conv_id", "turn", F.when(F.col("hurt") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
