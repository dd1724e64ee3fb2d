"""Repair of conversations whose turns are missing, repeated, cut off or misattributed.

Faults of rows are found by keyed aggregates, so a long conversation is spread like any
other rows. The cheapest edits (``audits``) are found on narrow rows in one global order,
dealt by range: a conversation that crosses parts, or is longer than ``SEGMENT`` rows, is
worked on in segments, for every state it may be in where a segment begins, and the
segments are joined. Then the rows with their texts stream through the edits in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.audits import EMPTY, FINE, MUST_GO, ROLES, TRUNCATED, USER, Chain, Segment, follow
from duelframe.llm.tables import saved

SEGMENT = 4_000  # rows
BATCH, BATCH_CHARS = 2_000, 4_000_000
WHITE = r"[\x20\x09-\x0D]"
LEGAL = {"su", "ua", "au"}
WAYS = "array<struct<start:int,end:int,cost:bigint,audit:string>>"


class Repair(NamedTuple):
    """``report``: a row for each conversation. ``repaired``: its turns after the edits, a
    conversation's rows in order in one partition."""

    report: DataFrame
    repaired: DataFrame


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by crc32(``conv:turn``) mod 20: 0 drops, 1 empties the text, 2 removes its
    ``.!?``, 3 repeats the row, 4 makes the role ``user``. A null role, text or part of the
    key counts as one space."""
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    times = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    return turns.select(
        F.col(conv), F.col(turn), F.when(case == 4, "user").otherwise(plain(role)).alias(role),
        F.when(case == 1, "").when(case == 2, F.translate(plain(text), ".!?", "")).otherwise(plain(text)).alias(text),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


def find_faults(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows ``_c, _t, _r, _x`` (text) with the digest ``_d`` of the text, the number
    ``_n`` of such rows, and whether the first of them is ``_blank``, ``_duplicate`` or
    ``_truncated``; the others are blank too or else duplicates."""
    rows = (turns.select(F.col(conv).alias("_c"), F.col(turn).cast("long").alias("_t"),
                         F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_r"),
                         F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("_x"))
            .groupBy("_c", "_t", "_r", "_x").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_d", F.md5("_x")))
    firsts = (rows.groupBy("_c", "_r", "_d").agg(F.min(F.struct(F.col("_t").isNotNull().alias("known"), "_t")).alias("_first"))
              .select(F.col("_c").alias("_fc"), F.col("_first._t").alias("_ft"), F.col("_r").alias("_fr"), F.col("_d").alias("_fd")))
    # joined on the whole row, so no key is hot however often a conversation repeats a text
    on = (F.col("_c").eqNullSafe(F.col("_fc")) & F.col("_t").eqNullSafe(F.col("_ft")) & (F.col("_r") == F.col("_fr"))
          & (F.col("_d") == F.col("_fd")))
    trimmed = F.regexp_replace("_x", f"{WHITE}+$", "")
    blank = ~F.col("_x").rlike(r"[^\x20\x09-\x0D]")
    duplicate = ~blank & F.col("_fd").isNull()
    return rows.join(firsts, on, "left").select(
        "_c", "_t", "_r", "_d", "_x", "_n", blank.alias("_blank"), duplicate.alias("_duplicate"),
        (~blank & ~duplicate & ~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("_truncated"))


ORDER = ("_c", "_t", "_r", "_d")


class _Stretch:
    """What is known of the rows of one conversation seen so far in a segment."""

    def __init__(self, conv, number: int, starts):
        self.conv, self.number, self.rows = conv, number, 0
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.first = self.last = None  # letters
        self.low = self.high = None  # turns
        self.distinct = 0
        self.segment = Segment(starts)

    def add(self, turn, role: str, n: int, blank: bool, duplicate: bool, truncated: bool) -> None:
        letter = role[:1]
        self.counts[0] += n if blank else 0
        self.counts[1] += 0 if blank else n - 1 + duplicate
        self.counts[2] += truncated
        self.counts[3] += n - 1 + (self.last is not None and self.last + letter not in LEGAL)
        self.first, self.last = letter if self.first is None else self.first, letter
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.segment.turn(letter, MUST_GO if blank or duplicate else TRUNCATED if truncated else FINE)
        for _ in range(n - 1):
            self.segment.turn(letter, MUST_GO)
        self.rows += n

    def row(self, part: int) -> tuple:
        ways = [dict(zip(("start", "end", "cost", "audit"), w)) for w in self.segment.ways()]
        return (self.conv, part, self.number, *self.counts, self.first, self.last, self.low, self.high, self.distinct, ways)


def _segments(faults: DataFrame) -> DataFrame:
    """A row for each stretch of a conversation in a part of the global order."""
    schema = T.StructType([faults.schema["_c"], *[T.StructField(n, T.LongType()) for n in (
        "part", "number", "blank", "duplicate", "truncated", "illegal")], T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("low", "high", "distinct")],
        T.StructField("ways", T._parse_datatype_string(WAYS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, stretch, size = TaskContext.get().partitionId(), [], None, 0
        every = range(4)

        def flush() -> pa.RecordBatch:
            types = [key_type, *[pa.int64()] * 6, pa.string(), pa.string(), *[pa.int64()] * 3, ways_type]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

        ways_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            key_type = batch.schema.field(0).type
            for c, *row in zip(*(col.to_pylist() for col in batch.columns)):
                new = stretch is None or stretch.conv != c
                if new or stretch.rows >= SEGMENT:
                    if stretch is not None:
                        rows.append(stretch.row(part))
                        size += stretch.rows
                        if size >= BATCH:
                            yield flush()
                            rows, size = [], 0
                    # the first of a part may go on from the part before
                    stretch = _Stretch(c, 0 if new else stretch.number + 1, [EMPTY] if new and stretch is not None else every)
                stretch.add(*row)
        if stretch is not None:
            rows.append(stretch.row(part))
            yield flush()

    narrow = faults.select(*ORDER, "_n", "_blank", "_duplicate", "_truncated")
    ordered = narrow.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return ordered.drop("_d").mapInArrow(run, schema)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _joined(segments: DataFrame) -> DataFrame:
    """The report: stretches of a conversation joined in order, one at a time."""
    schema = T.StructType([segments.schema["_c"], *[T.StructField(n, T.LongType()) for n in REPORT],
                           T.StructField("audit", T.StringType())])
    ordered = segments.repartition("_c").sortWithinPartitions("_c", "part", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, state = [], 0, None

        def close() -> int:
            conv, counts, _, low, high, distinct, chain = state
            cost, audit = chain.result()
            rows.append((conv, 0 if low is None else high - low + 1 - distinct, *counts, cost, audit))
            return len(audit)

        def flush() -> pa.RecordBatch:
            types = [key_type, *[pa.int64()] * len(REPORT), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                c, _, _, *counts, first, last, low, high, distinct, ways = (col[i].as_py() for col in batch.columns)
                if state is None or state[0] != c:
                    if state is not None:
                        size += close()
                        if len(rows) >= BATCH or size >= BATCH_CHARS:
                            yield flush()
                            rows, size = [], 0
                    state = [c, [0] * 4, None, None, None, 0, Chain()]
                state[1] = [x + y for x, y in zip(state[1], counts)]
                state[1][3] += state[2] is not None and state[2] + first not in LEGAL
                state[2] = last
                if low is not None:
                    state[5] += distinct - (low == state[4])
                    state[3], state[4] = low if state[3] is None else state[3], high
                state[6].add((w["start"], w["end"], w["cost"], w["audit"]) for w in ways)
        if state is not None:
            close()
            yield flush()

    return ordered.mapInArrow(run, schema)


def _edited(faults: DataFrame, report: DataFrame) -> DataFrame:
    """Turns after the edits: a conversation's audit comes before its rows, which stream."""
    schema = T.StructType([faults.schema["_c"], T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    nothing = {n: F.lit(None).cast(faults.schema[n].dataType).alias(n) for n in ("_t", "_r", "_d", "_x", "_n")}
    heads = report.select("_c", F.lit(0).alias("_what"), F.col("audit").alias("_audit"), *nothing.values())
    rows = faults.select("_c", F.lit(1).alias("_what"), F.lit(None).cast("string").alias("_audit"), *nothing)
    ordered = (heads.unionByName(rows).repartition("_c").sortWithinPartitions("_c", "_what", "_t", "_r", "_d")
               .select("_c", "_audit", "_r", "_x", "_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        conv, audit, at, state, position = None, "", 0, EMPTY, 0

        def flush() -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)

        def put(edit: str, role: str, text: str) -> None:
            nonlocal state, position, chars
            state = follow(state, edit, role[:1])
            out.append((conv, position, edit, role if edit == "K" else ROLES[state], text))
            position += 1
            chars += len(text)

        def inserts() -> None:
            nonlocal at
            while audit[at:at + 1] == "I":
                put("I", "", "")
                at += 1

        for batch in batches:
            key_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                c, head, role, text, n = (col[i].as_py() for col in batch.columns)
                if head is not None:
                    inserts()  # after the last row of the conversation before
                    conv, audit, at, state, position = c, head, 0, EMPTY, 0
                    continue
                for _ in range(n):
                    inserts()
                    if audit[at] != "D":
                        put(audit[at], role, text)
                    at += 1
                    if len(out) >= BATCH or chars >= BATCH_CHARS:
                        yield flush()
                        out, chars = [], 0
        inserts()
        if out:
            yield flush()

    return ordered.mapInArrow(run, schema)


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> Repair:
    """``report``: of each conversation ``gaps`` (turn numbers missing between the least and
    the greatest), rows that are ``blank``, ``duplicate`` (role and text seen before) or
    ``truncated`` (not ended by ``.!?``; the first fault counts), ``illegal`` neighbours
    (not system-user, user-assistant, assistant-user by first letters), the ``cost`` of the
    cheapest edits and their ``audit``. ``repaired``: ``position``, ``edit``, ``role``,
    ``text`` of the turns after the edits.

    Rows are in order of ``turn`` (null first), role and a digest of the text. A null role
    or text is one space; rows with a null ``conv`` form a conversation; rows repeated in
    all columns are turns each, duplicates but for the first; an empty table gives empty
    ones. Other columns are left out, whatever their names. Texts of any length are whole.
    """
    faults, _ = saved(find_faults(turns, conv, turn, role, text), "faults")
    report, _ = saved(_joined(_segments(faults)), "report")
    named = report.select(F.col("_c").alias(conv), *REPORT, "audit")
    repaired = _edited(faults, report).withColumnRenamed("_c", conv)
    return Repair(named, repaired)


def digest_turns(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv`` and ``sha256`` of its ``role:text`` lines, joined by newlines. ``repaired`` must
    be in the order of ``repair_conversations``; the rows stream, none is held."""
    schema = T.StructType([repaired.schema[conv], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, state = [], None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], key_type),
                                               pa.array([h.hexdigest() for _, h in rows])], names=schema.names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for c, position, role, text in zip(*(col.to_pylist() for col in batch.columns)):
                if position == 0:
                    if len(rows) >= BATCH:
                        yield flush()
                        rows = []
                    state = hashlib.sha256(f"{role}:{text}".encode())
                    rows.append((c, state))
                else:
                    state.update(f"\n{role}:{text}".encode())
        if rows:
            yield flush()

    return repaired.select(conv, "position", "role", "text").mapInArrow(run, schema)
