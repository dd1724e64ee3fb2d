"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. It is
never looked into: a conversation's turn prefixes are rendered one after another,
what a prefix adds to the one before is the span of its last turn, and a rendering
that does not begin with the one before shows a template that rewrites history.
Where a turn's text lies inside its span is found by rendering two probe texts in
its place and comparing them from both ends.

Turns are numbered in their conversation and dealt to tasks by block, each block with the
turn before it, so a conversation of any length is rendered by many tasks. Digests of
whole conversations stream: a block is held at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.operators.hot import find_cuts
from duelframe.operators.ordinal import ordinal_within

ROWS, CHARS = 1_000, 4_000_000  # rows, or characters of text, handed on at once

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
# Control strings cannot arise from escaped text: none of their first characters is left in it.
_ESCAPES = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c"}
_ESCAPE = str.maketrans(_ESCAPES)
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def marked_turns(turns: list[Turn]) -> str:
    """The template of the registered query: ``### role: text</turn>`` lines, both escaped."""
    return "".join(f"{OPEN}{escape(role)}{MIDDLE}{escape(text)}{CLOSE}" for role, text in turns)


def parse_marked(formatted: str) -> Iterator[tuple[str, int, int]]:
    """Of each turn of ``marked_turns`` its role and the range of its (escaped) text."""
    at = 0
    while at < len(formatted):
        middle = formatted.index(MIDDLE, at)
        end = formatted.index(CLOSE, middle)
        yield unescape(formatted[at + len(OPEN):middle]), middle + len(MIDDLE), end
        at = end + len(CLOSE)


def _common(x: str, y: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        half = (lo + hi + 1) // 2
        if x[lo:half] == y[lo:half]:
            lo = half
        else:
            hi = half - 1
    return lo


def render_turns(before: list[Turn], turns: list[Turn], template: Template
                 ) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """What ``turns`` add after ``before``; of each its span and its text's range; and
    whether a prefix's rendering did not begin with the one before."""
    base = last = template(before)
    spans, rewrites, done = [], False, list(before)
    for role, text in turns:
        now = template([*done, (role, text)])
        start = len(last)
        if not now.startswith(last):
            rewrites = True
            start = _common(last, now)
        x, y = template([*done, (role, "x")]), template([*done, (role, "y")])
        head = _common(x, y)
        tail = _common(x[:head - 1:-1] if head else x[::-1], y[:head - 1:-1] if head else y[::-1])
        spans.append((start, len(now), max(head, start), max(len(now) - tail, head, start)))
        done.append((role, text))
        last = now
    skip = len(base) if before else 0
    return last[skip:], [tuple(v - skip for v in s) for s in spans], rewrites


SPANS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>"


def format_conversations(turns: DataFrame, template: Template = marked_turns, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",),
                         block: int | None = None) -> DataFrame:
    """One row per block of turns: ``conv``, ``block`` (0, 1, ...), ``formatted``, ``spans``
    (of each turn its role, its range and its text's range in ``formatted``, and whether
    it counts for the loss) and ``rewrites``.

    ``block``: turns to a row. None renders every prefix of the whole conversation, which
    is right for any template, holds one conversation at a time and takes the square of
    its length. A number is for templates in which a turn's rendering depends on the turn
    before it at most: prefixes then restart with that turn, time is in proportion to the
    length, and rewriting is seen inside a block.

    Rows of one conversation are in order of ``turn`` (null first), role and a digest of the
    text; its blocks are rows in any partition. Null roles and texts are empty strings;
    rows with a null ``conv`` form one conversation; repeated rows are turns each; an
    empty table gives no rows. Texts of any length are whole; what is handed on at once
    is counted in characters. Other columns are left out, whatever their names.
    """
    key = T.StructField(conv, turns.schema[conv].dataType)
    schema = T.StructType([key, T.StructField("block", T.LongType()), T.StructField("formatted", T.StringType()),
                           T.StructField("spans", T._parse_datatype_string(SPANS)),
                           T.StructField("rewrites", T.BooleanType())])
    rows = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_n"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_r"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).withColumn("_d", F.md5("_t"))
    order = ["_n", "_r", "_d"]
    if block:
        placed = ordinal_within(rows, ["_c"], order, "_p", find_cuts(rows, ["_c"], order))
        b, i = F.floor(F.col("_p") / block), F.col("_p") % block

        def place(number: Column, at: Column) -> Column:
            return F.struct(number.cast("long").alias("b"), at.cast("int").alias("i"))

        # a block's last turn also comes before the next block, as its turn 0
        here, also = place(b, i + 1), place(b + 1, F.lit(0))
        dealt = placed.select("_c", "_r", "_t", F.explode(
            F.when(i == block - 1, F.array(here, also)).otherwise(F.array(here))).alias("_at"))
        ordered = (dealt.select("_c", F.col("_at.b").alias("_b"), F.col("_at.i").alias("_i"), "_r", "_t")
                   .repartition("_c", "_b").sortWithinPartitions("_c", "_b", "_i"))
    else:
        ordered = (rows.withColumns({"_b": F.lit(0).cast("long"), "_i": F.lit(1)}).repartition("_c")
                   .sortWithinPartitions("_c", *order).select("_c", "_b", "_i", "_r", "_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        pending: list[Turn] = []
        before: list[Turn] = []
        current, chars = None, 0

        def close() -> None:
            nonlocal chars
            if pending:
                formatted, spans, rewrites = render_turns(before, pending, template)
                rows.append((*current, formatted, [
                    dict(zip(("role", "start", "end", "text_start", "text_end", "loss"), (r, *s, r in loss_roles)))
                    for (r, _), s in zip(pending, spans)], rewrites))
                chars += len(formatted)

        def flush() -> pa.RecordBatch:
            nonlocal chars
            columns, chars = list(zip(*rows)), 0
            rows.clear()
            types = (key_type, pa.int64(), pa.string(), spans_type, pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        spans_type = pa.list_(pa.struct([("role", pa.string()), *[(n, pa.int32()) for n in (
            "start", "end", "text_start", "text_end")], ("loss", pa.bool_())]))
        for batch in batches:
            key_type = batch.schema.field(0).type
            for at in range(batch.num_rows):
                c, b, i, r, t = (col[at].as_py() for col in batch.columns)
                if current != (c, b):
                    close()
                    if len(rows) >= ROWS or chars >= CHARS:
                        yield flush()
                    current, pending, before = (c, b), [], []
                (pending if i else before).append((r, t))
        close()
        if rows:
            yield flush()

    return ordered.mapInArrow(run, schema)


def read_back(blocks: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of conversations, read from the output of ``format_conversations`` with the
    template ``marked_turns``: the turns from the formatted text alone, the loss text from
    the loss mask, and ``rewrites``, the blocks in which the template rewrote history. A
    conversation's blocks stream in order, as a digest is of the whole."""
    schema = T.StructType([blocks.schema[conv], *[T.StructField(n, t) for n, t in (
        ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()),
        ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("rewrites", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows, key_type = None, [], None

        def result() -> tuple:
            c, n, turns, loss, digest, chars, rewrites = state
            return c, n, turns.hexdigest(), loss, digest.hexdigest(), chars, rewrites

        def flush() -> pa.RecordBatch:
            types = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for at in range(batch.num_rows):
                c, number, formatted, spans, rewrites = (col[at].as_py() for col in batch.columns)
                if state is None or number == 0:
                    if state is not None:
                        rows.append(result())
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    if len(rows) >= ROWS:
                        yield flush()
                for role, a, b in parse_marked(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{unescape(formatted[a:b])}\n".encode())
                for s in spans:
                    if s["loss"]:
                        text = unescape(formatted[s["text_start"]:s["text_end"]])
                        state[3] += len(text)
                        state[4].update(text.encode())
                state[5] += len(formatted)
                state[6] += bool(rewrites)
        if state is not None:
            rows.append(result())
        if rows:
            yield flush()

    ordered = blocks.select(conv, "block", "formatted", "spans", "rewrites").repartition(conv)
    return ordered.sortWithinPartitions(conv, "block").mapInArrow(run, schema)
