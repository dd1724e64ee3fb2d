"""Benchmark decontamination against a broadcast hash set of test n-grams.

Texts are cut into normalised words (ASCII letters lower-cased; letters, digits
and everything beyond ASCII are word characters). Every window of ``window``
consecutive item words, and every shorter item as one window, is hashed into a
set of bits, one broadcast row. One scan of the documents hashes the windows of
each text inside its row and looks them up; those that are found are joined
with the windows themselves, word by word, so a hash collision does no harm.

A set holds at most ``MAX_BROADCAST`` windows. A larger benchmark is dealt into blocks of
that size; the documents are scanned once for each block and its hits written before the
next. Which items have a window is a table of its own, joined to the distinct windows of
each document, so a window of very many items makes no large row in the broadcast.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.tables import saved

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BROADCAST = 50_000  # windows of at most ``window`` words


def raw_words(text: Column) -> Column:
    """The words of a text, not yet lower-cased; null for null."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ``lower`` where a word is all ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, UPPER, LOWER))


def lowered(words: Column) -> Column:
    return F.transform(words, lower_ascii)


def hash_bits(grams: DataFrame, slots: int) -> DataFrame:
    """One row ``_bits``: an array of ``slots`` longs (a power of two) with a bit set for each ``h`` and
    ``h2``, in the slot of its first bits, at the place of its last six."""
    marks = grams.select(F.explode(F.array("h", "h2")).alias("h"))
    words = marks.select(F.expr(f"shiftrightunsigned(h, {65 - slots.bit_length()})").alias("_slot"),
                         F.expr("shiftleft(1L, cast(h & 63 as int))").alias("_word"))
    words = words.groupBy("_slot").agg(F.expr("bit_or(_word)").alias("_word"))
    every = grams.sparkSession.range(slots).withColumnRenamed("id", "_slot").join(words, "_slot", "left")
    at = F.array_sort(F.collect_list(F.struct("_slot", F.coalesce("_word", F.lit(0).cast("long")).alias("_word"))))
    return every.agg(F.transform(at, lambda x: x["_word"]).alias("_bits"))


def windows_found(words: str, length: int, slots: int) -> Column:
    """Windows of ``length`` words of the array column ``words`` of which both hashes have their bits
    set in ``_bits``, all that are in the set and very few others: array of (at, gram)."""
    def marked(h: str) -> str:
        return (f"shiftrightunsigned(get(_bits, cast(shiftrightunsigned({h}, {65 - slots.bit_length()}) as int)), "
                f"cast({h} & 63 as int)) & 1L = 1L")

    return F.expr(f"""
        filter(transform(filter(transform(
            CASE WHEN size({words}) >= {length} THEN sequence(0, size({words}) - {length})
                 ELSE cast(array() AS array<int>) END,
            i -> struct(i AS at, xxhash64(slice({words}, i + 1, {length})) AS h)),
          x -> {marked("x.h")}),
          x -> struct(x.at AS at, slice({words}, x.at + 1, {length}) AS gram)),
          x -> {marked("xxhash64(x.gram, 1)")})""")


def benchmark_windows(benchmark: DataFrame, window: int, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Windows ``h``, ``h2`` (128 bits of hash), ``len``, ``gram`` (its words), one row for each; and
    (``h``, ``h2``, ``item``), the items that have it. Both are written."""
    w = lowered(raw_words(F.col(text)))
    items = benchmark.select(F.col(item).cast("string").alias("item"), w.alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(window), F.size("w"))
    grams = items.select("item", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - n), lambda i: F.slice("w", i + 1, n))).alias("gram"))
    name = [F.xxhash64("gram").alias("h"), F.xxhash64("gram", F.lit(1)).alias("h2")]
    windows, _ = saved(grams.select("gram").distinct().select(*name, F.size("gram").alias("len"), "gram"), "grams")
    members, _ = saved(grams.where("item is not null").select(*name, "item").distinct(), "members")
    return windows, members


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
              item: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",),
              max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, ``n_words``, ``n_hit`` (words
    inside any occurrence of a window), ``spans`` (word ranges ``start``, ``end`` of
    the occurrences, in order) and ``items`` (ids of items with occurring windows,
    sorted as strings).

    A null or empty text has no words and no hit; a null or empty item text has no
    window; an item with a null id marks words but is not listed; repeated items
    and documents count each on their own. A text of any length is looked up whole, inside
    its row; an empty table gives no rows. Columns of ``docs`` that are not kept do
    no harm whatever their names, and kept ones may have any.
    """
    grams, members = benchmark_windows(benchmark, window, item, item_text)
    windows = grams.count()
    blocks = max(1, math.ceil(windows / max_broadcast))
    ks = [f"_k{i}" for i in range(len(keep))]
    base = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, ks)], F.monotonically_increasing_id().alias("_row"),
                       F.coalesce(raw_words(F.col(text)), F.array().cast("array<string>")).alias("_raw"))
    base = base.select("_row", *ks, lowered(F.col("_raw")).alias("_w"))
    found = None
    for block in range(blocks):
        part = grams if blocks == 1 else grams.where(F.pmod(F.xxhash64(F.col("h")), F.lit(blocks)) == block)
        # the plan holds no hash: lists of literals are copied and printed by the driver over and over
        lengths = sorted(r.len for r in part.select("len").distinct().collect())
        slots = 1 << max(4, max_broadcast if blocks > 1 else windows).bit_length()
        lists = [windows_found("_w", n, slots) for n in lengths]
        probed = base.crossJoin(F.broadcast(hash_bits(part, slots))) if lengths else base  # one row
        none = F.array().cast("array<struct<at:int,gram:array<string>>>")
        probes = probed.select("_row", *ks, F.size("_w").cast("long").alias("_n"),
                             F.concat(none, *lists).alias("_found"))
        # the words stay behind: explode copies every column it hands on
        rows = probes.select("_row", *ks, "_n", F.explode_outer("_found").alias("_f"))
        hits = (rows.join(F.broadcast(part.withColumnsRenamed({"gram": "_g"})), F.col("_f.gram") == F.col("_g"), "left")
                .select("_row", *ks, "_n", "h", "h2", F.when(F.col("_g").isNotNull(), F.struct(
                    F.col("_f.at").alias("start"), (F.col("_f.at") + F.col("len")).alias("end"))).alias("_span")))
        # written before the next block, so a plan holds the bits of one block
        hits, _ = saved(hits if found is None else hits.where("_span is not null"), "hits")
        found = hits if found is None else found.unionByName(hits)
    spans = found.groupBy("_row").agg(
        *[F.first(k).alias(k) for k in ks], F.max("_n").alias("n_words"), F.array_sort(F.collect_set("_span")).alias("spans"))
    # a document's windows first, then their items: a window of very many items is no wide row
    listed = (found.where("_span is not null").select("_row", "h", "h2").distinct().join(members, ["h", "h2"])
              .groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items")))
    per = spans.join(listed, "_row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", zero, lambda s, x: F.struct(
        F.greatest(s["upto"], x["end"]).alias("upto"),
        (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"]))).alias("n")), lambda s: s["n"])
    return per.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_words",
                      covered.alias("n_hit"), "spans", "items")
