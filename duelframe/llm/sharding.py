"""Sharding by jump consistent hashing, without a ring table.

A document's shard depends on its key and the number of shards alone. The key
seeds a sequence of jumps b0 < b1 < ...: from bucket b the key jumps to
``floor((b + 1) / r)``, r uniform in (0, 1] and a function of (key, b). The shard
among n is the last bucket below n, so a shard appended at the end only takes
keys, each with probability 1 / (n + 1), and none moves between old shards.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.tables import running_totals

# Jumps of one key among n shards: 1 + 1/2 + ... + 1/n are expected. More than
# this many have a chance below 1e-60 for a million shards, and raise an error.
MAX_JUMPS = 128


def _uniform(key: Column, bucket: Column) -> Column:
    """In (0, 1], exact in a double: the first 52 bits of md5("key:bucket")."""
    digest = F.md5(F.concat(key, F.lit(":"), bucket.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(2 ** 52))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a string key (null: the empty key) among ``shards``."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key, F.lit(""))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("next"))

    def step(state: Column, _: Column) -> Column:
        # floor of a double below 2**53: exact; beyond the shards it only has to stay beyond
        hop = F.when(state["next"] < shards,
                     F.floor((state["next"] + 1) / _uniform(key, state["next"].cast("long"))).cast("double"))
        return F.struct(F.when(state["next"] < shards, state["next"].cast("long")).otherwise(state["at"]).alias("at"),
                        F.coalesce(hop, state["next"]).alias("next"))

    def finish(state: Column) -> Column:
        return F.when(state["next"] < shards, F.raise_error(F.lit("jump hash: too many jumps"))
                      .cast("long")).otherwise(state["at"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS))), zero, step, finish).cast("int")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                    grown: int | None = None) -> DataFrame:
    """``key``, ``size`` (UTF-8 bytes of the text and 16), ``text_crc32``, ``shard``,
    ``slot`` (0, 1, ... inside the shard) and, with ``grown``, ``grown_shard``.

    Slots follow the md5 of the key, then key, crc and size, so a rerun over the
    same rows gives the same slots; rows that tie in all of these are alike in
    every column of the result. A null text counts as empty, a null key as the
    empty string, and repeated keys share their shard. An empty table gives none.
    Any other column of ``docs`` is left out.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    k = F.col(key).cast("string")
    digest = F.md5(F.coalesce(k, F.lit("")).cast("binary"))
    base = docs.select(
        F.col(key), (F.octet_length(t).cast("long") + 16).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        jump_hash(k, shards).alias("shard"),
        (jump_hash(k, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        digest.alias("_h"), F.monotonically_increasing_id().alias("_row"))
    carry = [key, "size", "text_crc32", "shard", "grown_shard"]
    order = [F.col("shard"), F.col("_h"), F.col(key), F.col("text_crc32"), F.col("size"), F.col("_row")]
    numbered = running_totals(base, order, {"_n": F.lit(1)}, carry)
    # at most a row for each shard
    first = numbered.groupBy("shard").agg(F.min("_n").alias("_first"))
    return (numbered.join(F.broadcast(first), "shard")
            .select(key, "size", "text_crc32", "shard", (F.col("_n") - F.col("_first")).alias("slot"), "grown_shard"))
