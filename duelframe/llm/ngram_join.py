"""N-gram Jaccard self-join with rare-first prefix filtering.

A text's set is its distinct word n-grams, as 64-bit hashes in one global order:
rare first, by the corpus counts of a hashed table of fixed size, ties by hash. Two
sets of Jaccard similarity t share an n-gram among the first n - ceil(t * n) + 1
of each, so only those prefixes are joined. Candidates pass, in turn, the length
filter, the positional filter (what can still follow the shared n-gram) and the
suffix filter (how many n-grams fall into each of 64 ranges of the hash), each
pair once, and what is left is compared set by set.

Equal sets are one node from the start, and groups of near copies are not expanded
into all pairs; see ``linking``. No link between components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.linking import linked_components
from duelframe.llm.tables import bounded, drop, pick, saved, text_hash
from duelframe.llm.words import WHITE, shingle_hashes, text_bytes, word_hashes

SKETCH_BITS = 22  # counters of the n-gram counts; raise it with the corpus
SKETCH_PARTS = 64
SIGNATURE = 64  # ranges of the suffix filter
MAX_BROADCAST = 1_000_000  # document ids
SEEN = 1_000_000  # sets that a task remembers to post equal ones once


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Of each text its distinct n-grams, sorted; without words none."""
    data, offsets = text_bytes(texts)
    words, counts = word_hashes(data, offsets, WHITE)
    ends = np.cumsum(counts)
    for end, count in zip(ends.tolist(), counts.tolist()):
        yield np.unique(shingle_hashes(words[end - count:end], k))


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _signature(grams: np.ndarray) -> bytes:
    cells = np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=SIGNATURE)
    return np.minimum(cells, 65535).astype("<u2").tobytes()


def _profiles(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Of each row its key, set size, node and signature; and each task's part of the n-gram counts."""
    schema = T.StructType([
        T.StructField("id", docs.schema[key].dataType), T.StructField("th", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType()),
        T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        mask, id_type = np.uint64((1 << SKETCH_BITS) - 1), None
        for batch in batches:
            ids, n, node, sig = batch.column(0), [], [], []
            id_type = ids.type
            for grams in _sets(batch.column(1), k):
                n.append(len(grams))
                node.append(_node(grams) if len(grams) else None)
                sig.append(_signature(grams) if len(grams) else None)
                counts[np.unique(grams & mask)] += np.uint32(1)
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=schema.names)
        if id_type is not None:
            m = SKETCH_PARTS
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, id_type), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.binary()),
                 pa.array(range(m), pa.int32()),
                 pa.array([zlib.compress(c.tobytes(), 1) for c in np.split(counts, m)], pa.binary())],
                names=schema.names)

    return docs.select(key, text, text_hash(text).alias("th")).mapInArrow(run, schema)


def _levels(profiles: DataFrame) -> np.ndarray:
    """Logarithmic level (a byte) of every counter, summed over all tasks: 2**SKETCH_BITS bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(blob), dtype=np.uint32)
                sums[part] = sums.get(part, 0) + counts.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()),
                 pa.array([np.minimum(8 * np.log2(1.0 + s), 255).astype(np.uint8).tobytes()
                           for s in sums.values()], pa.binary())], names=["part", "levels"])

    parts = (profiles.where("part is not null").select("part", "counts").repartition(16, "part")
             .mapInArrow(run, "part int, levels binary").collect())
    found = {r["part"]: r["levels"] for r in parts}
    empty = bytes((1 << SKETCH_BITS) // SKETCH_PARTS)
    return np.frombuffer(b"".join(found.get(i, empty) for i in range(SKETCH_PARTS)), dtype=np.uint8)


def _postings(docs: DataFrame, text: str, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(``token``, ``node``, ``n``, ``pos``) for the prefix of every set."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # a fixed number of bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, mask = shared.value, np.uint64((1 << SKETCH_BITS) - 1)
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes, sizes = [], [], []
            for grams in _sets(batch.column(0), k):
                n = len(grams)
                if not n or (node := _node(grams)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                take = n - -(-percent * n // 100) + 1
                order = np.argsort(level[grams & mask], kind="stable")[:take]  # equal levels: by hash
                tokens.append(grams[order])
                nodes.append(node)
                sizes.append((n, take))
            if not tokens:
                continue
            n, take = np.array(sizes, dtype=np.int64).T
            ends = np.cumsum(take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), take)),
                 pa.array(np.repeat(n, take).astype(np.int32)),
                 pa.array((np.arange(ends[-1]) - np.repeat(ends - take, take)).astype(np.int32))],
                names=["token", "node", "n", "pos"])

    return docs.select(text).mapInArrow(run, "token long, node long, n int, pos int")


def _fits(percent: int) -> str:
    """Length and positional filter of two postings x, y of one n-gram: sizes that can reach the
    similarity, and an overlap that can, if this n-gram is the first that they share."""
    return (f"100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n) and "
            f"{100 + percent}L * least(x.n - x.pos, y.n - y.pos) >= {percent}L * (x.n + y.n)")


def _after_suffix_filter(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose n-grams fall similarly enough into the ranges of the hash: the differences
    of the counts bound the symmetric difference of the sets from below."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2")
                     .reshape(-1, SIGNATURE).astype(np.int64) for c in ("sa", "sb")]
            apart = np.abs(cells[0] - cells[1]).sum(axis=1)
            size = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            # overlap <= (size - apart) / 2 and the similarity needs percent * size / (100 + percent)
            keep = (100 + percent) * (size - apart) >= 2 * percent * size
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(x, "a").join(y, "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str, k: int,
              percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity, compared n-gram by n-gram."""
    needed, needed_path = saved(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), "needed")
    ids, ids_path = saved(nodes.join(needed, "node").select(F.col("rep").alias("_rep")).distinct(), "ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, blob = [], []
            for grams in _sets(batch.column(0), k):
                if len(grams):
                    node.append(_node(grams))
                    blob.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(blob, pa.binary())],
                                             names=["node", "grams"])

    texts = docs.join(bounded(ids, MAX_BROADCAST), F.col(key).eqNullSafe(F.col("_rep")), "left_semi").select(text)
    grams, grams_path = saved(texts.mapInArrow(sets, "node long, grams binary").join(needed, "node", "left_semi")
                              .dropDuplicates(["node"]), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ga"), batch.column("gb")):
                u, v = (np.frombuffer(g.as_buffer(), dtype=np.uint64) for g in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(grams.toDF("a", "ga"), "a").join(grams.toDF("b", "gb"), "b").select("a", "b", "ga", "gb"))
    links, _ = saved(both.mapInArrow(compare, "a long, b long"), "links")
    drop(docs.sparkSession, needed_path, ids_path, grams_path)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``_th`` (the hash of its text), ``n_shingles``,
    ``node`` (the class of equal sets; null without words) and ``component_id``, the
    smallest key that links reach.

    Sets are the distinct ``k``-word shingles of the whole text, words being runs
    other than space and \\t..\\r with A-Z lower-cased; a text of fewer words is one
    shingle. Two sets link when 100 * intersection >= ``percent`` * union. A null,
    empty or blank text has no words, links with nothing and is its own component;
    rows that repeat (in key, text or both) keep a row each; a null key is no
    candidate for the smallest. Other columns are left out.
    """
    spark = docs.sparkSession
    profiles, _ = saved(_profiles(docs, key, text, k), "profiles")
    rows = profiles.where("part is null")
    nodes, _ = saved(rows.where("node is not null").groupBy("node").agg(
        F.min("n").cast("int").alias("n"), F.min("id").alias("rep"), F.first("sig").alias("sig")), "nodes")
    postings = _postings(docs, text, k, percent, _levels(profiles))

    def verify(pairs: DataFrame) -> DataFrame:
        close, _ = saved(_after_suffix_filter(pairs, nodes, percent), "close")
        return _verified(close, docs, nodes, key, text, k, percent)

    comps = linked_components(postings, _fits(percent), verify)

    if comps is None:
        comps = nodes.select("node", F.col("node").alias("comp")).limit(0)
    joined = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = joined.join(least, "comp").select("node", "component_id")
    with_set = rows.where("node is not null").join(labels, "node").select("id", "th", "n", "node", "component_id")
    without = rows.where("node is null").select("id", "th", "n", "node", F.col("id").alias("component_id"))
    return with_set.union(without).select(F.col("id").alias(key), F.col("th").alias("_th"),
                                          F.col("n").alias("n_shingles"), "node", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component, by key (null last) and
    hash of the text; all columns. Rows without words stay, each of them, but for rows
    that repeat both key and text, of which one stays.
    """
    groups = jaccard_components(docs, k, percent, key, text)
    named = F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("key"), F.col("_th").alias("th"))
    counted = groups.groupBy(key, "_th", "node", "component_id").agg(F.count(F.lit(1)).alias("_rows"))
    # a component: its label and, for null labels, its class
    group = (F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("node")).alias("_class"))
    first = counted.where("node is not null").groupBy(*group).agg(
        F.min(F.struct(named.alias("name"), F.col("_rows").alias("rows"))).alias("_first"))
    kept = first.select(F.col("_first.name.key").alias(key), F.col("_first.name.th").alias("_th"),
                        F.lit(1).alias("_copies"), F.col("_first.rows").alias("_rows"))
    blank = counted.where("node is null").select(key, "_th", F.lit(1).alias("_copies"), "_rows")
    return pick(docs, kept.union(blank), key, text).drop("__copies")
