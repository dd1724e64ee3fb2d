"""Token ids in length-delimited binary records with a separate offset index.

A data file is a sequence of records, each framed as

    length of the payload   unsigned 64-bit, little-endian
    masked checksum         of those 8 bytes, 32-bit
    payload
    masked checksum         of the payload, 32-bit

and a payload is one flag byte (1: null key; 2: ids of 16 bits, else of 32), the key
as a signed 64-bit number, and the ids, all little-endian. Checksums are CRC-32,
rotated right by 15 bits plus a constant, so that a checksum of data that holds
checksums stays a good one. The index file of a data file holds, for every record, its
offset and its number of ids (64 bits each), for reads in any order.

Documents are range-sorted by key over the files, so the files in order, each record
in order, are the corpus in ascending key order. A task writes its two files under
names of its own and renames them when they are whole; a task that runs again writes
the same bytes under the same final names.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from duelframe.llm.lexer import Lexer, Words, read_definition
from duelframe.llm.tables import release, saved

MASK_ADD = 0xA282EAD8
NULL_KEY, NARROW = 1, 2
HEAD, PAYLOAD_HEAD = struct.Struct("<QI"), struct.Struct("<Bq")
INDEX = np.dtype([("offset", "<u8"), ("n_tokens", "<u8")])
MAX_WORDS = 500_000
ROWS, BYTES = 500, 1 << 20  # texts encoded at once, at most so many or so long
JOINED = 2_000  # words encoded as one text


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def pack(key: int | None, ids: np.ndarray, narrow: bool) -> bytes:
    flags = (NULL_KEY if key is None else 0) | (NARROW if narrow else 0)
    return PAYLOAD_HEAD.pack(flags, key or 0) + ids.astype("<u2" if narrow else "<u4").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, key = PAYLOAD_HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if flags & NARROW else "<u4", offset=PAYLOAD_HEAD.size)
    return None if flags & NULL_KEY else key, ids.astype("<u4")


def read_record(file) -> bytes | None:
    """The next payload of an open file, or None at its end; ValueError for damage."""
    head = file.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("record cut off in its length")
    length, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("damaged record length")
    payload, tail = file.read(length), file.read(4)
    if len(payload) < length or len(tail) < 4:
        raise ValueError("record cut off")
    if struct.unpack("<I", tail)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder: any that pyarrow knows (file, hdfs, s3, gs, ...)."""
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def read_at(uri: str, positions: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of a data file by their position, in any order, by way of its index."""
    store, path = _files(uri)
    with store.open_input_file(path + ".idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    with store.open_input_file(path) as f:
        out = []
        for p in positions:
            f.seek(int(index[p]["offset"]))
            out.append(unpack(read_record(f)))
    return out


class Encoder:
    """Ids of texts by the tokenizers library, which encodes each distinct word once. The
    store of words is a table sorted by hash, emptied at ``MAX_WORDS``; it ends with the task."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        whole = json.loads(definition)
        # the lexer asks for classes and lower case alone, so its tokenizer needs no vocabulary
        self.lexer = Lexer(json.dumps(whole | {"model": whole["model"] | {"vocab": {}, "merges": []}}))
        self.largest = max([*whole["model"]["vocab"].values(), *(t["id"] for t in whole["added_tokens"])])
        # words come normalised, special tokens apart: neither is to be looked for again
        self.library = Tokenizer.from_str(json.dumps(whole | {"normalizer": None, "added_tokens": []}))
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has. Words are encoded joined by
        blanks, at which the tokenizer cuts anyway."""
        parts = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        ids, lengths = [], []
        for part, found in zip(parts, self.library.encode_batch([" ".join(p) for p in parts], add_special_tokens=False)):
            which = np.array(found.word_ids, np.int64)
            count = np.bincount(which, minlength=len(part))
            if len(count) != len(part) or not count.all():  # a word that the tokenizer cuts further
                apart = [e.ids for e in self.library.encode_batch(part, add_special_tokens=False)]
                count = np.array([len(x) for x in apart])
                ids.append(np.array([t for x in apart for t in x], np.uint32))
            else:
                ids.append(np.array(found.ids, np.uint32))
            lengths.append(count)
        return np.concatenate(ids), np.concatenate(lengths).astype(np.int32)

    def _learn(self, words: Words, hashes: np.ndarray, first: np.ndarray) -> None:
        """``hashes`` of words not yet known, sorted, and where each is in ``words``."""
        special = (hashes >> np.uint64(63)) == 0  # an added token's hash is its id
        ids, length = np.zeros(0, np.uint32), np.ones(len(hashes), np.int32)
        if not special.all():
            ids, length[~special] = self._spell([words.spelled(i) for i in first[~special].tolist()])
        begin = np.zeros(len(hashes), np.int64)
        begin[~special] = np.cumsum(length[~special]) - length[~special]
        begin[special] = len(ids) + np.arange(special.sum())
        where = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, where, begin + len(self.pool))
        self.length = np.insert(self.length, where, length)
        self.hashes = np.insert(self.hashes, where, hashes)
        self.pool = np.concatenate([self.pool, ids, hashes[special].astype(np.uint32)])

    def _ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a piece, and the number of ids of each word."""
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if new.any():
            if len(self.hashes) + new.sum() > MAX_WORDS:
                self._reset()
                new[:] = True
            self._learn(words, distinct[new], first[new])
        number = np.searchsorted(self.hashes, distinct)[which]
        length = self.length[number].astype(np.int64)
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(self.begin[number] - (ends - length), length)
        return self.pool[at], length

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for words in self.lexer.words(texts):
            if not len(words.hashes):
                continue
            ids, length = self._ids(words)
            counts = np.bincount(words.owner - words.first, weights=length, minlength=words.last - words.first)
            ends = np.cumsum(counts.astype(np.int64))
            for i, a, b in zip(range(words.first, words.last), [0, *ends.tolist()], ends.tolist()):
                if b > a:
                    parts[i].append(ids[a:b])
        empty = np.zeros(0, np.uint32)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else empty for p in parts]


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in groups of about ``BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:at + ROWS]), BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Encode and write; return the manifest, a row for each file in key order: ``file``,
    ``n_docs``, ``n_tokens`` (end ids included) and ``start``, the ids in all files before it.

    ``key`` is an integer column. Null keys come first and stay null; a null text is empty
    and has the end id alone; rows that repeat a key follow each other by the hash of
    their texts; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(read_definition(tokenizer))
    store, path = _files(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("_t"),
                       F.xxhash64(text).alias("_h"))
    ranged = rows.repartitionByRange("_k", "_h").sortWithinPartitions("_k", "_h", "_t").select("_k", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(definition.value)
        narrow = max(encoder.largest, end_id) < 1 << 16
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.rec"
        own = f"_{name}.{context.taskAttemptId()}"
        store, path = _files(folder)
        index, at, tokens = [], 0, 0
        with store.open_output_stream(f"{path}/{own}") as out:
            for batch in batches:
                for some in _groups(batch):
                    for k, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                        record = frame(pack(k, np.append(ids, np.uint32(end_id)), narrow))
                        out.write(record)
                        index.append((at, len(ids) + 1))
                        at += len(record)
                        tokens += len(ids) + 1
        del encoder
        release()  # the next stage's tasks run in the same worker
        if not index:
            store.delete_file(f"{path}/{own}")
            return
        with store.open_output_stream(f"{path}/{own}.idx") as out:
            out.write(np.array(index, INDEX).tobytes())
        store.move(f"{path}/{own}", f"{path}/{name}")
        store.move(f"{path}/{own}.idx", f"{path}/{name}.idx")
        yield pa.RecordBatch.from_arrays(
            [pa.array([context.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]),
             pa.array([len(index)], pa.int64()), pa.array([tokens], pa.int64())],
            names=["part", "file", "n_docs", "n_tokens"])

    # written once, as each reading of the plan would write the files again
    made, _ = saved(ranged.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")  # a row for each file
    return made.select("file", "n_docs", "n_tokens", before.alias("start"))


def read_token_files(spark: SparkSession, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per record of the files: ``key``, ``start`` (ids of all records before it),
    ``n_tokens`` and ``ids_crc32`` of the ids as little-endian unsigned 32-bit numbers.
    Every checksum is verified; a damaged file raises."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(uri: str, start: int) -> Iterator[tuple]:
            store, path = _files(uri)
            with store.open_input_stream(path, buffer_size=1 << 20) as f:
                while (payload := read_record(f)) is not None:
                    k, ids = unpack(payload)
                    yield k, start, len(ids), zlib.crc32(ids.tobytes())
                    start += len(ids)

        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: list[tuple] = []
                for row in rows(uri, start):
                    found.append(row)
                    if len(found) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=schema.names)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=schema.names)

    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files).mapInArrow(run, schema)
