"""Byte-level BPE encoding in linear time, and decoding.

A vocabulary of byte strings with ranks is compiled once: every token's bytes, read as
Latin-1, go into an Aho-Corasick automaton, and of every token the pair that merging its
bytes ends with and its longest proper prefix among the tokens are kept. A piece of text
is encoded by taking the longest match at each position; a token stays if it is
compatible with the one before it, that is, if merging the bytes of both leaves exactly
these two. Else the next shorter match is tried, and where none fits, the last token is
taken back and its end marked as a dead end. A position is entered at most once for each
length of a match, so the time is linear, and the tokens are those of the merges.

Answers about adjacent tokens are memoised, and the ids of short pieces; both stores have
a fixed size and end with the task.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PIECES, SHORT = 250_000, 32  # pieces of at most SHORT characters whose ids are kept
MAX_PAIRS = 100_000  # answers about adjacent tokens
CHUNK = 1 << 16  # characters split at once
ROWS, GROUP = 300, 200_000  # texts taken out of a batch at once, pieces looked up at once
FLUSH = 1 << 20  # ids to a batch
NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@dataclass
class Vocabulary:
    """Tokens numbered in the order of their ranks. ``left`` and ``right`` are the two
    tokens that merge into one (a token that no merge makes: itself), ``shorter`` its
    longest proper prefix that merges can make."""

    tokens: list[bytes]
    ids: list[int]
    left: list[int]
    right: list[int]
    shorter: list[int]
    pairs: dict[tuple[int, int], int]

    def made(self, n: int) -> bool:
        """Whether merges can give this token: a single byte, or a pair."""
        return len(self.tokens[n]) == 1 or self.left[n] != n

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` leaves these two.

        The merges beside the seam are undone, the latest first. If the two tokens that
        then meet would merge before the merge just undone, they did, and ``a`` and ``b``
        never came to be. Of equal merges the left one is first.
        """
        before = len(self.tokens)
        while True:
            if self.pairs.get((a, b), before) < before:
                return False
            a_parts, b_parts = self.right[a] != a, self.left[b] != b
            if a_parts and (a > b or not b_parts):
                before, a = a, self.right[a]
            elif b_parts:
                before, b = b + 1, self.left[b]
            else:
                return True


def compile_vocabulary(ranks: dict[bytes, int]) -> Vocabulary:
    """``ranks`` must have all 256 single bytes, and of a token's parts lower ranks."""
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary has every single byte")
    tokens = sorted(ranks, key=ranks.__getitem__)
    number = {t: n for n, t in enumerate(tokens)}
    made = Vocabulary(tokens, [ranks[t] for t in tokens], list(range(len(tokens))), list(range(len(tokens))),
                      [NONE] * len(tokens), {})
    for n, token in enumerate(tokens):
        for cut in range(len(token) - 1, 0, -1):
            a, b = number.get(token[:cut], n), number.get(token[cut:], n)
            if a < n and b < n and made.made(a) and made.made(b) and made.compatible(a, b):
                made.left[n], made.right[n] = a, b
                made.pairs[a, b] = n
                break
    for n, token in enumerate(tokens):
        prefixes = (number.get(token[:cut], NONE) for cut in range(len(token) - 1, 0, -1))
        made.shorter[n] = next((p for p in prefixes if p != NONE and made.made(p)), NONE)
    return made


class _Store(dict):
    """A memo of at most twice ``most`` entries: when it is full it becomes the older
    one, of which only what is asked for again is kept. Keys that ``keep`` refuses are
    answered and not stored."""

    def __init__(self, make, most: int, keep=None):
        self.make, self.most, self.keep, self.older = make, most, keep, {}

    def __missing__(self, key):
        if self.keep is not None and not self.keep(key):
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteEncoder:
    """Ids of texts. ``pattern`` splits a text; every match is encoded for itself."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.size = [len(t) for t in vocabulary.tokens]
        self.whole = {t: n for n, t in enumerate(vocabulary.tokens)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, token in enumerate(vocabulary.tokens):
            if vocabulary.made(n):
                self.automaton.add_word(token.decode("latin-1"), n)
        self.automaton.make_automaton()
        self.most = max(self.size)
        # of two adjacent tokens, by the number first * tokens + second; none comes first: tokens
        tokens = len(vocabulary.tokens)
        self.fits = _Store(lambda pair: pair >= tokens * tokens or vocabulary.compatible(*divmod(pair, tokens)), MAX_PAIRS)
        self.known = _Store(self.piece_ids, MAX_PIECES, lambda piece: len(piece) <= SHORT)

    def merged(self, piece: bytes) -> list[int]:
        """Numbers of the tokens that merging the bytes of ``piece`` leaves."""
        size, shorter, fits, n, tokens = self.size, self.vocabulary.shorter, self.fits, len(piece), len(self.size)
        spelled, longest, most = piece.decode("latin-1"), self.automaton.iter_long, self.most
        out, at, start = [], 0, tokens * tokens
        before = start  # what the token before adds to a pair's number
        # the longest matches one after another, as long as they are compatible
        for end, token in longest(spelled):
            if not fits[before + token]:
                break
            out.append(token)
            at, before = end + 1, token * tokens
        if at == n:
            return out
        alive = bytearray(b"\1") * (n + 1)
        while True:
            if alive[at + size[token]] and fits[before + token]:
                out.append(token)
                at, before = at + size[token], token * tokens
                if at == n:
                    return out
                token = next(longest(spelled[at:at + most]))[1]
                continue
            token = shorter[token]
            if token == NONE:  # no match fits here: take the last token back
                alive[at] = 0
                token = out.pop()
                at -= size[token]
                before = out[-1] * tokens if out else start

    def piece_ids(self, piece: str) -> bytes:
        """Ids as 32-bit integers."""
        raw, ids = piece.encode(), self.vocabulary.ids
        whole = self.whole.get(raw)  # a token as it stands, whether merges reach it or not
        numbers = self.merged(raw) if whole is None else (whole,)
        return array("i", [ids[n] for n in numbers]).tobytes()

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in parts. A part is cut out of a long text without
        its last two matches, which what follows could change, and these are found anew."""
        at = 0
        while len(text) - at > CHUNK:
            most, found = CHUNK, []
            while len(found) < 3 and at + most < len(text):
                found = list(self.pattern.finditer(text, at, at + most))
                most *= 2
            if len(found) < 3:
                break
            yield [m.group() for m in found[:-2]]
            at = found[-2].start()
        yield self.pattern.findall(text, at)

    def _ids(self, pieces: list[str], counts: list[int]) -> list[np.ndarray]:
        """Ids of runs of ``counts`` pieces; each distinct piece is asked for once."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        found = [self.known[p] for p in coded.dictionary.to_pylist()]
        pool, size = np.frombuffer(b"".join(found), np.int32), np.array([len(f) // 4 for f in found])
        which = coded.indices.to_numpy()
        ids = pool[_runs((np.cumsum(size) - size)[which], size[which])]
        ends = np.append(0, np.cumsum(size[which]))[np.cumsum(counts)].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        pieces, counts, owners = [], [], []

        def flush() -> None:
            if pieces:
                for owner, ids in zip(owners, self._ids(pieces, counts)):
                    parts[owner].append(ids)
            for x in (pieces, counts, owners):
                x.clear()

        for i, text in enumerate(texts):
            for part in self.pieces(text or ""):
                pieces.extend(part)
                counts.append(len(part))
                owners.append(i)
                if len(pieces) >= GROUP:
                    flush()
        flush()
        empty = np.zeros(0, np.int32)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else empty for p in parts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin, begin + 1, ... of every run, one run after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows), pa.int32()))


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, pattern: str, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row, each match of ``pattern`` encoded
    for itself, no special tokens.

    Null and empty texts have no ids. Repeated rows and null keys are rows like any other;
    an empty table gives none; other columns are left out, whatever their names. Long
    texts are split in parts, and a piece of any length takes time and memory in
    proportion to it. ``pattern`` may look ahead as far as the match after the next.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(shared.value, pattern)
        for batch in batches:
            at, rows, size = 0, [], 0
            for row in range(0, batch.num_rows, ROWS):
                for i, ids in enumerate(encoder.encode_many(batch.column(1).slice(row, ROWS).to_pylist()), row):
                    rows.append(ids)
                    size += len(ids)
                    if size >= FLUSH or i + 1 == batch.num_rows:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i + 1 - at), _lists(rows)], names=schema.names)
                        at, rows, size = i + 1, [], 0

    return docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and ``decoded``, the bytes of the ids. A null list is empty; an id
    that the vocabulary lacks raises."""
    last = max(vocabulary.ids) + 1
    size = np.zeros(last, np.int64)
    size[vocabulary.ids] = [len(t) for t in vocabulary.tokens]
    begin = np.zeros(last, np.int64)
    begin[vocabulary.ids] = np.cumsum([len(t) for t in vocabulary.tokens]) - size[vocabulary.ids]
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(vocabulary.tokens), np.uint8), begin, size))
    schema = T.StructType([encoded.schema[key], encoded.schema[ids], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, begin, size = shared.value
        for batch in batches:
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + FLUSH, "right")) - 1)
                some = batch.slice(at, to - at)
                numbers = some.column(1).flatten().to_numpy()
                if len(numbers) and not size[numbers].all():
                    raise ValueError("an id that the vocabulary lacks")
                spelled = pool[_runs(begin[numbers], size[numbers])]
                offsets = np.append(0, np.cumsum(size[numbers]))[ends[at:to + 1] - ends[at]]
                decoded = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(spelled)])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), decoded.cast(pa.binary())], names=schema.names)
                at = to

    return encoded.select(key, ids).mapInArrow(run, schema)
