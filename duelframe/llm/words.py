"""Hashes of the words of a batch of texts, with numpy.

Words are runs of UTF-8 bytes that a table of 256 entries does not call
separators. The hash of a word depends on its bytes alone, so equal words have
equal hashes in every batch and task. Texts are processed in pieces of about
``PIECE`` bytes, cut between words, so the memory does not grow with the length
of a text beyond its own bytes and eight bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64

_MULTIPLIER = 0x9E3779B97F4A7C15 | 5
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) | U(1)
COEFFICIENTS = _rng.integers(1, 2 ** 63, 64, dtype=np.uint64) | U(1)
_powers = np.ones(1, dtype=np.uint64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(8, (n - 1).bit_length())
        full = np.full(size, _MULTIPLIER, dtype=np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null: empty) and the n + 1 offsets of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]]
    return raw, off - off[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """Byte ranges that never cut a word."""
    at, total = 0, len(data)
    while at < total:
        end = min(at + PIECE, total)
        if end < total:
            text_end = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            gaps = np.flatnonzero(separator[data[max(at, end - 4096):end]])
            cut = max(text_end, max(at, end - 4096) + int(gaps[-1]) + 1 if len(gaps) else 0)
            if cut <= at:  # one long word: on to its end
                nxt = int(offsets[np.searchsorted(offsets, end, "left")])
                gaps = np.flatnonzero(separator[data[end:nxt]])
                cut = end + int(gaps[0]) + 1 if len(gaps) else nxt
            end = cut
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE,
                fold: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and of each text the number of its words."""
    hashes, begins = [], []
    for a, b in _pieces(data, offsets, separator):
        raw = data[a:b]
        inside = ~separator[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = offsets[np.searchsorted(offsets, a, "left"):np.searchsorted(offsets, b, "left")] - a
        first[starts] = inside[starts]
        word = raw[inside]
        if not len(word):
            continue
        begin = np.flatnonzero(first[inside])
        length = np.diff(np.append(begin, len(word)))
        place = np.arange(len(word)) - np.repeat(begin, length)
        value = _VALUE[fold[word] if fold is not None else word] * powers(int(length.max()))[place]
        hashes.append(mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * COEFFICIENTS[0]))
        begins.append(np.flatnonzero(first) + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.diff(np.searchsorted(begin, offsets, "left"))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words of one text; of all of them if they are fewer."""
    n = len(words)
    if not n:
        return words
    m = min(k, n)
    total = words[:n - m + 1] * COEFFICIENTS[1]
    for j in range(1, m):
        total = total + words[j:n - m + 1 + j] * COEFFICIENTS[1 + j]
    return mix(total + COEFFICIENTS[:1] * U(m))
