"""Words of a word-level BPE tokenizer, cut by a compiled state machine.

The tokenizers handled are JSON files whose normaliser is NFC, white space to a blank
and lower case, and whose pre-tokeniser takes contractions ('s 't 're 've 'm 'll 'd),
runs of letters, single digits and runs of anything else, and drops white space. The
machine reads one code point at a time; the class of a code point (and its lower case)
is asked of the tokenizer itself, so the Unicode tables are the library's own.

A batch is lexed in parallel: the text is dealt into chunks, every chunk becomes a map
from the state before it to the state after it, the maps are composed by a parallel
prefix scan, and with each chunk's entry state known a second pass marks the words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from tokenizers import Tokenizer

from duelframe.llm.words import mix, powers

PIECE = 1 << 19  # code points lexed at once
CHUNK = 64
DIRECT = 0x300  # below, code points normalise one by one, but for those of _ODD

# Classes of code points and states of the machine.
SPACE, LETTER, DIGIT, OTHER, QUOTE, SHORT, R, V, LL, E = range(10)  # SHORT: s t m d
BLANK, WORD, NUMBER, MARKS, QUOTED, QR, QV, QL, CONTRACTED = range(9)
_LETTERS = (LETTER, SHORT, R, V, LL, E)


def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By (class, state): the next state, whether a word begins at this code point, and
    whether one began at the code point before (a quote that was no contraction)."""
    step = np.zeros((10, 9), np.uint8)
    begins, began = np.zeros((10, 9), bool), np.zeros((10, 9), bool)
    fresh = {SPACE: BLANK, DIGIT: NUMBER, OTHER: MARKS, QUOTE: QUOTED, **{c: WORD for c in _LETTERS}}
    for c in range(10):
        for s in range(9):
            step[c, s], begins[c, s] = fresh[c], c != SPACE
            began[c, s] = s in (QR, QV, QL)
            if c in _LETTERS and s in (WORD, QR, QV, QL):
                step[c, s], begins[c, s] = WORD, False
            elif c in (OTHER, QUOTE) and s in (MARKS, QUOTED):
                step[c, s], begins[c, s] = MARKS, False
    for s, c, to in ((QUOTED, SHORT, CONTRACTED), (QUOTED, R, QR), (QUOTED, V, QV), (QUOTED, LL, QL),
                     (QR, E, CONTRACTED), (QV, E, CONTRACTED), (QL, LL, CONTRACTED)):
        step[c, s], begins[c, s], began[c, s] = to, False, False
    return step, begins, began


_STEP, _BEGINS, _BEGAN = _machine()
_FLAT = _STEP.ravel()
_STATES = _STEP.shape[1]


def _states_before(classes: np.ndarray) -> np.ndarray:
    """State before each code point, the first one in BLANK."""
    n = len(classes)
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK, np.int16)
    padded[:n] = classes
    base = np.ascontiguousarray(padded.reshape(rows, CHUNK).T) * np.int16(_STATES)
    maps = np.tile(np.arange(_STATES, dtype=np.uint8), (rows, 1))
    for k in range(CHUNK):
        maps = _FLAT[base[k][:, None] + maps]
    # inclusive prefix scan: maps[i] becomes the map of all chunks up to i
    reach = 1
    while reach < rows:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
        reach *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[:-1, BLANK]
    before = np.empty((CHUNK, rows), np.uint8)
    for k in range(CHUNK):
        before[k] = state
        state = _FLAT[base[k] + state]
    return before.T.ravel()[:n]


@dataclass
class Words:
    """Words of consecutive texts ``first`` .. ``last`` - 1, in order: of each its hash, the
    text it is in and its code points ``text[begin:end]``; special tokens have their id as
    hash and no code points."""

    first: int
    last: int
    hashes: np.ndarray
    owner: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def spelled(self, i: int) -> str:
        return self.text[self.begin[i]:self.end[i]].tobytes().decode("utf-32-le")


class Lexer:
    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        special = {t["content"]: t["id"] for t in json.loads(definition)["added_tokens"]}
        self.special = special
        self._cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._class = np.full(0x110000, 255, np.uint8)
        self._lower = np.arange(DIRECT, dtype=np.uint32)
        odd = []
        for cp in range(DIRECT):
            to = self.tokenizer.normalizer.normalize_str(chr(cp))
            if len(to) == 1:
                self._lower[cp] = ord(to)
            else:
                odd.append(chr(cp))
        self._slow = re.compile("[" + "".join(map(re.escape, odd)) + chr(DIRECT) + "-\U0010FFFF]")

    def _classify(self, points: np.ndarray) -> np.ndarray:
        found = self._class[points]
        if found.max(initial=0) == 255:
            for cp in np.unique(points[found == 255]).tolist():
                self._class[cp] = self._probe(chr(cp))
            found = self._class[points]
        return found

    def _probe(self, c: str) -> int:
        if c == "'":
            return QUOTE
        if c in "stmdrevl":
            return {"r": R, "v": V, "l": LL, "e": E}.get(c, SHORT)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        if not pieces(c):
            return SPACE
        if len(pieces("a" + c)) == 1:
            return LETTER
        return OTHER if len(pieces("!" + c)) == 1 else DIGIT

    def _segments(self, texts: list[str | None]) -> Iterator[tuple[int, str | int]]:
        """(text, normalised piece or special id), in order; each text has at least one."""
        for i, text in enumerate(texts):
            text = text or ""
            at = 0
            for m in self._cut.finditer(text) if self._cut and "<|" in text else ():
                yield i, self._normal(text[at:m.start()])
                yield i, self.special[m[0]]
                at = m.end()
            yield i, self._normal(text[at:] if at else text)

    def _normal(self, text: str) -> str:
        if text.isascii() or not self._slow.search(text):
            return text  # lower-cased code point by code point later on
        return self.tokenizer.normalizer.normalize_str(text)

    def words(self, texts: list[str | None]) -> Iterator[Words]:
        """Words of all texts, in pieces. A piece ends between texts or at white space, so the
        last text of a piece may go on in the next one."""
        held: list[tuple[int, str | int]] = []
        size = 0
        for i, segment in self._segments(texts):
            if isinstance(segment, str):
                while size + len(segment) > PIECE:
                    cut = segment.rfind(" ", 0, PIECE - size) + 1
                    if not cut and size:
                        pass  # begin a new piece with it
                    elif not cut:
                        nxt = re.compile(r"[ \n]").search(segment, PIECE)
                        cut = nxt.end() if nxt else len(segment)
                    held.append((i, segment[:cut]))
                    segment = segment[cut:]
                    yield self._lex(held)
                    held, size = [], 0
                size += len(segment) + 1
            held.append((i, segment))
        if held:
            yield self._lex(held)

    def _lex(self, held: list[tuple[int, str | int]]) -> Words:
        owner = np.array([i for i, _ in held])
        first, last = int(owner[0]), int(owner[-1]) + 1
        parts = [s if isinstance(s, str) else "" for _, s in held]
        text = np.frombuffer(" ".join(parts).encode("utf-32-le"), dtype=np.uint32)
        low = np.where(text < DIRECT, self._lower[np.minimum(text, DIRECT - 1)], text)
        starts_at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])[:-1]
        none = np.zeros(0, np.int64)
        hashes, begin, end, segment = np.zeros(0, np.uint64), none, none, none
        if len(low):
            classes = self._classify(low)
            before = _states_before(classes)
            at = classes.astype(np.int16) * _STATES + before
            starts = _BEGINS.ravel()[at]
            starts[:-1] |= _BEGAN.ravel()[at[1:]]
            after_last = _FLAT[at[-1]]
            if after_last in (QR, QV, QL):  # the text ends in a quote that was no contraction
                starts[-1] = True
            inside = classes != SPACE
            begin = np.flatnonzero(starts)
            if len(begin):
                # a word ends where the next begins or at white space
                body = np.flatnonzero(inside)
                rank = np.searchsorted(body, begin)
                length = np.diff(np.append(rank, len(body)))
                end = begin + length
                points = low[body].astype(np.uint64)
                place = np.arange(len(body)) - np.repeat(rank, length)
                value = mix(points + np.uint64(1)) * powers(int(length.max()))[place]
                hashes = mix(np.add.reduceat(value, rank) + length.astype(np.uint64)) | np.uint64(1 << 63)
                segment = np.searchsorted(starts_at, begin, "right") - 1
        marks = [(k, s) for k, (_, s) in enumerate(held) if not isinstance(s, str)]
        if marks:
            where = np.searchsorted(segment, [k for k, _ in marks])
            hashes = np.insert(hashes, where, np.array([s for _, s in marks], np.uint64))
            begin, end = np.insert(begin, where, 0), np.insert(end, where, 0)
            segment = np.insert(segment, where, [k for k, _ in marks])
        return Words(first, last, hashes, owner[segment] if len(segment) else none, low, begin, end)


def read_definition(path: str) -> str:
    """A tokenizer file, read on the driver; tasks get it with the plan (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
