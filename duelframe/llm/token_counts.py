"""Token counts by a finite-state tokenizer.

Byte-pair encoding of a word is compiled into a deterministic transducer that reads
the word's bytes and emits, on every transition, by how much the number of tokens of
what it has read changes; the sum along a word is its token count, and no token is
ever spelled out.

What makes it finite: the encoding of a prefix ends in one token, and dropping that
token leaves the encoding of the shorter prefix. A token may follow another when the
two side by side encode to just the two of them. So the last token after one more byte
is the one token that ends there and may follow the last token of the prefix before
it, and a state needs to remember, for every place from which a token may still be
growing, the place in the token trie, the last token before that place and how many
tokens came since. States are numbered as they are met and kept; the table is emptied
when it holds ``MAX_TRANSITIONS`` of them, which changes no result.

Words are found by the compiled lexer, whose chunk state maps are composed by a
parallel prefix scan; every distinct word of a piece runs through the transducer once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duelframe.llm.lexer import Lexer, Words, read_definition

MAX_TRANSITIONS = 2_000_000
MAX_WORDS = 1_000_000
FINAL = 256  # added to the last byte of a word


def _byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Transducer:
    def __init__(self, definition: str):
        model = json.loads(definition)["model"]
        suffix, letters = model["end_of_word_suffix"] or "", _byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            last = bool(suffix) and token.endswith(suffix) and token != suffix
            body = [letters[c] for c in (token[:-len(suffix)] if last else token)]
            if last:
                body[-1] += FINAL
            return tuple(body)

        self._rank: dict[tuple[int, int], tuple[int, int]] = {}
        self._symbols: list[tuple[int, ...]] = []
        self._children: list[dict[int, int]] = [{}]
        self._token: list[int] = [-1]  # token that ends at a node of the trie
        ids: dict[str, int] = {}
        # only what merges can reach is a token
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        for token in model["vocab"]:
            try:
                body = symbols(token)
            except KeyError:
                continue
            if len(body) == 1 or token in made:
                ids[token] = len(self._symbols)
                self._add(body)
        for rank, (a, b) in enumerate(merges):
            self._rank.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self._single = {s[0]: i for i, s in enumerate(self._symbols) if len(s) == 1}
        self._follows: dict[tuple[int, int], bool] = {}
        self._reset()

    def _add(self, body: tuple[int, ...]) -> None:
        node = 0
        for s in body:
            nxt = self._children[node].get(s)
            if nxt is None:
                nxt = self._children[node][s] = len(self._children)
                self._children.append({})
                self._token.append(-1)
            node = nxt
        self._token[node] = len(self._symbols)
        self._symbols.append(body)

    def _reset(self) -> None:
        # a state: (node, last token before it or -1, tokens since) for every growing token
        self._states = [((0, -1, 0),)]
        self._number = {self._states[0]: 0}
        self._next: dict[int, tuple[int, int]] = {}

    def _merged(self, body: list[int]) -> list[int]:
        while len(body) > 1:
            best, where, to = None, -1, -1
            for i in range(len(body) - 1):
                m = self._rank.get((body[i], body[i + 1]))
                if m is not None and (best is None or m[0] < best):
                    best, to, where = m[0], m[1], i
            if best is None:
                break
            body[where:where + 2] = [to]
        return body

    def _may_follow(self, a: int, b: int) -> bool:
        known = self._follows.get((a, b))
        if known is None:
            if len(self._follows) >= MAX_TRANSITIONS:
                self._follows.clear()
            parts = [self._single[s] for s in (*self._symbols[a], *self._symbols[b])]
            known = self._follows[a, b] = self._merged(parts) == [a, b]
        return known

    def _advance(self, state: int, symbol: int) -> tuple[int, int]:
        grown, last, change = [], -1, 0
        for node, before, since in self._states[state]:
            to = self._children[node].get(symbol)
            if to is None:
                continue
            token = self._token[to]
            if last < 0 and token >= 0 and (before < 0 or self._may_follow(before, token)):
                last, change = token, 1 - since
            if self._children[to]:
                grown.append((to, before, since))
        new = (*((n, b, s + change) for n, b, s in grown), (0, last, 0))
        number = self._number.get(new)
        if number is None:
            number = self._number[new] = len(self._states)
            self._states.append(new)
        result = self._next[state << 9 | symbol] = (number, change)
        return result

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        if len(self._next) >= MAX_TRANSITIONS:
            self._reset()
        state = total = 0
        known = self._next
        for symbol in word[:-1]:
            step = known.get(state << 9 | symbol) or self._advance(state, symbol)
            state, total = step[0], total + step[1]
        symbol = word[-1] + FINAL
        step = known.get(state << 9 | symbol) or self._advance(state, symbol)
        return total + step[1]


class TokenCounter:
    """Token counts of texts; one for each worker process and tokenizer."""

    _made: dict[str, "TokenCounter"] = {}

    @classmethod
    def of(cls, definition: str) -> "TokenCounter":
        if definition not in cls._made:
            cls._made = {definition: cls(definition)}
        return cls._made[definition]

    def __init__(self, definition: str):
        self.lexer, self.transducer = Lexer(definition), Transducer(definition)
        self.known: dict[int, int] = {i: 1 for i in self.lexer.special.values()}

    def _counts(self, words: Words) -> np.ndarray:
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        known, values = self.known, []
        for h, i in zip(distinct.tolist(), first.tolist()):
            n = known.get(h)
            if n is None:
                if len(known) >= MAX_WORDS:
                    known.clear()
                    known.update({i: 1 for i in self.lexer.special.values()})
                n = known[h] = self.transducer.count(words.spelled(i).encode())
            values.append(n)
        return np.array(values, np.int64)[which]

    def count(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        for words in self.lexer.words(texts):
            if len(words.hashes):
                total[words.first:words.last] += np.bincount(
                    words.owner - words.first, weights=self._counts(words),
                    minlength=words.last - words.first).astype(np.int64)
        return total


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` as the
    tokenizers library gives them for the file ``tokenizer``, without begin, end or other
    added tokens; special strings inside a text are special tokens, as by its default.

    A null text counts as empty: no bytes and no tokens. Null and repeated keys keep their
    rows; an empty table gives none; other columns are left out.
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(definition.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                 pa.array(counter.count(texts))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
