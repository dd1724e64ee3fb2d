"""I-Match fingerprints over several randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band: neither
the rare ones, which an edit brings and takes, nor the ones that every text has. A
text's distinct terms inside the lexicon, sorted, are hashed to one number. That
number changes with any one term, so further hashes are taken over random subsets of
the lexicon of several densities; two texts are alike in the share of subsets in
which their hashes agree, among those in which at least one of the two has a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.words import COEFFICIENTS, LOWER, WHITE, mix, text_bytes, word_hashes

RATES = (32, 128, 512, 1024)  # a subset holds one of so many lexicon terms
SUBSETS = 64  # random subsets, by turns of the rates; the whole lexicon comes before them
NONE = np.uint32(0)  # hash of a subset without terms


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of all texts, sorted within each, and their numbers."""
    words, counts = word_hashes(*text_bytes(texts), WHITE, LOWER)
    ends = np.cumsum(counts)
    each = [np.unique(words[e - c:e]) for e, c in zip(ends.tolist(), counts.tolist())]
    return (np.concatenate(each) if each else words), np.array([len(x) for x in each], np.int64)


def build_lexicon(docs: DataFrame, text: str = "text", least: float = 0.001, most: float = 0.2) -> np.ndarray:
    """Hashes of the terms that at least ``least`` and at most ``most`` of all rows contain
    (an idf between -ln(most) and -ln(least)), sorted; counted over all rows.

    At most (mean number of distinct terms in a text) / ``least`` terms can be that
    frequent, however large the corpus: that bounds what comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                terms, n = np.unique(_terms(batch.column(0))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["term", "n"])

    rows = docs.count()
    counted = docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counted.where((F.col("n") >= least * rows) & (F.col("n") <= most * rows)).select("term").toArrow()
    return np.sort(kept.column(0).to_numpy().view(np.uint64))


class Fingerprinter:
    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon

    def _inside(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(terms), bool)
        at = np.minimum(np.searchsorted(self.lexicon, terms), len(self.lexicon) - 1)
        return self.lexicon[at] == terms

    def hashes(self, texts: pa.Array) -> np.ndarray:
        """Of each text 1 + SUBSETS hashes. The first is over the whole lexicon; a text with
        no term in it is hashed over all its terms there."""
        terms, n = _terms(texts)
        out = np.zeros((len(n), 1 + SUBSETS), np.uint32)
        owner = np.repeat(np.arange(len(n)), n)
        inside = self._inside(terms)
        found = np.bincount(owner[inside], minlength=len(n)) > 0
        self._hash(out[:, 0], terms, owner, inside | ~found[owner], 0)
        out[n == 0, 0] = 1
        terms, owner = terms[inside], owner[inside]
        for turn in range(0, SUBSETS, len(RATES)):
            drawn = mix(terms ^ COEFFICIENTS[32 + turn // len(RATES)])
            for j, rate in enumerate(RATES):
                field = (drawn >> np.uint64(16 * j)) & np.uint64(0xFFFF)
                self._hash(out[:, 1 + turn + j], terms, owner, field < np.uint64(65536 // rate), 1 + turn + j)
        return out

    @staticmethod
    def _hash(out: np.ndarray, terms: np.ndarray, owner: np.ndarray, member: np.ndarray, salt: int) -> None:
        index = np.flatnonzero(member)
        if not len(index):
            return
        who = owner[index]
        begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        # distinct and sorted terms: the sum of their mixed values is a hash of the list
        sums = mix(np.add.reduceat(mix(terms[index] + np.uint64(salt)), begin))
        out[who[begin]] = np.maximum((sums >> np.uint64(32)).astype(np.uint32), 2)


def as_text(hashes: np.ndarray) -> list[str]:
    """Hex digits of each row of hashes."""
    return [row.tobytes().hex() for row in hashes.astype(">u4")]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal hashes, row by row, among those that either text has."""
    some = (x != NONE) | (y != NONE)
    return ((x == y) & some).sum(axis=1) / some.sum(axis=1)


def fingerprint(docs: DataFrame, lexicon: np.ndarray, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``fingerprint``, 8 hex digits for each lexicon.

    Equal texts have equal fingerprints; a null text counts as empty, and all empty texts
    share one. A column named ``fingerprint`` in ``docs`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded: see build_lexicon
    kept = [f for f in docs.schema.fields if f.name != "fingerprint"]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shared.value)
        for batch in batches:
            made = as_text(maker.hashes(batch.column(names.index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())],
                                             names=[*names, "fingerprint"])

    return docs.select(*names).mapInArrow(run, schema)
