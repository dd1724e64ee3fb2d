"""How a text's I-Match fingerprint stands up to an edit: its last third replaced by the
beginning of the next document."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duelframe.llm.imatch import Fingerprinter, as_text, likeness
from duelframe.llm.neighbours import map_with_next


def edited(text: str, following: str) -> str:
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def compare_with_edits(docs: DataFrame, lexicon: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_chars``, ``edited_sha256``, the fingerprints
    of the text and of its edited text, and the likeness of the first to the second and
    to the next document's. The next document has the next lower key; after the last
    comes the first. Null texts are empty, null keys come last, repeated keys are
    ordered by their texts' hashes; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]

    def rows(keys: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        maker = Fingerprinter(shared.value)
        changed = [edited(t, n) for t, n in zip(texts, nexts)]
        own = maker.hashes(pa.array([*texts, nexts[-1]], pa.large_string()))
        other = maker.hashes(pa.array(changed, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(as_text(own[:-1])),
             pa.array(as_text(other)), pa.array(likeness(own[:-1], other)),
             pa.array(likeness(own[:-1], own[1:]))], names=names)

    return map_with_next(docs, key, text, rows, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)]))
