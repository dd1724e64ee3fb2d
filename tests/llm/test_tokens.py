"""Finite-state token counts and binary records against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odd_tables import none, odd  # noqa: F401

from duelframe.llm import token_counts as TC
from duelframe.llm.lexer import PIECE, read_definition
from duelframe.llm.tables import new_path
from duelframe.llm.token_binary import (Encoder, frame, pack, read_at, read_token_files, unpack, write_token_files)

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = ["'", "'s", "'S", "'re", "'v", "e", "l", "'ll", "r", "t", " ", "\n", "\t", "a", "B", "É", "ñ", "ß", "İ", "Ⱥ", "é",
        "Σ", "ς", "1", "٣", "½", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "-", "—", "😀", "中", " ",
        "　", "​", "ﬁ", "Å", "\x00", "\x1c", "\x85", "the", "ing", "tion", "ʼ", "’", "한", "क्षि"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    out = ["".join(r.choice(BITS) for _ in range(r.randrange(0, 40))) for _ in range(3000)]
    out += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x500), r.randrange(0x20, 0xD7FF),
                                  r.randrange(0x1F000, 0x1FAFF)])) for _ in range(r.randrange(1, 50))) for _ in range(2000)]
    out += ["".join(r.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(r.randrange(1, 300))) for _ in range(500)]
    return out + ["x " * PIECE, "y" * (PIECE + 7), "<|endoftext|>" * 50, "'r", "'", "'l'l 'v"]


def test_counts_are_the_library_s(library, texts):
    got = TC.TokenCounter(read_definition(PATH)).count([None, *texts])
    assert got[0] == 0
    assert got[1:].tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_do_not_depend_on_the_tables_size(library, texts, monkeypatch):
    monkeypatch.setattr(TC, "MAX_TRANSITIONS", 300)
    monkeypatch.setattr(TC, "MAX_WORDS", 100)
    got = TC.TokenCounter(read_definition(PATH)).count(texts[:1500])
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts[:1500], add_special_tokens=False)]


def test_ids_are_the_library_s(library, texts, monkeypatch):
    exp = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(read_definition(PATH)).encode(texts)] == exp
    from duelframe.llm import token_binary
    monkeypatch.setattr(token_binary, "MAX_WORDS", 2500)
    small = Encoder(read_definition(PATH))
    for i in range(0, 4000, 50):
        assert [x.tolist() for x in small.encode(texts[i:i + 50])] == exp[i:i + 50]


def test_count_query_on_odd_rows(odd, none, library):
    got = sorted(map(tuple, TC.count_tokens(odd, PATH).collect()), key=repr)
    exp = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
           for r in odd.collect()]
    assert got == sorted(exp, key=repr)
    assert TC.count_tokens(none, PATH).count() == 0


def test_records_round_trip_in_key_order(spark, odd, none, library):
    manifest = write_token_files(odd, new_path(spark, "tokens"), PATH, end_id=2)
    rows = sorted(read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    by_key = {}
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        by_key.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at, order = 0, []
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        by_key[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        order.append(r.doc_id)
    assert not any(by_key.values()) and order == sorted(order, key=lambda k: (k is not None, k or 0))
    assert sum(m.n_docs for m in manifest.collect()) == odd.count()
    empty = write_token_files(none, new_path(spark, "tokens"), PATH, end_id=2)
    assert empty.count() == 0 and read_token_files(spark, empty).count() == 0


def test_random_access_and_damage(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = write_token_files(odd.where(F.col("doc_id") < 20), folder, PATH, end_id=2)
    first = manifest.orderBy("start").first()
    n = first.n_docs
    back = read_at(first.file, [n - 1, 0])
    assert back[1][0] == 0 and back[0][1][-1] == 2
    path = first.file.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[40] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        read_at(first.file, [0])
    assert unpack(pack(None, np.array([1, 70000], np.uint32), False))[0] is None
    assert len(frame(b"abc")) == 8 + 4 + 3 + 4
