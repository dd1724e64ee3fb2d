"""Byte-level BPE against the tiktoken library and against plain merging."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from odd_tables import SF0001, none, odd  # noqa: F401
from duelframe.llm import byte_bpe as B
from duelframe.llm import queries as Q

BITS = ["a", "b", "c", " ", "  ", "the", "ing", "1", "2", "é", "中", "́", "\x00", "😀", "'s", "'", "\n", "\t", "-", "--", "=", "ß",
        "к", "ا", "\x1c", "\x85", "​", "　", "᠎", "\xa0", "re", "!"]


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def pair(request):
    ranks = B.read_ranks(P.path(request.param))
    return (B.ByteEncoder(B.compile_vocabulary(ranks), P.PATTERN),
            tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))


def fuzzed(seed):
    r = random.Random(seed)
    out = ["".join(r.choice(BITS) for _ in range(r.randrange(0, 60))) for _ in range(4000)]
    out += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x500), r.randrange(0x20, 0xD7FF),
                                  r.randrange(0x1F000, 0x1FAFF)])) for _ in range(40)) for _ in range(1500)]
    out += ["".join(r.choice("aabbcceettooiinnss") for _ in range(n)) for n in (100, 1000) for _ in range(100)]
    return out + ["", "ab" * 40000, " " * 70000, "é" * 70000, "a b" * 50000, "!'" * 40000 + "re", ("x" * 300 + " ") * 500]


def test_ids_are_the_library_s(pair):
    own, library = pair
    for text in fuzzed(1):
        assert own.encode(text).tolist() == library.encode_ordinary(text), text[:80]


def test_parts_and_small_stores_change_nothing(pair, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 7)
    own, library = pair
    small = B.ByteEncoder(own.vocabulary, P.PATTERN)
    small.known.most = small.fits.most = 20
    for text in fuzzed(2)[:3000:3]:
        assert small.encode(text).tolist() == library.encode_ordinary(text), text[:80]


def plain_merges(ranks, raw):
    parts = [raw[i:i + 1] for i in range(len(raw))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_any_vocabulary_equals_plain_merging():
    """Random merge tables over three letters, with tokens that no merge reaches and ranks with gaps."""
    r = random.Random(4)
    for _ in range(40):
        ranks, made = {bytes([b]): 3 * b for b in range(256)}, [b"a", b"b", b"c"]
        for i in range(r.randrange(1, 25)):
            token = r.choice(made) + r.choice(made)
            if token not in ranks:
                ranks[token] = 1000 + 2 * i
                made.append(token)
        if r.random() < 0.5:
            ranks[b"cabcabca"] = 5000
        own = B.ByteEncoder(B.compile_vocabulary(ranks), r".+")
        for _ in range(60):
            text = "".join(r.choice("abc") for _ in range(r.randrange(1, 30)))
            raw = text.encode()
            assert own.encode(text).tolist() == ([ranks[raw]] if raw in ranks else plain_merges(ranks, raw))
    with pytest.raises(ValueError):
        B.compile_vocabulary({b"a": 0})


def test_query_and_odd_rows(spark, odd, none):
    ranks = B.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def expected(rows):
        out = []
        for r in rows:
            ids = library.encode_ordinary(r.text or "")
            out.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                        hashlib.sha256((r.text or "").encode()).hexdigest()))
        return sorted(out, key=repr)

    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    assert sorted(map(tuple, Q.op12_byte_bpe(spark, SF0001).collect()), key=repr) == expected(docs.collect())
    v = B.compile_vocabulary(ranks)
    back = B.decode_documents(B.encode_documents(odd, v, P.PATTERN), v)
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in back.collect()), key=repr) == sorted(
        ((r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect()), key=repr)
    assert B.decode_documents(B.encode_documents(none, v, P.PATTERN), v).count() == 0
