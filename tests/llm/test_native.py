"""Decontamination, mixing and sharding: brute force, laws and odd tables."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from odd_tables import SF0001, none, odd  # noqa: F401
from duelframe.llm import queries as Q
from duelframe.llm.decontaminate import find_hits
from duelframe.llm.tables import saved
from duelframe.llm.mixing import fill_targets, mix_sources
from duelframe.llm.sharding import shard_documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF0001):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF0001}/{f}'")
    df = Q.QUERIES[name](spark, SF0001)
    cur = con.execute(Q.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def brute_hits(docs, items, n):
    grams = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[i:i + k])].add(item)
    out = []
    for key, text in docs:
        w, hit, found = words_of(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i:i + k])) in grams:
                    hit |= set(range(i, i + k))
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [50_000, 3])
def test_hits_against_brute_force(spark, odd, blocks):
    texts = {r.doc_id: r.text for r in odd.collect()}
    some = words_of(texts[3])
    items = [(1, "Intro, " + " ".join(some[4:25]).upper()), (2, "TWO words!"), (10, " ".join(some[10:22])), (None, texts[5]),
             (11, None), (12, ""), (13, "--- \n"), (2, "two words"), (14, "É"), (15, " ".join(words_of(texts[44])[5000:5030]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("len", F.lit(1))
    got = find_hits(odd, bench, window=10, max_broadcast=blocks)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()), key=repr)
    assert rows == brute_hits([(r.doc_id, r.text) for r in odd.collect()], items, 10)
    assert any(r[2] for r in rows)


@pytest.mark.parametrize("blocks", [3, 1000])
def test_a_line_shared_by_a_third_of_the_items(spark, blocks):
    line = "answer the question below with one word and no more than that please"
    items = [(i, f"{line} item {i} of many" if i % 3 == 0 else f"own words number {i} and some more of them here now") for i in range(60)]
    docs = [(i, f"before {line} after {i}" if i % 2 else f"nothing in common with it {i}") for i in range(40)]
    got = find_hits(spark.createDataFrame(docs, "doc_id long, text string"),
                    spark.createDataFrame(items, "item_id long, text string"), window=10, max_broadcast=blocks)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()), key=repr)
    assert rows == brute_hits(docs, items, 10) and len(rows[1][3]) == 20


@pytest.mark.parametrize("blocks", [8, 1000])
def test_plans_hold_no_hashes(spark, monkeypatch, blocks):
    """Lists of literals in a plan grow the driver's memory with every run."""
    from duelframe.llm import decontaminate
    plans = []

    def spied(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return saved(df, name)

    monkeypatch.setattr(decontaminate, "saved", spied)
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(5, 30)))], "doc_id long, text string")
    assert [r.n_hit for r in find_hits(docs, bench, max_broadcast=blocks).collect()] == [25]
    windows, _ = decontaminate.benchmark_windows(bench, 10, "item_id", "text")
    assert len(plans) > 2 and not any(str(r.h) in plan for r in windows.collect() for plan in plans)


def test_hits_with_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_hits(none, bench).count() == 0
    clean = find_hits(odd, bench.limit(0)).collect()
    assert len(clean) == odd.count() and all(r.n_hit == 0 and not r["items"] for r in clean)


def test_mix_targets_and_copies(odd, none):
    rows = mix_sources(odd, keep=("source",)).collect()
    assert len(rows) == odd.count()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
    assert all(r.source_size == size[r.source] for r in rows)
    total = sum(size.values())
    assert abs(sum(target.values()) - total) < 1e-6 * total and sum(taken.values()) <= total
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [1, 2, 3] * 3))
    level = max(target[s] / weights[s] for s in size)
    for s in size:  # an open source has its weight's share, a full one three times its size
        assert target[s] == pytest.approx(min(3 * size[s], weights[s] * level))
        largest = max(r["size"] for r in rows if r.source == s)
        assert taken[s] <= target[s] + largest and taken[s] >= target[s] - largest
    assert rows == mix_sources(odd, keep=("source",)).collect() or sorted(map(repr, rows)) == sorted(
        map(repr, mix_sources(odd, keep=("source",)).collect()))
    assert mix_sources(none).count() == 0


def test_targets_reshare_in_rounds(spark):
    s = spark.createDataFrame([(1, 1), (10, 1000), (100, 10)], "weight int, source_size long")
    got = {r.source_size: r.target for r in fill_targets(s, 1011, 3).collect()}
    assert got[1] == 3 and got[10] == 30 and got[1000] == pytest.approx(978)


def test_shards_follow_the_law(odd, none):
    a = shard_documents(odd, 40, grown=41)
    rows = a.collect()
    assert len(rows) == odd.count() and all(0 <= r.shard < 40 for r in rows)
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})  # the key decides
    text = Counter(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect()))
    assert text == Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, shard_documents(odd.repartition(7), 40, grown=41).collect()))
    assert shard_documents(none, 40).count() == 0


def test_jumps_move_few_keys_and_match_a_loop(spark):
    from duelframe.llm.sharding import jump_hash

    def loop(key, n):
        b = j = 0
        while j < n:
            b = j
            j = int((b + 1) // ((int(hashlib.md5(f"{key}:{b}".encode()).hexdigest()[:13], 16) + 1) / 2 ** 52))
        return b
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    got = keys.select("k", *[jump_hash(F.col("k"), n).alias(f"n{n}") for n in (1, 2, 9, 10, 300)]).collect()
    assert all(r[f"n{n}"] == loop(r.k, n) for r in got for n in (1, 2, 9, 10, 300))
    moved = sum(r.n9 != r.n10 for r in got)
    assert 120 < moved < 290 and all(r.n10 == 9 for r in got if r.n9 != r.n10)
    sizes = Counter(r.n10 for r in got)
    assert len(sizes) == 10 and min(sizes.values()) > 130
