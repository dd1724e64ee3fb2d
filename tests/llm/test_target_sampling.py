"""Resampling towards a target: brute force, laws and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

from odd_tables import SF0001, none, odd  # noqa: F401
from duelframe.llm import queries as Q
from duelframe.llm import target_sampling as TS

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text, longest, buckets):
    w = WORD.findall((text or "").translate(LOW))
    runs = [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(docs, target, longest=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    own = [(k, *feature_buckets(t, longest, buckets)) for k, t in docs]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for x in target for b in feature_buckets(x, longest, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for k, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([k, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    can = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(can[:len(can) * percent // 100]):
        r[5] = i + 1
    return sorted(map(repr, rows))


def got(df):
    return sorted(repr(list(r)) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())


def test_query_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF0001}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    exp = brute([(r.doc_id, r.text) for r in docs], [r.text for r in bench])
    assert got(TS.resample_to_target(spark.read.parquet(f"{SF0001}/documents.parquet"),
                                     spark.read.parquet(f"{SF0001}/benchmark.parquet"))) == exp
    rows = Q.op11_target_resampling(spark, SF0001).collect()
    assert len(rows) == len(docs) and sorted(r.rank for r in rows if r.rank) == list(range(1, 1 + sum(1 for r in rows if r.rank)))


def test_odd_rows_runs_and_pieces(spark, odd, none, monkeypatch):
    monkeypatch.setattr(TS, "PIECE", 50)
    monkeypatch.setattr(TS, "FLUSH", 500)
    target = spark.createDataFrame([("Taro MI ken",), (None,), ("",), ("bataro sol 12",)], "text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    exp = brute(docs, [r.text for r in target.collect()], longest=3, buckets=97, min_words=2, percent=60, seed=5)
    assert got(TS.resample_to_target(odd, target, longest=3, buckets=97, min_words=2, percent=60, seed=5)) == exp
    assert TS.resample_to_target(none, target).count() == 0
    assert got(TS.resample_to_target(odd, target.limit(0), min_words=1)) == brute(docs, [], min_words=1)


def test_words_are_those_of_the_expression():
    text = "Ünlü I'M x_y 3.14 \x00İ b—c É" + "word " * 30000 + "中" * 70000
    assert TS.FeatureBuckets(1, 10).words(text) == WORD.findall(text.translate(LOW))
