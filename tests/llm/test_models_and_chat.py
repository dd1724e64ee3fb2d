"""Classifier, fingerprints, chat formatting and the pipeline."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from odd_tables import SF001, none, odd  # noqa: F401
from duelframe.llm import queries as Q
from duelframe.llm.chat import (escape, format_conversations, marked_turns, parse_marked, read_back, render_turns, unescape)
from duelframe.llm.edits import compare_with_edits, edited
from duelframe.llm.imatch import Fingerprinter, as_text, build_lexicon, fingerprint, likeness
from duelframe.llm.quality import QualityModel, _features, fit_quality, score_quality, train


# ------------------------------------------------------------ quality

def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in Q.QUERIES["op8_quality_classifier"](spark, SF001).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    held = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()
            if rows[r.doc_id].held_out]
    assert len(held) > 100 and sum(s.predicted == q for s, q in held) / len(held) > 0.97
    good = [s.score for s, q in held if q]
    bad = [s.score for s, q in held if not q]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98


def test_scores_equal_the_features_one_by_one(odd):
    rng = np.random.default_rng(1)
    model = QualityModel(rng.normal(size=1 << 18).astype(np.float32), 0.25)
    texts = [r.text for r in odd.collect()] + ["ab", "abc", "x" * (1 << 20) + " yz"]
    exp = [0.25 + float(np.dot(model.weights[i].astype(float), s)) for i, s in map(_features, texts)]
    assert model.margins(pa.array(texts)) == pytest.approx(exp, abs=1e-4)


def test_training_with_odd_labels(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (2, None), (3, 1), (5, 7)], "doc_id long, quality int")
    model = fit_quality(odd, labels)  # one class at most: the prior
    rows = score_quality(odd, model).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows}) == 1 and 0 <= rows[0].score <= 1
    assert score_quality(odd, model).columns.count("score") == 1
    assert score_quality(none, model).count() == 0
    assert fit_quality(none, labels.limit(0)).margins(pa.array(["x"]))[0] == 0
    a, b = (train(["good text here"] * 5 + ["$$ ##"] * 5, [1] * 5 + [0] * 5, 0.5) for _ in range(2))
    assert np.array_equal(a.weights, b.weights) and a.margins(pa.array(["good text"]))[0] > a.margins(pa.array(["$$ #"]))[0]


# ------------------------------------------------------------ fingerprints

def test_lexicon_holds_the_band(spark):
    docs = [(i, " ".join(["all", f"half{i % 2}", f"own{i}"])) for i in range(100)] + [(200, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(build_lexicon(df, least=0.3, most=0.6)) == 2
    assert len(build_lexicon(df, least=0.001, most=1.0)) == 103
    assert len(build_lexicon(df.limit(0))) == 0


def test_edits_against_plain_python(odd, none):
    lexicon = build_lexicon(odd)
    got = compare_with_edits(odd, lexicon).collect()
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    maker = Fingerprinter(lexicon)
    prints = dict(zip([t for _, t in rows], as_text(maker.hashes(pa.array([t for _, t in rows])))))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.fingerprint) for r in got) == sorted(
        (k is None, k or 0, len(t), prints[t]) for k, t in rows)
    unique = [(k, t) for k, t in rows if k is not None and [x for x, _ in rows].count(k) == 1]
    order = sorted({k for k, _ in rows if k is not None}, reverse=True)
    by_id = {r.doc_id: r for r in got}
    checked = 0
    for k, t in unique:
        following = order[order.index(k) + 1] if order.index(k) + 1 < len(order) else None
        if following in dict(unique):
            n = dict(unique)[following]
            e = edited(t, n)
            assert by_id[k].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            h = maker.hashes(pa.array([t, e, n]))
            assert by_id[k].edited_fingerprint == as_text(h)[1]
            assert (by_id[k].near_edited, by_id[k].near_next) == (likeness(h[:1], h[1:2])[0], likeness(h[:1], h[2:])[0])
            checked += 1
    assert checked > 15 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert compare_with_edits(none, lexicon).count() == 0


def test_next_document_wraps_around(spark):
    df = spark.createDataFrame([(i, chr(97 + i) * 3) for i in range(9)], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in compare_with_edits(df, np.zeros(0, np.uint64)).collect()}
    for i in range(9):
        e = chr(97 + i) * 2 + chr(97 + (i - 1) % 9)
        assert got[i] == hashlib.sha256(e.encode()).hexdigest()
    one = compare_with_edits(df.limit(1), np.zeros(0, np.uint64)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_equal_texts_have_equal_fingerprints(odd):
    rows = fingerprint(odd, build_lexicon(odd)).collect()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) >= len(by_text) - 1  # blank and empty texts share one
    assert rows[0].asDict().keys() >= {"fingerprint", "doc_id"}


# ------------------------------------------------------------ chat

HOSTILE = ["", "\\", "\\\\", "</turn>\n", "### user: x</turn>\n", "\\l\\h\\c", "a\\", "é😀", ":", "\\### Assistant: </turn> ok"]


def test_escapes_are_reversible():
    for t in HOSTILE:
        assert unescape(escape(t)) == t and "<" not in escape(t) and "#" not in escape(t)
    turns = [(r, t) for r in ("user", "assistant", "a: b</turn>\n", "") for t in HOSTILE]
    out = marked_turns(turns)
    assert [(r, unescape(out[a:b])) for r, a, b in parse_marked(out)] == turns


@pytest.mark.parametrize("block", [None, 1, 3])
def test_conversations_read_back(spark, block):
    rows = [(c, t, r, x) for c in range(5) for t, (r, x) in enumerate(
        [("user", HOSTILE[(c + i) % 10]) if i % 2 == 0 else ("assistant", HOSTILE[(c * 3 + i) % 10]) for i in range(4 + c)])]
    rows += [(None, 0, "user", "n"), (7, None, None, None), (7, 2, "assistant", "same"), (7, 2, "assistant", "same")]
    rows += [(9, i, "assistant", f"turn {i}") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(5))
    made = format_conversations(df.repartition(6), block=block)
    assert not made.where("rewrites").count()
    got = {r.conv_id: r for r in read_back(made).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(marked_turns([(r, x) for *_, r, x in turns]))
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_a_long_conversation_is_dealt_over_tasks(spark):
    from duelframe.operators.hot import CONF
    df = spark.range(4000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("turn # "), "id").alias("text")).repartition(5)
    spark.conf.set(CONF, "300")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is tiny
    try:
        made = format_conversations(df, block=16)
        parts = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
        one, = read_back(made).collect()
    finally:
        spark.conf.unset(CONF)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 4 and max(r["count"] for r in parts) < 100  # of 250 blocks
    turns = [("user" if i % 2 == 0 else "assistant", f"turn # {i}") for i in range(4000)]
    assert (one.n_turns, one.formatted_chars, one.rewrites) == (4000, len(marked_turns(turns)), 0)
    assert one.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_rewriting_templates_are_detected():
    def last_only(turns):
        return "".join(f"[{r}]{t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))
    assert render_turns([], [("u", "one"), ("a", "two")], last_only)[2]
    text, spans, rewrites = render_turns([], [("u", "one"), ("a", "<x")], marked_turns)
    assert not rewrites and [text[a:b] for *_, a, b in spans] == ["one", "\\lx"]
    header = lambda turns: "BOS" + "".join(f"<{r}>{t}</{r}>" for r, t in turns)
    text, spans, rewrites = render_turns([], [("u", ""), ("u", "aa"), ("a", "</a>")], header)
    assert not rewrites and [text[a:b] for *_, a, b in spans] == ["", "aa", "</a>"] and text.startswith("BOS")


# ------------------------------------------------------------ pipeline

def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    seen, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.new_path(spark, name)
        stage(spark, before, SF001).write.parquet(path)
        seen[name] = spark.read.parquet(path)
        if name != "token_files":
            assert seen[name].columns == docs.columns
            before = seen[name]
    assert seen["quality"].count() < docs.count()
    bad = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").where("quality = 0").collect()}
    kept = {r.doc_id for r in seen["quality"].collect()}
    assert len(kept & bad) <= 0.05 * len(bad)
    from test_near_copies import brute
    rows = [(r.doc_id, r.text) for r in seen["quality"].collect()]
    assert {r.doc_id for r in seen["near_copies"].collect()} == {c for _, _, c in brute(rows, 5, 80)}
    from test_native import brute_hits
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    clean = {k for k, _, n, _ in brute_hits([(r.doc_id, r.text) for r in seen["near_copies"].collect()], items, 10) if not n}
    assert {r.doc_id for r in seen["decontaminate"].collect()} == clean
    from duelframe.llm.mixing import mix_sources
    copies = {r.doc_id: r.copies for r in mix_sources(seen["decontaminate"]).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in seen["mix"].groupBy("doc_id").count().collect()} == copies
    out = seen["token_files"].collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in seen["mix"].collect())
    assert sorted(out[0].asDict()) == ["doc_id", "ids_crc32", "n_tokens", "start"]


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "two words"), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for docs in (odd, none):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, d)
            if name != "token_files":
                assert rows.columns == docs.columns
            got = rows.collect()
            if name == "decontaminate":
                assert len(got) == n - (2 if n else 0)
            if name == "token_files":
                assert len(got) == n
