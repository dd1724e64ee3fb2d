"""The corpus pipeline: documents through stages, each written and read again.

Documents that the quality classifier rejects go; of every group of near copies (five-word
shingles, Jaccard 0.8) one document stays; documents with a ten-word passage of the
benchmark go; sources are mixed to weights, a document appearing as often as the mix
takes it; what is left is encoded and written as binary token records, which are read
back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.decontaminate import find_hits
from duelframe.llm.mixing import mix_sources
from duelframe.llm.ngram_join import keep_one
from duelframe.llm.quality import fit_quality, score_quality
from duelframe.llm.tables import bounded, new_path, pick, saved, small_batches, text_hash
from duelframe.llm.token_binary import read_token_files, write_token_files

THRESHOLD = 0.5
WEIGHTS, MAX_EPOCHS = (1, 2, 3), 3
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least ``THRESHOLD``. A null or empty text has the model's bias;
    rows that repeat a text have one fate; a text of any length is scored whole; no rows
    give none."""
    small_batches(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, out="__score").where(F.col("__score") >= THRESHOLD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the lowest id (null last). Null
    and empty texts have no shingles and stay; of rows that repeat key and text one stays;
    long texts are cut into all their shingles; no rows give none."""
    small_batches(spark)
    return keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark. Null and empty texts have none and stay;
    rows that repeat key and text go or stay together; texts are searched whole; an empty
    benchmark removes nothing."""
    named = docs.select("doc_id", "text", text_hash("text").alias("_th"))
    hits = find_hits(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("doc_id", "_th"))
    found = hits.where("n_hit > 0").select(F.col("doc_id").alias("__key"), F.col("_th").alias("__th")).distinct()
    found, _ = saved(found, "contaminated")
    return docs.join(bounded(found), F.col("doc_id").eqNullSafe(F.col("__key")) & (text_hash("text") == F.col("__th")),
                     "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; rows that repeat id and text share
    their copies."""
    named = docs.select("doc_id", "text", "source", text_hash("text").alias("_th"))
    mixed = mix_sources(named, WEIGHTS, MAX_EPOCHS, keep=("_th",))
    chosen = (mixed.groupBy("doc_id", "_th").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
              .where("_copies > 0"))
    rows = pick(docs, chosen)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Records read back from the token files: doc_id, start, n_tokens, ids_crc32. A null or
    empty text has the end id alone, null keys come first, rows that repeat a key follow
    each other, texts are encoded whole, no rows give no files."""
    small_batches(spark)
    manifest = write_token_files(docs, new_path(spark, "tokens"), public_tokenizers.path(TOKENIZER), END_ID)
    return read_token_files(spark, manifest)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_files", token_files),
]

# A classifier, similarity components and binary files: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, _ = saved(docs, name)
    return docs
