"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, benchmark
decontamination, tokenization.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` over all documents that its predecessor
kept. All but the last return the columns of ``documents``; when a stage changes a text, its
``n_chars`` follows. Stages that look for groups or leaks judge rows, not ids: rows without an id and
the texts of an id that has several are linked, dropped and kept each for itself. Empty texts pass
through; an empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from spendlake.llm import queries as Q
from spendlake.llm.common import apply_steps, small_batches, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = Q.quality_model(spark, docs, sf_dir)
    return quality.score(docs.select(*COLUMNS), model).filter(F.col("score") >= Q.QUALITY_THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share."""
    kept = line_dedup.drop_frequent(docs.select(*COLUMNS), Q.LINE_MIN_DOCS, Q.LINE_MIN_CHARS)
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


#: Near copies: shingles of five words, similarity of 0.8 or more.
COPY_WIDTH, COPY_PERCENT = 5, 80
LATE = 1 << 62  # after all usual ids


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``_key`` per text of an id: the id itself, or, for rows without an id and all
    but one text of an id with several, a hash of id and text that comes after all usual ids."""
    h = F.xxhash64("doc_id", "text")
    several = written(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("_least"), F.max(h).alias("_most"))
                      .filter("_least <> _most").select("doc_id", "_least"), "ids-with-texts")
    late = h.bitwiseAND(LATE - 1).bitwiseOR(LATE)
    if several.isEmpty():
        return docs.withColumn("_key", F.coalesce("doc_id", late))
    other = F.col("doc_id").isNull() | (F.col("_least") != h)
    return docs.join(several, "doc_id", "left").withColumn("_key", F.when(other, late).otherwise(F.col("doc_id"))).drop("_least")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id; of equal rows one."""
    small_batches(spark)
    docs = keyed(docs.select(*COLUMNS))
    linked = ngram_join.join(docs.select(F.col("_key").alias("doc_id"), "text"), COPY_WIDTH, COPY_PERCENT)
    gone = linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(gone, "_key", "left_anti").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    small_batches(spark)
    docs = keyed(docs.select(*COLUMNS))
    leaks = decontaminate.find_leaks(docs.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    small_batches(spark)
    steps = [bpe.encode_step(Q.BPE_FILE), bpe.decode_step(Q.BPE_FILE), bpe.digest_step()]
    return apply_steps(docs.select(*COLUMNS), steps, drop=("text", "decoded"))


STAGES = [("quality_classifier", keep_good), ("line_dedup", drop_lines), ("ngram_jaccard_join", drop_near_copies),
          ("benchmark_decontamination", drop_leaks), ("bpe_encoding_decoding", tokenize)]

#: The classifier, the latent search and the tokenizer cannot be said in SQL; the tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
