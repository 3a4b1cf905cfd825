"""Merchant memory (S15, C6, C7): learned merchant -> category as a DataFrame snapshot.

Keys are stored normalized (F1). Updates return a new snapshot; ``save`` writes it to a new
path (Parquet by default, or the reference's JSON object for small memories).
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.text import merchant_name
from spendlake.schema import MEMORY, empty_frame
from spendlake.sources.sink import path_is_missing


def empty_memory(spark: SparkSession) -> DataFrame:
    return empty_frame(spark, MEMORY)


def learn_batch(memory: DataFrame, pairs: DataFrame, version: str) -> DataFrame:
    """Upsert (merchant, category) pairs by normalized merchant; among several pairs
    for one key the highest ``version`` wins (the later pair); empty keys are ignored.
    ``version`` names a column that orders the pairs of a key."""
    p = pairs.select(merchant_name("merchant").alias("merchant"), "category", F.col(version).alias("_v"))
    p = p.where(F.col("merchant") != "")
    latest = p.groupBy("merchant").agg(F.max_by("category", "_v").alias("category"))
    kept = memory.join(latest.select("merchant"), "merchant", "left_anti")
    return kept.select("merchant", "category").unionByName(latest)


def has_merchant(memory: DataFrame, merchants: DataFrame, col: str = "merchant") -> DataFrame:
    """The rows of ``merchants`` whose normalized name is in memory."""
    keyed = merchants.withColumn("_k", merchant_name(col))
    return keyed.join(memory.select(F.col("merchant").alias("_k")), "_k", "left_semi").drop("_k")


def lookup(memory: DataFrame, merchants: DataFrame, col: str = "merchant") -> DataFrame:
    """C1 as a plain lookup: category per row (null when unknown or empty)."""
    keyed = merchants.withColumn("_k", merchant_name(col))
    mem = memory.where(F.col("category") != "").select(F.col("merchant").alias("_k"),
                                                       F.col("category").alias("memory_category"))
    return keyed.join(mem, "_k", "left").drop("_k")


def size(memory: DataFrame) -> int:
    """Number of learned merchants (an action)."""
    return memory.count()


MAX_JSON_OBJECT_ENTRIES = 1_000_000


def save(memory: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a snapshot. ``parquet`` (default) and ``json`` (one record per line) are
    written in parallel. ``json_object`` is the reference's single JSON object
    {merchant: category}: it is built in one task, so it is refused above
    ``MAX_JSON_OBJECT_ENTRIES`` entries."""
    if fmt == "parquet":
        memory.write.mode("overwrite").parquet(path)
    elif fmt == "json":
        memory.select("merchant", "category").write.mode("overwrite").json(path)
    elif fmt == "json_object":
        if memory.limit(MAX_JSON_OBJECT_ENTRIES + 1).count() > MAX_JSON_OBJECT_ENTRIES:
            raise ValueError("memory too large for a single JSON object; use parquet or json")
        obj = memory.agg(F.to_json(F.map_from_entries(F.collect_list(
            F.struct("merchant", "category")))).alias("value"))
        obj.coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError("fmt must be 'parquet', 'json' or 'json_object'")


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a snapshot; a missing one gives an empty memory, any other failure is raised (an empty
    memory in its place would overwrite the old one with the next save)."""
    try:
        if fmt == "parquet":
            return spark.read.parquet(path).select("merchant", "category")
        if fmt == "json":
            return spark.read.schema("merchant string, category string").json(path)
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("merchant", "category"))
    except AnalysisException as e:
        if path_is_missing(e):
            return empty_memory(spark)
        raise
