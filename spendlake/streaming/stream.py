"""Structured Streaming forms of the incremental contract.

T1 file ingest: ``readStream`` CSV with a fixed schema; the stream checkpoint is the
   processed-file ledger (a file is never read twice).
T2 idempotent append: ``foreachBatch`` writes the unseen rows of each micro-batch to
   ``<target>/batch_id=<n>`` with overwrite, so a replayed batch replaces its own output and
   never duplicates it; the anti join only looks at earlier batches.
T3 dedupe by id: ``dropDuplicatesWithinWatermark`` on the id with a stated horizon, any row of an id
   survives; ``first_by_id`` keeps the smallest row of an id in state until the watermark
   has passed it (the exact variant without a horizon is T2's anti join).
T4 learning: ``foreachBatch`` runs the batch learner with what earlier batches have learned and
   writes what this one adds (``<memory>/batch_id=<n>``): a merchant is learned once, so the parts
   are disjoint and a batch writes no more than it learns. A replay reads the batches before it,
   so batch and stream agree on the same input order.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.operators.categorize import categorize_learn
from spendlake.schema import FUZZY_THRESHOLD
from spendlake.sources.sink import new_rows, path_is_missing


def statement_stream(spark: SparkSession, folder: str, schema, to_txn: Callable[[DataFrame], DataFrame],
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Txn rows from CSV statements with one header layout."""
    r = spark.readStream.schema(schema).option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return to_txn(r.csv(folder))


def _earlier_batches(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    try:
        t = spark.read.parquet(path)
    except AnalysisException as e:
        if path_is_missing(e):  # nothing written yet
            return None
        raise
    return t.where(F.col("batch_id") < batch_id)


def _batch_ids(spark: SparkSession, path: str) -> list[int]:
    """Committed ``batch_id=<n>`` directories under ``path`` (those with _SUCCESS)."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("batch_id=") and fs.exists(
                jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def append_batch(target_path: str, dedupe_within_batch: bool = True, order: str | None = None,
                 prune_months: bool = False):
    """The ``foreachBatch`` function of an idempotent append to ``target_path``
    (layout ``batch_id=<n>/month=<yyyy-MM>``). Ids are compared with those of all earlier
    batches, or with ``prune_months`` of this batch's months alone (exact when every id is F7
    of the row's own date). Rows without an id are all kept, as in the batch sink."""
    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = df
        if dedupe_within_batch:
            row = F.struct(*rows.columns)
            keep = F.min_by(row, F.col(order)) if order else F.first(row)
            alone = F.when(F.col("transaction_id").isNull(), F.monotonically_increasing_id())
            rows = (rows.withColumn("_alone", alone).groupBy("transaction_id", "_alone")
                    .agg(keep.alias("_r")).select("_r.*"))
        rows = rows.withColumn("month", F.date_format("date", "yyyy-MM"))
        prev = _earlier_batches(spark, target_path, batch_id)
        if prev is not None:
            if prune_months:
                prev = prev.join(rows.select("month").distinct(), "month", "left_semi")
            rows = new_rows(rows, prev.select("transaction_id"))
        rows.write.mode("overwrite").partitionBy("month").parquet(f"{target_path}/batch_id={batch_id}")
    return run


def learn_batch(labels_path: str, memory_path: str, order: str, rules=None,
                threshold: int = FUZZY_THRESHOLD, description: str = "description"):
    """T4: the ``foreachBatch`` function of categorization with learning across batches."""
    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        memory = learned(spark, memory_path, batch_id)
        labeled, all_mem = categorize_learn(df, order, rules, memory, threshold, description)
        added = all_mem if memory is None else all_mem.join(memory.select("merchant"), "merchant", "left_anti")
        labeled.write.mode("overwrite").parquet(f"{labels_path}/batch_id={batch_id}")
        added.write.mode("overwrite").parquet(f"{memory_path}/batch_id={batch_id}")
    return run


def learned(spark: SparkSession, memory_path: str, before: int | None = None) -> DataFrame | None:
    """What the batches (before a given one) have learned: (merchant, category); None if there are none."""
    parts = [f"{memory_path}/batch_id={b}" for b in _batch_ids(spark, memory_path) if before is None or b < before]
    return spark.read.parquet(*parts).select("merchant", "category") if parts else None


def run_available(stream: DataFrame, fn, checkpoint: str) -> None:
    """Process everything available now, then stop (``trigger(availableNow=True)``)."""
    q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def dedupe_stream(df: DataFrame, event_time: str | Column, horizon: str = "7 days") -> DataFrame:
    """Drop repeated ids that arrive within ``horizon`` of each other."""
    ts = F.col(event_time) if isinstance(event_time, str) else event_time
    return (df.withColumn("_event_ts", ts.cast("timestamp"))
            .withWatermark("_event_ts", horizon)
            .dropDuplicatesWithinWatermark(["transaction_id"]))



def first_by_id(df: DataFrame, event_time: str | Column, order: str, horizon: str = "7 days") -> DataFrame:
    """T3, first wins: of the rows of an id that come within ``horizon`` of each other (in event time, in whatever
    order they arrive) the one with the smallest ``order``. State holds that row per id; it is
    emitted, once, when the watermark (``horizon`` behind the latest event) has passed the last of them
    by ``horizon``, so at the end of a stream the youngest ids are still held. Rows without an id are grouped as one id is."""
    columns = df.columns
    ts = (F.col(event_time) if isinstance(event_time, str) else event_time).cast("timestamp")
    rows = df.withColumn("_event_ts", ts).withWatermark("_event_ts", horizon)
    kept = rows.groupBy("transaction_id", F.session_window("_event_ts", horizon)).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return kept.select("_row.*")
