"""End-to-end batch run (E1): statements folder -> target table, as Spark jobs.

  list the folder (binaryFile listing, no contents) -> supported, unprocessed files
  (anti join with the ledger) -> header roles per file, then one CSV scan of all pending
  statements -> optional per-file duplicate removal -> categorize with learning in file/row
  order -> append unseen ids to the month-partitioned target (J2 across files) ->
  new ledger and memory snapshots, written only after the append has committed.

A crash between the append and the ledger write replays those files next time; their ids
are already in the target, so nothing is appended twice. A file that cannot be read (empty, a
role missing from its header, an unreadable date under ``bad_dates="fail_file"``) counts as
failed and stays out of the ledger, so that a later run tries it again. Statements that need a document
decoder (PDF, spreadsheets) are reported as skipped: decoding binary documents is not
part of this engine (see README); their extracted text goes through ``sources.lines``.
"""
from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.operators.categorize import categorize, categorize_learn
from spendlake.operators.dedupe import remove_duplicates
from spendlake.operators.memory import empty_memory
from spendlake.sources import ingest as I
from spendlake.sources import ledger as L
from spendlake.sources import sink as K
from spendlake.sources import snapshots as SN
from spendlake.schema import DEFAULT_ACCOUNT
from spendlake.session import scratch_path


@dataclass
class RunReport:
    files_processed: int
    files_skipped: int
    rows_parsed: int
    rows_appended: int
    files_failed: int = 0
    rows_rejected: int = 0


def run_pipeline(spark: SparkSession, statements_dir: str, target_path: str, ledger_root: str,
                 memory_root: str, account: str = DEFAULT_ACCOUNT, rules=None, threshold: int = 80,
                 dedupe: bool = False, learn: bool = True, compat: bool = False,
                 bad_dates: str = "fail_file",
                 rejects_path: str | None = None, prune_months: bool = False, files_per_batch: int = 10_000) -> RunReport:
    """Pending files are run in batches of ``files_per_batch`` in name order, each appended and entered in the
    ledger before the next; a file name is all of a file that passes through the driver.

    ``prune_months``: compare ids only with the target's rows of the batch's months; for targets
    whose ids are hashes of the row's own date (F7).

    ``bad_dates``: "fail_file" leaves a file with an unreadable date for a later run,
    "quarantine" loads its other rows. What was not loaded, files and rows, is appended to
    ``rejects_path`` when given (columns of ``ingest.statement_rejects``)."""
    if bad_dates not in ("fail_file", "quarantine"):
        raise ValueError("bad_dates must be 'fail_file' or 'quarantine'")
    ledger = SN.load_latest(spark, ledger_root)
    if ledger is None:
        ledger = L.empty_ledger(spark)
    todo = L.pending(L.list_files(spark, statements_dir), ledger)
    is_csv = L.extension("file_path") == ".csv"
    report = RunReport(0, todo.where(~is_csv).count(), 0, 0)
    for paths in _batches((r.file_path for r in todo.where(is_csv).select("file_path").orderBy("file_path").toLocalIterator()), files_per_batch):
        done = _run_batch(spark, paths, target_path, ledger_root, memory_root, account, rules, threshold, dedupe, learn, compat, bad_dates, rejects_path, prune_months)
        for name in ("files_processed", "rows_parsed", "rows_appended", "files_failed", "rows_rejected"):
            setattr(report, name, getattr(report, name) + getattr(done, name))
    return report


def _batches(paths, size: int):
    """Lists of ``size`` paths in order: no more are on the driver at once."""
    paths = iter(paths)
    while batch := list(islice(paths, size)):
        yield batch


def _run_batch(spark, paths, target_path, ledger_root, memory_root, account, rules, threshold, dedupe, learn, compat, bad_dates,
               rejects_path, prune_months) -> RunReport:
    probe = I.probe_files(spark, paths, compat)
    roles = probe.roles
    scanned = I.statement_rows(spark, paths, account, compat, probe).persist(StorageLevel.MEMORY_AND_DISK)
    bad = scanned.where(F.col("date").isNull())
    done = roles.where(F.col("reason").isNull()).select("file_path")
    if bad_dates == "fail_file":
        done = done.join(bad.select("file_path").distinct(), "file_path", "left_anti")
    txns = scanned.drop("date_text").where(F.col("date").isNotNull()).join(done, "file_path", "left_semi")
    if rejects_path is not None:
        I.rejects_of(bad, probe).write.mode("append").parquet(rejects_path)
    rejected = bad.count()
    if dedupe:
        txns = remove_duplicates(txns, "first", order="row_seq", scope=["file_path"])
    txns = txns.persist(StorageLevel.MEMORY_AND_DISK)
    memory = SN.load_latest(spark, memory_root) or empty_memory(spark)
    if learn:
        labeled, new_memory = categorize_learn(txns, "row_seq", rules, memory, threshold)
    else:
        labeled, new_memory = categorize(txns, rules, memory, threshold), None
    records = K.to_transactions(labeled, keep=("file_path",))

    appended = _append_with_counts(records, target_path, prune_months)
    parsed = txns.groupBy("file_path").agg(F.count("*").alias("row_count"))
    counts = done.join(parsed, "file_path", "left").join(appended, "file_path", "left").select(
        "file_path", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("transactions_added", F.lit(0)).alias("transactions_added"))
    entries = L.entries_for(L.list_files(spark, paths).join(done, "file_path", "left_semi"), account, counts)
    # ledger and memory after the append (replay-safe order)
    entries = _written(entries, "ledger-entries")
    SN.update(spark, ledger_root, lambda ledger: L.upsert(L.empty_ledger(spark) if ledger is None else ledger, entries))
    if new_memory is not None:
        SN.save_next(new_memory, memory_root)
    totals = counts.agg(F.count("*").alias("f"), F.sum("row_count").alias("p"), F.sum("transactions_added").alias("a")).first()
    for cached in (txns, scanned):
        cached.unpersist()
    return RunReport(totals.f, 0, int(totals.p or 0), int(totals.a or 0), len(paths) - totals.f, rejected)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _append_with_counts(records: DataFrame, target_path: str, prune_months: bool) -> DataFrame:
    """Append unseen rows (J2 across files in name order) and return appended rows per
    file. The counts are written before the append: appending refreshes every cached plan
    that reads the target, which would then find its own rows there."""
    spark = records.sparkSession
    target = K.read_target(spark, target_path)
    new = K.unseen(records, target, "file_path", prune_months=prune_months).persist(StorageLevel.MEMORY_AND_DISK)
    counts = scratch_path(spark, "appended-per-file")
    new.groupBy("file_path").agg(F.count("*").alias("transactions_added")).write.parquet(counts)
    K.append_rows(new.drop("file_path"), target, target_path)
    new.unpersist()
    return spark.read.parquet(counts)
