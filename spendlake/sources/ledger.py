"""Processed-file ledger (S8-S11, A2, W1, W2) as immutable DataFrame snapshots.

The ledger is a table keyed by ``file_path``. Updates produce a new snapshot (upsert =
union + latest per path, delete = anti join); callers write it to a new versioned path and
switch to it, never overwriting the path being read.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.schema import LEDGER, SUPPORTED_EXTENSIONS, empty_frame
from spendlake.sources import ranges


def empty_ledger(spark: SparkSession) -> DataFrame:
    return empty_frame(spark, LEDGER)


def upsert(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace existing rows of the same path; the latest ``processed_at``
    wins among several entries for one path. Hash aggregate with partial aggregation."""
    cols = [f.name for f in LEDGER.fields]
    allr = ledger.select(*cols).unionByName(entries.select(*cols))
    latest = allr.groupBy("file_path").agg(
        F.max_by(F.struct(*[c for c in cols if c != "file_path"]), "processed_at").alias("_r"))
    return latest.select("file_path", "_r.*")


def unmark(ledger: DataFrame, paths: DataFrame) -> DataFrame:
    """Drop the given paths (column ``file_path``); an empty ``paths`` keeps all."""
    return ledger.join(paths.select("file_path"), "file_path", "left_anti")


def clear_all(ledger: DataFrame) -> DataFrame:
    """An empty snapshot with the same schema."""
    return empty_ledger(ledger.sparkSession)


def is_processed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The files (column ``file_path``) that are in the ledger."""
    return files.join(ledger.select("file_path"), "file_path", "left_semi")


def processed_info(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger details per file, null when never processed."""
    return files.join(ledger, "file_path", "left")


def extension(path_col) -> F.Column:
    """Lower-cased suffix including the dot ("" when there is none)."""
    p = F.col(path_col) if isinstance(path_col, str) else path_col
    ext = F.regexp_extract(F.regexp_extract(p, r"([^/]*)$", 1), r"(\.[^.]*)$", 1)
    return F.lower(ext)


def pending(files: DataFrame, ledger: DataFrame,
            extensions: Iterable[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """Supported files (by lower-cased suffix) not yet in the ledger. The
    reference walks files in name order; ``file_path`` itself is that order key (a string
    compares like the sorted walk), so no global ranking pass is needed."""
    exts = [e.lower() for e in extensions]
    return (files.where(extension("file_path").isin(exts))
            .join(ledger.select("file_path"), "file_path", "left_anti"))


def summary(ledger: DataFrame) -> DataFrame:
    """A2: number of files and summed row counts (missing values count as 0)."""
    return ledger.agg(F.count("*").alias("total_files"),
                      F.coalesce(F.sum(F.coalesce("row_count", F.lit(0))), F.lit(0)).cast("long")
                      .alias("total_rows"),
                      F.coalesce(F.sum(F.coalesce("transactions_added", F.lit(0))), F.lit(0)).cast("long")
                      .alias("total_transactions"))


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """The folder listing as (file_path, file_size, modification_time), no contents read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
          .load(folder))
    return df.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"),
                     F.col("modificationTime").alias("modification_time"))


def entries_for(files: DataFrame, account, row_counts: DataFrame, hash_contents: bool = True,
                block_bytes: int = ranges.BLOCK_BYTES) -> DataFrame:
    """S10 entries for the processed files (a listing: file_path, file_size): size and content hash (range
    reads and a hash tree, see ``ranges``), row and appended counts from ``row_counts`` (file_path, row_count,
    transactions_added)."""
    acct = account if isinstance(account, F.Column) else F.lit(account)
    meta = files.select("file_path", "file_size")
    meta = (meta.join(ranges.content_hashes(meta, block_bytes), "file_path") if hash_contents
            else meta.withColumn("file_hash", F.lit("")))
    return (meta.join(row_counts, "file_path", "left")
            .select("file_path", F.current_timestamp().alias("processed_at"), "file_size",
                    "file_hash", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
                    acct.alias("account"),
                    F.coalesce("transactions_added", F.lit(0)).cast("long").alias("transactions_added")))
