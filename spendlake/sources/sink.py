"""Append-only target table, existing ids, CSV export and record projections
(S12-S14, J2, W4, U2, U3, P4, P5).

A new target is a Parquet table partitioned by month of ``date``. A batch is compared with
all ids of the target. Where every id was made by F7 from the row's own date, equal ids share
a month, and the caller may ask to compare with the batch's months alone (``prune_months``: a
semi join on the partition column, which Spark turns into partition pruning).
"""
from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.values import transaction_hash
from spendlake.schema import CSV_HEADINGS, TARGET, TARGET_HEADINGS, require_columns

PARTITION = "month"


def to_transactions(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The record projection (date, name, category, spent_from, amount, notes, id).
    Requires date, description, category, account, amount, transaction_id; notes is
    optional (""), nulls stay null."""
    require_columns(df, ("date", "description", "category", "account", "amount", "transaction_id"),
                    "DataFrame is missing required columns for export")
    notes = F.col("notes").cast("string") if "notes" in df.columns else F.lit("")
    return df.select(F.col("date").cast("date").alias("date"),
                     F.col("description").cast("string").alias("name"),
                     F.col("category").cast("string").alias("category"),
                     F.col("account").cast("string").alias("spent_from"),
                     F.col("amount").cast("double").alias("amount"),
                     notes.alias("notes"),
                     F.col("transaction_id").cast("string").alias("transaction_id"), *keep)


def export_projection(records: DataFrame) -> DataFrame:
    """P5: records renamed to the CSV export headings (empty input allowed)."""
    r = records
    return r.select(F.col("date").alias(CSV_HEADINGS[0]), F.col("name").alias(CSV_HEADINGS[1]),
                    F.col("amount").alias(CSV_HEADINGS[2]), F.col("category").alias(CSV_HEADINGS[3]),
                    F.col("spent_from").alias(CSV_HEADINGS[4]),
                    F.coalesce(F.col("notes"), F.lit("")).alias(CSV_HEADINGS[5]),
                    F.col("transaction_id").alias(CSV_HEADINGS[6]))


def write_csv(records: DataFrame, path: str) -> None:
    """Overwrite ``path`` with the CSV export; empty input raises ValueError."""
    if records.isEmpty():
        raise ValueError("nothing to write: the table has no rows")
    export_projection(records).write.mode("overwrite").option("header", True).csv(path)


#: Words that mark a target's columns, and which of several marked ones counts.
COLUMN_MARKS = {"date": ("first", "date"), "name": ("last", "transaction name|description|merchant"),
                "amount": ("last", "amount"), "account": ("last", "spent|account")}


def _marked_column(columns: dict[str, str], role: str) -> str | None:
    """The column (lower-cased name: name) that the marks of ``role`` point to."""
    which, marks = COLUMN_MARKS[role]
    hits = [real for low, real in columns.items() if re.search(marks, low)]
    return (hits[0] if which == "first" else hits[-1]) if hits else None


def existing_ids(target: DataFrame) -> DataFrame:
    """Distinct ids of a target table. Rows without an id, or all rows of a table
    without an id column, get the id recomputed (F7) from the date / name / amount / account
    columns found by name; those without a date are skipped, a null amount counts as 0.0."""
    cols = {c.lower(): c for c in target.columns}
    id_col = next((c for c in target.columns if "transaction" in c.lower() and "id" in c.lower()), None)
    stored = F.nullif(F.col(id_col).cast("string"), F.lit("")) if id_col else F.lit(None).cast("string")

    date_c, desc_c, amt_c, acct_c = (_marked_column(cols, role) for role in COLUMN_MARKS)
    made = F.lit(None).cast("string")
    if date_c is not None:
        desc = F.col(desc_c) if desc_c else F.lit("")
        amt = F.coalesce(F.col(amt_c).cast("double"), F.lit(0.0)) if amt_c else F.lit(0.0)
        acct = F.coalesce(F.col(acct_c).cast("string"), F.lit("")) if acct_c else F.lit("")
        made = F.when(F.col(date_c).isNotNull(), transaction_hash(F.col(date_c), desc, amt, acct,
                                                                  date_type=target.schema[date_c].dataType))
    return (target.select(F.coalesce(stored, made).alias("transaction_id"))
            .where(F.col("transaction_id").isNotNull()).distinct())


def new_rows(batch: DataFrame, existing: DataFrame | None, file_order: str | None = None) -> DataFrame:
    """Rows of ``batch`` whose id is not in ``existing`` (null ids always kept).
    With ``file_order``, the batch stands for several files loaded one after another: a
    row also drops when its id appeared in an earlier file; repeats inside one file stay.
    The earliest file per id is a hash aggregate joined back (no per-id window). Without
    ``existing`` (None) no row is known yet."""
    fresh = batch if existing is None else batch.join(existing.select("transaction_id"), "transaction_id", "left_anti")
    if file_order is None:
        return fresh
    first = (fresh.where(F.col("transaction_id").isNotNull())
             .groupBy("transaction_id").agg(F.min(file_order).alias("_first")))
    j = fresh.join(first, "transaction_id", "left")
    return j.where(F.col("_first").isNull() | (F.col(file_order) == F.col("_first"))).drop("_first")


def append_new(batch: DataFrame, target_path: str, file_order: str | None = None,
               prune_months: bool = False) -> int:
    """Append unseen rows of ``batch`` (Target schema) to the Parquet table at
    ``target_path``; returns the number appended. Existing rows never change. Empty input
    raises ValueError, like the reference. Targets without an id column, or not partitioned
    by month, keep their layout (see ``append_rows``); ``prune_months``: see ``unseen``."""
    spark = batch.sparkSession
    if batch.isEmpty():
        raise ValueError("nothing to append: the batch has no rows")
    target = read_target(spark, target_path)
    # one pass: the appended count is an observed metric of the write itself
    obs = Observation("appended")
    new = unseen(batch, target, file_order, prune_months).select(*[f.name for f in TARGET.fields])
    append_rows(new, target, target_path, obs)
    return int(obs.get["n"])


def unseen(batch: DataFrame, target: DataFrame | None, file_order: str | None = None,
           prune_months: bool = False) -> DataFrame:
    """Rows of ``batch`` that a target (None: no target yet) does not hold, by id; see
    ``new_rows``. Rows of the target without an id are known by the id that F7 gives them.
    ``prune_months`` reads the target's months of the batch alone: exact only when every id
    is F7 of the row's own date."""
    if target is None:
        return new_rows(batch, None, file_order)
    if prune_months and PARTITION in target.columns:
        months = batch.select(F.date_format("date", "yyyy-MM").alias(PARTITION)).distinct()
        target = target.join(months, PARTITION, "left_semi")
    return new_rows(batch, existing_ids(target), file_order)


def append_rows(new: DataFrame, target: DataFrame | None, target_path: str, obs: Observation | None = None) -> None:
    """Append ``new`` to the table at ``target_path`` in the table's layout: by month when
    it is new or has the month partition, else in plain files. A table without an id column
    gains one; its older rows then read as null ids.

    Rows are brought together by month first, large months in several parts, so that the number of files follows
    the size of the months and not the number of tasks times months. ``obs`` counts them as ``n``, after that shuffle:
    below it the metric would go with an empty stage."""
    by_month = target is None or PARTITION in target.columns
    if by_month:
        new = new.withColumn(PARTITION, F.date_format("date", "yyyy-MM")).hint("rebalance", F.col(PARTITION))
    if obs is not None:
        new = new.observe(obs, F.count(F.lit(1)).alias("n"))
    out = new.write.mode("append")
    (out.partitionBy(PARTITION) if by_month else out).parquet(target_path)


def read_target(spark: SparkSession, target_path: str) -> DataFrame | None:
    """The target table, or None when it does not exist yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(target_path)
    except AnalysisException as e:
        if path_is_missing(e):
            return None
        raise  # an unreadable target is not an empty one


def path_is_missing(e: AnalysisException) -> bool:
    """The path does not exist, or holds no data files yet."""
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def workbook_projection(records: DataFrame) -> DataFrame:
    """S12 column layout: records renamed to the workbook headings."""
    return records.select(*[F.col(c).alias(h) for c, h in zip([f.name for f in TARGET.fields], TARGET_HEADINGS)])
