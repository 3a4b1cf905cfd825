"""Schemas of the tables the engine reads and writes, and column validation."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Labels and column headings shared with the reference's workbook layout.
DEFAULT_CATEGORY = "Uncategorized"
FUZZY_THRESHOLD = 80
CONFIDENCE_MEMORY = 0.95
CONFIDENCE_KEYWORD = 0.5
DEFAULT_ACCOUNT = "unknown"
SUPPORTED_EXTENSIONS = (".csv", ".pdf", ".xlsx", ".xls")
TARGET_HEADINGS = ("Date", "Transaction Name", "Category", "Spent From", "Amount", "Notes",
                   "Transaction ID")
CSV_HEADINGS = ("Date", "Description", "Amount", "Category", "Account", "Notes",
                "Transaction ID")

TXN = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("description", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("account", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
])

TARGET = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("spent_from", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("notes", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
])

RULES = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
])

MEMORY = T.StructType([
    T.StructField("merchant", T.StringType(), False),
    T.StructField("category", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("account", T.StringType()),
    T.StructField("transactions_added", T.LongType()),
])


def require_columns(df: DataFrame, cols: Iterable[str], message: str | None = None) -> None:
    """Raise ValueError when any of ``cols`` is missing (schema check, no Spark job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(message or f"missing required columns: {missing}")


def empty_frame(spark, schema: T.StructType):
    """An empty DataFrame of ``schema`` planned in the JVM (no Python RDD behind it)."""
    from pyspark.sql import functions as F
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
