"""Statement rows from extracted text (S4, S5, W3, W5): text lines or table-cell rows.

The reference decodes PDF pages with a per-file library; here the input is text that was
already extracted (``spark.read.text`` of exported lines, or an ``array<string>`` cells
column), and the matching is native regex work.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statement line patterns (leftmost date; trailing amount, group 1 is the
# number without sign or currency).
DATE_RE = r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-[A-Za-z]{3}-\d{2})"
AMOUNT_RE = r"-?\$?\s?([0-9,]+\.?[0-9]{0,2})$"
DESCRIPTION_STRIP = " -|,"


def _number(g1: Column) -> Column:
    return F.regexp_replace(g1, ",", "").try_cast("double")


def _signed(whole: Column, value: Column, keep_sign: bool) -> Column:
    if not keep_sign:
        return value
    return F.when(whole.startswith("-"), -value).otherwise(value)


def parse_lines(df: DataFrame, col: str = "value", keep_sign: bool = True) -> DataFrame:
    """One statement row per line having both a date and a trailing amount.
    Adds ``date_text``, ``description`` (text between the two matches, stripped of
    " -|,"), ``amount_text`` and ``amount`` (with its sign; without ``keep_sign``
    it is dropped, as the reference does; null when the number text is empty)."""
    line = F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", "")
    d = df.withColumn("_line", line).where(F.col("_line") != "")          # W5
    dt = F.regexp_extract("_line", DATE_RE, 0)
    ds = F.regexp_instr("_line", F.lit(DATE_RE))
    a_all = F.regexp_extract("_line", AMOUNT_RE, 0)
    a1 = F.regexp_extract("_line", AMOUNT_RE, 1)
    a_start = F.regexp_instr("_line", F.lit(AMOUNT_RE))
    d = d.select("*", dt.alias("date_text"), ds.alias("_ds"), a_all.alias("_aall"),
                 a1.alias("amount_text"), a_start.alias("_as"))
    d = d.where((F.col("_ds") > 0) & (F.col("_as") > 0))                    # W3
    begin = F.col("_ds") + F.length("date_text")
    span = F.greatest(F.col("_as") - begin, F.lit(0))
    desc = F.btrim(F.substring(F.col("_line"), begin, span), F.lit(DESCRIPTION_STRIP))
    return d.select(*[c for c in df.columns], "date_text", desc.alias("description"),
                    "amount_text",
                    _signed(F.col("_aall"), _number(F.col("amount_text")), keep_sign).alias("amount"))


def parse_cells(df: DataFrame, col: str = "cells", keep_sign: bool = True) -> DataFrame:
    """Table rows (array of cell texts): cells trimmed (null -> ""), joined with
    " | ", matched like S4; description = the non-empty cells that are neither the date
    text nor the amount number, joined by a space."""
    cells = F.transform(F.col(col), lambda c: F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""),
                                                         F.lit("")))
    d = df.withColumn("_cells", cells).withColumn("_joined", F.array_join("_cells", " | "))
    d = d.where((F.regexp_instr("_joined", F.lit(DATE_RE)) > 0) & (F.regexp_instr("_joined", F.lit(AMOUNT_RE)) > 0))
    dt = F.regexp_extract("_joined", DATE_RE, 0)
    a1 = F.regexp_extract("_joined", AMOUNT_RE, 1)
    d = d.select("*", dt.alias("date_text"), a1.alias("amount_text"),
                 F.regexp_extract("_joined", AMOUNT_RE, 0).alias("_aall"))
    keep = F.filter("_cells", lambda c: (c != "") & (c != F.col("date_text")) & (c != F.col("amount_text")))
    desc = F.trim(F.array_join(keep, " "))
    return d.select(*[c for c in df.columns], "date_text", desc.alias("description"), "amount_text",
                    _signed(F.col("_aall"), _number(F.col("amount_text")), keep_sign).alias("amount"))
