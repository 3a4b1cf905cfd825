"""Duplicate search and removal.

Every operator here is a hash aggregate (with map-side partial aggregation) plus a join
back, never a per-key window: a key holding a third of all rows is combined map-side and
split by AQE's skew join instead of landing in one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.schema import require_columns


def _key_cols(df: DataFrame, key: Sequence[str] | None) -> list[str]:
    if key:
        return list(key)
    if "transaction_id" in df.columns:
        return ["transaction_id"]
    return ["date", "description", "amount"]


def find_duplicates(df: DataFrame, tolerance_cents: int = 0, sort: bool = True) -> DataFrame:
    """A1: rows whose (date, description) group has more than one row. Amount is not
    compared and ``tolerance_cents`` is accepted but unused (reference behavior; see
    ``find_near_duplicates`` for the documented variant). Null keys never count."""
    if not {"date", "description", "amount"} <= set(df.columns):
        return df.sparkSession.createDataFrame([], df.schema)
    keys = ["date", "description"]
    groups = (df.where(F.col("date").isNotNull() & F.col("description").isNotNull())
              .groupBy(*keys).count().where(F.col("count") > 1).drop("count"))
    out = df.join(groups, keys, "left_semi")
    return out.orderBy(*keys) if sort else out


def find_near_duplicates(df: DataFrame, tolerance_cents: int, sort: bool = True) -> DataFrame:
    """Rows with another row of the same (date, description) whose amount is within
    ``tolerance_cents``. Amounts are bucketed by the tolerance: two rows in one bucket are
    always within it, rows two buckets apart never are, so per-bucket count/min/max plus
    the neighbor buckets' max/min decide every row; no window, no pairs."""
    require_columns(df, ("date", "description", "amount"))
    keys = ["date", "description"]
    tol = int(tolerance_cents)
    base = (df.where(F.col("date").isNotNull() & F.col("description").isNotNull())
            .withColumn("_cents", F.round(F.col("amount") * 100).cast("long")))
    width = max(tol, 1)
    bucket = F.floor(F.col("_cents") / F.lit(width)).cast("long") if tol > 0 else F.col("_cents")
    base = base.withColumn("_b", bucket)
    per = base.groupBy(*keys, "_b").agg(F.count("*").alias("n"), F.min("_cents").alias("lo"),
                                        F.max("_cents").alias("hi"))
    # what each bucket needs to know: its own count, the previous bucket's max, the next min
    info = (per.select(*keys, "_b", "n", F.lit(None).cast("long").alias("prev_hi"),
                       F.lit(None).cast("long").alias("next_lo"))
            .unionByName(per.select(*keys, (F.col("_b") + 1).alias("_b"), F.lit(0).cast("long").alias("n"),
                                    F.col("hi").alias("prev_hi"), F.lit(None).cast("long").alias("next_lo")))
            .unionByName(per.select(*keys, (F.col("_b") - 1).alias("_b"), F.lit(0).cast("long").alias("n"),
                                    F.lit(None).cast("long").alias("prev_hi"), F.col("lo").alias("next_lo")))
            .groupBy(*keys, "_b").agg(F.sum("n").alias("n"), F.max("prev_hi").alias("prev_hi"),
                                      F.min("next_lo").alias("next_lo")))
    j = base.join(info, keys + ["_b"], "inner")
    ok = (F.col("n") > 1)
    if tol > 0:
        ok = ok | (F.col("_cents") - F.col("prev_hi") <= tol) | (F.col("next_lo") - F.col("_cents") <= tol)
    out = j.where(ok).select(*df.columns)
    return out.orderBy(*keys) if sort else out


def remove_duplicates(df: DataFrame, keep: str | bool = "first", order: str = "row_seq",
                      key: Sequence[str] | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Drop repeated rows by key (``transaction_id`` if present, else date,
    description, amount; nulls equal each other). ``keep``: "first"/"last" by ``order``,
    or False to drop every row of a repeated key. ``scope`` adds partition columns (e.g.
    the source file: the reference dedupes one file at a time).

    first/last: ``groupBy(key).agg(min_by/max_by(struct(row), order))`` - partial
    aggregation, so a hot key costs one small record per map task.
    """
    cols = list(scope) + _key_cols(df, key)
    require_columns(df, cols + [order])
    # null-safe grouping: groupBy treats null keys as one group, like the reference
    row = F.struct(*[F.col(c) for c in df.columns])
    if keep == "first":
        agg = F.min_by(row, F.col(order))
    elif keep == "last":
        agg = F.max_by(row, F.col(order))
    elif keep is False or keep == "none":
        agg = F.first(row)
    else:
        raise ValueError("keep must be 'first', 'last' or False")
    grouped = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)]).agg(
        agg.alias("_r"), F.count("*").alias("_n"))
    if keep is False or keep == "none":
        grouped = grouped.where(F.col("_n") == 1)
    return grouped.select("_r.*")
