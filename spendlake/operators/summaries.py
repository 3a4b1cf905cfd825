"""Reports (A3-A8, A9): totals by category, month, merchant and account; budget vs actual;
period over period; run counters.

Money is summed as DECIMAL(18,2) (exact, independent of shuffle order) and returned as
DOUBLE; every grouping is a partial + final hash aggregate. Windows (month-over-month,
period-over-period) run only on the already aggregated, small result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.text import extract_merchant

MONEY = "decimal(18,2)"


def summary_frame(records: DataFrame) -> DataFrame:
    """Target records -> the (date, description, amount, category, account) frame the
    reports read."""
    return records.select(F.col("date").cast("date").alias("date"), F.col("name").alias("description"),
                          F.col("amount").cast("double").alias("amount"), "category",
                          F.col("spent_from").alias("account"))


def _money_sum(c: str = "amount"):
    return F.sum(F.col(c).cast(MONEY))


def _partials(df: DataFrame, keys) -> DataFrame:
    """(keys, _t = exact money sum, _n = row count). Accepts rows (with ``amount``) or
    partials already aggregated at a finer grain (with ``_t``/``_n``)."""
    if "_t" in df.columns and "_n" in df.columns:
        return df.groupBy(*keys).agg(F.sum("_t").alias("_t"), F.sum("_n").alias("_n"))
    return df.groupBy(*keys).agg(_money_sum().alias("_t"), F.count("*").alias("_n"))


def labeled_partials(df: DataFrame, label, keys=(), description: str = "description") -> DataFrame:
    """Aggregate first, label after: money partials per (description, keys), then
    ``label(description)`` evaluated once per distinct description instead of once per row
    (labels depend on the description only). Every report accepts the result in place of
    labeled rows, with identical output."""
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    p = _partials(df, [F.col(description), *key_cols])
    if not key_cols:
        return p.withColumn("category", label(F.col(description)))
    # with extra keys (month, year) there are several partial rows per description: label
    # each distinct description once and join the small label table back
    labels = p.select(description).distinct().withColumn("category", label(F.col(description)))
    return p.join(labels, description)


def with_period(df: DataFrame, unit: str, name: str) -> DataFrame:
    """Adds the truncated period of ``date`` (a DATE) as ``name``."""
    return df.withColumn(name, F.to_date(F.date_trunc(unit, F.col("date"))))


def category_summary(df: DataFrame) -> DataFrame:
    """A3: total, count, average and percent of the grand total per category.
    The grand total is a window over the per-category aggregate (one row per category)."""
    per = _partials(df, ["category"]).withColumnRenamed("_n", "n_txn")
    return (per.withColumn("_g", F.sum("_t").over(Window.partitionBy()))
            .select("category",
                    F.col("_t").cast("double").alias("total"),
                    F.col("n_txn"),
                    F.round(F.col("_t").cast("double") / F.col("n_txn"), 6).alias("average"),
                    F.round(F.when(F.col("_g") != 0, F.col("_t").cast("double") * 100
                                   / F.col("_g").cast("double")), 6).alias("percent")))


def monthly_summary(df: DataFrame, dense: bool = False) -> DataFrame:
    """A4: per (month, category) total and count, previous month's total of the category
    and the change (null for a category's first month). ``dense=True`` also lists the
    months without rows between a category's first and last month (total 0)."""
    if "month" not in df.columns:
        df = with_period(df, "month", "month")
    per = _partials(df, ["month", "category"]).withColumnRenamed("_n", "n_txn")
    if dense:
        span = per.groupBy("category").agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
        grid = span.select("category", F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH")))
                           .alias("month"))
        per = (grid.join(per, ["category", "month"], "left")
               .select("month", "category", F.coalesce("_t", F.lit(0).cast(MONEY)).alias("_t"),
                       F.coalesce("n_txn", F.lit(0).cast("long")).alias("n_txn")))
    w = Window.partitionBy("category").orderBy("month")
    prev = F.lag("_t").over(w)
    return per.select("month", "category", F.col("_t").cast("double").alias("total"), "n_txn",
                      prev.cast("double").alias("prev_total"),
                      (F.col("_t") - prev).cast("double").alias("change"))


def merchant_summary(df: DataFrame, top: int | None = 10) -> DataFrame:
    """A5: total and frequency per merchant (F4 of the description); the top ``top`` by
    total, ties by merchant name. ``top=None`` returns every merchant. Money is summed per
    description first, so F4 runs once per distinct description, not per row."""
    per_desc = _partials(df, ["description"]).withColumn("merchant", extract_merchant("description"))
    per = _partials(per_desc, ["merchant"])
    per = per.select("merchant", F.col("_t").cast("double").alias("total"), F.col("_n").alias("n_txn"))
    if top is None:
        return per
    return per.orderBy(F.col("total").desc(), F.col("merchant")).limit(top)


def account_summary(df: DataFrame) -> DataFrame:
    """Total and count per account."""
    return (df.groupBy("account").agg(_money_sum().alias("_t"), F.count("*").alias("n_txn"))
            .select("account", F.col("_t").cast("double").alias("total"), "n_txn"))


def budget_vs_actual(df: DataFrame, budgets: DataFrame) -> DataFrame:
    """Actual per category against a (category, budget) table, full outer join:
    categories without spending and spending without a budget both appear."""
    actual = _partials(df, ["category"]).drop("_n")
    b = budgets.select("category", F.col("budget").cast(MONEY).alias("_b"))
    j = actual.join(b, "category", "full_outer")
    return j.select(
        "category",
        F.coalesce(F.col("_t"), F.lit(0).cast(MONEY)).cast("double").alias("actual"),
        F.col("_b").cast("double").alias("budget"),
        (F.coalesce(F.col("_t"), F.lit(0).cast(MONEY)) - F.col("_b")).cast("double").alias("variance"),
        F.round(F.when(F.col("_b") != 0, F.coalesce(F.col("_t"), F.lit(0).cast(MONEY)).cast("double")
                       / F.col("_b").cast("double")), 6).alias("ratio"))


def period_over_period(df: DataFrame, period: str = "year") -> DataFrame:
    """Per (period, category) total against the same category's previous period."""
    if "period" not in df.columns:
        df = with_period(df, period, "period")
    per = _partials(df, ["period", "category"]).drop("_n")
    w = Window.partitionBy("category").orderBy("period")
    prev = F.lag("_t").over(w)
    return per.select(
        "period", "category", F.col("_t").cast("double").alias("total"),
        prev.cast("double").alias("prev_total"),
        F.round(F.when(prev != 0, (F.col("_t") - prev).cast("double") * 100 / prev.cast("double")), 6)
        .alias("pct_change"))


def load_statuses(batch: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """The outcome of loading every row of ``batch`` (``transaction_id``) into a target with the ids
    ``existing``: ``status`` already_loaded, duplicate (of an earlier row in ``order``) or new."""
    first = batch.groupBy("transaction_id").agg(F.min(order).alias("_first"))
    known = existing.select("transaction_id").distinct().withColumn("_old", F.lit(True))
    return (batch.join(known, "transaction_id", "left").join(first, "transaction_id", "left")
            .withColumn("status", F.when(F.col("_old"), "already_loaded").when(F.col(order) > F.col("_first"), "duplicate").otherwise("new"))
            .drop("_old", "_first"))


def run_counters(statuses: DataFrame, status: str = "status") -> DataFrame:
    """How many rows ended in each status of a run (new, duplicate, already loaded...)."""
    return statuses.groupBy(status).agg(F.count("*").alias("n_rows"))
