"""Plan shapes that the design relies on at scale (checked on the executed physical plan)."""
import datetime

from pyspark.sql import functions as F

from spendlake.functions import values as V
from spendlake.operators import categorize as C
from spendlake.operators import dedupe as D
from spendlake.sources import sink as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, n=200):
    return spark.createDataFrame([(i, f"SHOP {i % 17} #{i}", float(i % 5)) for i in range(n)],
                                 "seq long, description string, amount double")


def test_categorize_plan_has_no_python_and_no_nested_loop_for_fuzzy(spark):
    p = plan(C.categorize(rows(spark)))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    # the only nested-loop join is the keyword substring match against the broadcast rules
    assert p.count("BroadcastNestedLoopJoin") <= 1
    fz = plan(C.fuzzy_best(rows(spark).select(F.col("description").alias("_merchant")),
                           C.rules_frame(spark), 80, n_keywords=83))
    assert "BroadcastNestedLoopJoin" not in fz and "CartesianProduct" not in fz
    assert "BroadcastHashJoin" in fz or "SortMergeJoin" in fz


def test_categorize_scores_distinct_descriptions_not_rows(spark):
    p = C.categorize(rows(spark))._jdf.queryExecution().optimizedPlan().toString()
    # rows are reduced by an aggregate before any similarity / title-case work
    assert p.count("Aggregate") >= 3


def test_dedupe_and_learning_avoid_per_key_windows(spark):
    df = rows(spark)
    assert "Window" not in plan(D.remove_duplicates(df, "first", "seq", key=["description"]))
    out, _ = C.categorize_learn(df, "seq")
    assert "Window" not in plan(out)
    assert "Window" not in plan(D.find_near_duplicates(df.withColumn("date", F.current_date()), 100))


def test_append_reads_only_batch_months(spark, tmp_path):
    base = spark.createDataFrame([(datetime.date(2024, m, 1), f"m{m}", float(m), "a", "c") for m in range(1, 13)],
                                 "date date, description string, amount double, account string, category string")
    target = str(tmp_path / "t")
    K.append_new(K.to_transactions(V.add_transaction_id(base)), target)
    batch = K.to_transactions(V.add_transaction_id(base.where(F.month("date") == 3))) \
        .withColumn("month", F.date_format("date", "yyyy-MM"))
    existing = spark.read.parquet(target).join(batch.select("month").distinct(), "month", "left_semi")
    p = plan(K.new_rows(batch, existing.select("transaction_id")))
    assert "dynamicpruningexpression" in p


def test_scan_prunes_columns(spark, tmp_path):
    from spendlake.plans.views import txn_e
    p = plan(txn_e(spark, "/root/testdata/sf0.001"))
    assert "props" not in p.split("ReadSchema")[1].split("\n")[0]
