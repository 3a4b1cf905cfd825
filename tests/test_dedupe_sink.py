"""Reference test cases plus sequential-model checks."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from spendlake.functions import values as V
from spendlake.operators import dedupe as D
from spendlake.sources import sink as K

D1, D2 = datetime.date(2024, 1, 15), datetime.date(2024, 1, 16)


def test_find_duplicates(spark):
    df = spark.createDataFrame([(D1, "A", 5.0), (D1, "A", 6.0), (D2, "B", 1.0), (None, "A", 1.0), (None, "A", 1.0)],
                               "date date, description string, amount double")
    out = D.find_duplicates(df).collect()
    assert len(out) == 2 and {r.amount for r in out} == {5.0, 6.0}
    assert D.find_duplicates(df.drop("amount")).count() == 0


def test_dedupe_keep_first_last_none(spark):
    df = spark.createDataFrame([("2024-01-15", "A", 5.0, "id1", 0), ("2024-01-15", "A", 5.0, "id1", 1),
                                ("2024-01-16", "B", 1.0, "id2", 2)],
                               "date string, description string, amount double, transaction_id string, row_seq long")
    first = D.remove_duplicates(df, "first").orderBy("row_seq").collect()
    assert [r.row_seq for r in first] == [0, 2]
    last = D.remove_duplicates(df, "last").orderBy("row_seq").collect()
    assert [r.row_seq for r in last] == [1, 2]
    none = D.remove_duplicates(df, False).collect()
    assert [r.row_seq for r in none] == [2]
    assert D.remove_duplicates(df, "first").columns == df.columns


def test_dedupe_null_keys_group_together(spark):
    df = spark.createDataFrame([(None, "A", 1.0, 0), (None, "A", 1.0, 1)],
                               "date date, description string, amount double, row_seq long")
    assert D.remove_duplicates(df, "first").count() == 1


def test_near_duplicates_match_pairwise_model(spark):
    rnd = random.Random(5)
    rows = [(i, D1 if rnd.random() < 0.5 else D2, rnd.choice("AB"), round(rnd.uniform(0, 20), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, date date, description string, amount double")
    for tol in (0, 7, 150):
        got = {r.id for r in D.find_near_duplicates(df, tol, sort=False).collect()}
        want = {a[0] for a in rows for b in rows if a[0] != b[0] and a[1:3] == b[1:3]
                and abs(round(a[3] * 100) - round(b[3] * 100)) <= tol}
        assert got == want


def records(spark, rows):
    df = spark.createDataFrame(rows, "date date, description string, amount double, account string, category string")
    return K.to_transactions(V.add_transaction_id(df))


def test_append_only_new_and_idempotent(spark, tmp_path):
    target = str(tmp_path / "target")
    r1 = records(spark, [(D1, "A", 1.0, "chq", "X")])
    assert K.append_new(r1, target) == 1
    r2 = records(spark, [(D1, "A", 1.0, "chq", "X"), (D2, "B", 2.0, "chq", "Y")])
    assert K.append_new(r2, target) == 1
    assert K.append_new(r2, target) == 0
    t = spark.read.parquet(target)
    assert t.count() == 2
    with pytest.raises(ValueError):
        K.append_new(r1.limit(0), target)


def test_existing_ids_recomputed_without_id_column(spark):
    r = records(spark, [(D1, "STARBUCKS COFFEE", 5.5, "chequing", "Dining")])
    target = r.drop("transaction_id").toDF("Date", "Transaction Name", "Category", "Spent From", "Amount", "Notes")
    assert K.existing_ids(target).first().transaction_id == "0df7ec5da3c4aec4756f88aedd11610276bebd9e"


def test_filter_new_keeps_null_ids(spark):
    b = spark.createDataFrame([("id1",), ("id2",), (None,)], "transaction_id string")
    e = spark.createDataFrame([("id1",)], "transaction_id string")
    assert sorted(r.transaction_id or "" for r in K.new_rows(b, e).collect()) == ["", "id2"]


def test_multi_file_matches_sequential_loads(spark):
    rnd = random.Random(11)
    rows = [(f"f{rnd.randint(0, 4)}", f"id{rnd.randint(0, 20)}", i) for i in range(150)]
    existing = {f"id{i}" for i in range(0, 20, 5)}
    b = spark.createDataFrame(rows, "file string, transaction_id string, n long")
    e = spark.createDataFrame([(x,) for x in existing], "transaction_id string")
    got = sorted(r.n for r in K.new_rows(b, e, file_order="file").collect())
    seen, want = set(existing), []
    for f in sorted({r[0] for r in rows}):
        batch = [r for r in rows if r[0] == f]
        keep = [r for r in batch if r[1] not in seen]
        want += [r[2] for r in keep]
        seen |= {r[1] for r in keep}
    assert got == sorted(want)


def test_to_transactions_requires_columns(spark):
    df = spark.createDataFrame([("x", 1.0)], "description string, amount double")
    with pytest.raises(ValueError):
        K.to_transactions(df)


def test_csv_export(spark, tmp_path):
    r = records(spark, [(D1, "A", 1.0, "chq", "X")])
    p = str(tmp_path / "out")
    K.write_csv(r, p)
    back = spark.read.option("header", True).csv(p)
    assert back.columns == ["Date", "Description", "Amount", "Category", "Account", "Notes", "Transaction ID"]
    with pytest.raises(ValueError):
        K.write_csv(r.limit(0), p)


def test_shuffled_input_same_result(spark):
    rows = [(i % 7, f"d{i % 5}", float(i % 3), i) for i in range(200)]
    df = spark.createDataFrame(rows, "date long, description string, amount double, row_seq long")
    a = sorted(map(tuple, D.remove_duplicates(df, "first").collect()))
    b = sorted(map(tuple, D.remove_duplicates(df.repartition(13).orderBy(F.rand(1)), "first").collect()))
    assert a == b


def test_find_duplicates_sorted_by_date_and_description(spark):
    df = spark.createDataFrame([(D2, "B", 1.0), (D1, "Z", 2.0), (D2, "B", 3.0), (D1, "Z", 4.0), (D1, "A", 5.0)],
                               "date date, description string, amount double")
    got = [(r.date, r.description) for r in D.find_duplicates(df).collect()]
    assert got == [(D1, "Z"), (D1, "Z"), (D2, "B"), (D2, "B")]


def test_monthly_summary_dense(spark):
    from spendlake.operators import summaries as S
    df = spark.createDataFrame([(datetime.date(2024, 1, 5), "A", 10.0), (datetime.date(2024, 3, 7), "A", 5.0)],
                               "date date, category string, amount double")
    sparse = S.monthly_summary(df).orderBy("month").collect()
    assert [(r.month.month, r.total, r.prev_total) for r in sparse] == [(1, 10.0, None), (3, 5.0, 10.0)]
    dense = S.monthly_summary(df, dense=True).orderBy("month").collect()
    assert [(r.month.month, r.total, r.n_txn, r.prev_total) for r in dense] == [
        (1, 10.0, 1, None), (2, 0.0, 0, 10.0), (3, 5.0, 1, 0.0)]


def test_append_to_target_without_id_and_month(spark, tmp_path):
    """A table in its own layout: ids of its rows are recomputed, it gains an id column."""
    target = str(tmp_path / "t")
    base = spark.createDataFrame([(datetime.date(2024, 1, 15), "coffee", 5.5, "chq", "Dining"),
                                  (datetime.date(2024, 2, 15), "books", 9.0, "chq", "Fun")],
                                 "date date, description string, amount double, account string, category string")
    records = K.to_transactions(V.add_transaction_id(base))
    old = records.where("name = 'coffee'").select("date", F.col("name").alias("description"), "amount", "spent_from")
    old.write.parquet(target)
    assert K.append_new(records, target) == 1
    assert K.append_new(records, target) == 0
    assert K.read_target(spark, target).count() == 2


def test_append_compares_all_ids(spark, tmp_path):
    target = str(tmp_path / "t")
    schema = "date date, name string, category string, spent_from string, amount double, notes string, transaction_id string"
    jan = spark.createDataFrame([(datetime.date(2024, 1, 15), "a", "c", "s", 1.0, "", "x"), (None, "b", "c", "s", 1.0, "", "y")], schema)
    feb = spark.createDataFrame([(datetime.date(2024, 2, 15), "a", "c", "s", 1.0, "", "x"), (None, "b", "c", "s", 1.0, "", "y")], schema)
    assert K.append_new(jan, target) == 2
    assert K.append_new(feb, target) == 0


def test_files_of_an_append_follow_the_months(spark, tmp_path):
    rows = spark.range(4800).repartition(40).selectExpr(
        "date_add(date'2024-01-01', cast(id % 360 as int)) AS date", "'n' AS name", "'c' AS category", "'a' AS spent_from",
        "cast(id AS double) AS amount", "'' AS notes", "cast(id AS string) AS transaction_id")
    K.append_rows(rows, None, str(tmp_path / "t"))
    assert len(list(tmp_path.glob("t/month=*/*.parquet"))) <= 24  # 40 tasks of 12 months before
    assert spark.read.parquet(str(tmp_path / "t")).drop(K.PARTITION).exceptAll(rows).isEmpty()


def test_first_append_joins_with_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(D1, "A", "c", "a", 1.0, "", i) for i in ("x", "x", None)],
                                  "date date, name string, category string, spent_from string, amount double, notes string, transaction_id string")
    plan = K.unseen(batch, None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    target = str(tmp_path / "t")
    with pytest.raises(ValueError):
        K.append_new(batch.limit(0), target)
    assert not (tmp_path / "t").exists()
    assert K.append_new(batch, target) == 3 and K.append_new(batch, target) == 1  # rows without an id are always kept
    with pytest.raises(ValueError):
        K.append_new(batch.limit(0), target)
    with pytest.raises(ValueError):
        K.append_new(batch.where("name = 'B'"), target)
    assert spark.read.parquet(target).count() == 4
