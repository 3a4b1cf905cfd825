"""F1-F8: exact strings from the reference's unit tests and worked fixtures."""
import datetime
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from spendlake.functions import text as X
from spendlake.functions import values as V


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


@pytest.mark.parametrize("raw,expected", [
    ("TIM HORTONS #4432", "Tim Hortons"),
    ("WALMART  SUPERCENTRE", "Walmart Supercentre"),
    ("starbucks coffee", "Starbucks Coffee"),
    ("", ""),
    (None, ""),
    ("mcdonald's #12", "Mcdonald'S"),
    ("7-eleven 4b", "7-Eleven 4B"),
    ("TIM #12 HORTONS", "Timhortons"),
    ("##1 2", "#2"),
    ("CAFÉ du élan", "Café Du Élan"),
])
def test_merchant_name(spark, raw, expected):
    assert one(spark, X.merchant_name("s"), raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("STARBUCKS COFFEE #123", "starbucks coffee 123"),
    ("RESTAURANT  &  BAR", "restaurant bar"),
    ("Café", "caf"),
    (None, ""),
])
def test_description_key(spark, raw, expected):
    assert one(spark, X.description_key("s"), raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("Transaction Date", "transaction_date"), ("CAD$", "cad"), ("Amount  In  Dollars", "amount_in_dollars"),
])
def test_column_name(spark, raw, expected):
    assert one(spark, X.column_name("s"), raw) == expected
    assert X.normalize_column_name(raw) == expected


def test_extract_merchant(spark):
    assert one(spark, X.extract_merchant("s"), "TIM HORTONS 456 MAIN ST") == "Tim Hortons"
    assert one(spark, X.extract_merchant("s"), None) == ""


@pytest.mark.parametrize("raw,expected", [
    ("5.50", 5.5), ("$1,234.56", 1234.56), ("(5.00)", 0.0), ("-$5", -5.0), ("5d", 0.0), ("inf", 0.0),
    ("nan", 0.0), ("", 0.0), (None, 0.0), (" 7 ", 7.0), ("1e3", 1000.0), (".5", 0.5),
])
def test_parse_amount(spark, raw, expected):
    assert one(spark, V.parse_amount("s"), raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("2024-01-15", datetime.date(2024, 1, 15)), ("1/5/2024", datetime.date(2024, 1, 5)),
    ("15-Jan-24", datetime.date(2024, 1, 15)), ("15-jan-98", datetime.date(1998, 1, 15)),
    ("2024/01/15", datetime.date(2024, 1, 15)), ("Jan 5, 2024", datetime.date(2024, 1, 5)),
    ("16 January 2024", datetime.date(2024, 1, 16)), ("16-sep-2024", datetime.date(2024, 9, 16)),
    ("2024-01-15T23:59:59.123+02:00", datetime.date(2024, 1, 15)), ("1/5/2024 3:04 PM", datetime.date(2024, 1, 5)),
    ("13/1/2024", datetime.date(2024, 1, 13)), ("2/30/2024", None), ("20240115", None), ("Foo 5, 2024", None),
    ("2024-01-15 25:00", None), ("junk", None), (None, None),
])
def test_parse_date(spark, raw, expected):
    assert one(spark, V.parse_date("s"), raw) == expected


def test_transaction_hash_golden(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 15), "STARBUCKS COFFEE", 5.5, "chequing")],
                               "date date, description string, amount double, account string")
    out = V.add_transaction_id(df).first()
    assert out.transaction_id == "0df7ec5da3c4aec4756f88aedd11610276bebd9e"


def test_hash_stable_and_distinct(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 15), "A", 1.0, "x"), (datetime.date(2024, 1, 15), "A", 1.0, "x"),
                                (datetime.date(2024, 1, 15), "A", 1.01, "x")],
                               "date date, description string, amount double, account string")
    ids = [r.transaction_id for r in V.add_transaction_id(df).collect()]
    assert ids[0] == ids[1] != ids[2]


def test_hash_string_date_and_algorithms(spark):
    df = spark.createDataFrame([("2024-01-15", "STARBUCKS COFFEE", 5.5)], "date string, description string, amount double")
    import hashlib
    key = "2024-01-15-Starbucks Coffee-5.50-"
    assert V.add_transaction_id(df).first().transaction_id == hashlib.sha1(key.encode()).hexdigest()
    assert V.add_transaction_id(df, "md5").first().transaction_id == hashlib.md5(key.encode()).hexdigest()
    assert V.add_transaction_id(df, "sha256").first().transaction_id == hashlib.sha256(key.encode()).hexdigest()


def test_missing_columns_raise(spark):
    df = spark.createDataFrame([("x",)], "description string")
    with pytest.raises(ValueError):
        V.add_transaction_id(df)


def test_exact_rounding(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (1.005,), (5.5,)], "a double")
    got = [r.r for r in df.select(V.exact_money_text("a").alias("r")).collect()]
    assert got == [f"{round(x, 2):.2f}" for x in (2.675, 0.125, 1.005, 5.5)]


def test_exact_rounding_of_many_doubles(spark):
    """Ties and near ties of every size, against Python."""
    r = random.Random(3)
    xs = [0.0, -0.0, 0.005, 0.015, 0.025, -0.005, -0.001, 1e-9, 5e-324, 2.0 ** 53, 2.0 ** 53 - 1, 9007199254740993.0, 1e18, 2.0 ** 62, 2.0 ** 63, 1e22, 1e30,
          2.0 ** 115, -1e25, float("inf"), float("-inf"), float("nan"), 0.994999999999999, 0.995, 0.9949999999999999999, 99.995, 1.0 - 2.0 ** -53]
    for _ in range(20000):
        x = r.choice((r.random(), r.randrange(10 ** 7) / 1000, r.randrange(10 ** 9) / 8, r.uniform(-1e6, 1e6), r.randrange(1000) + r.randrange(200) / 200, r.uniform(0, 2.0 ** r.randrange(60))))
        xs += [x, math.nextafter(x, math.inf), -math.nextafter(x, 0)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, a double")
    got = {r.i: r.r for r in df.select("i", V.exact_money_text("a").alias("r")).collect()}
    assert got == {i: f"{round(x, 2):.2f}" for i, x in enumerate(xs)}
    plan = V.add_transaction_id(df.selectExpr("current_date() date", "'x' description", "a amount"), exact_rounding=True)._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_account_is_stripped_like_python(spark):
    accounts = [" a ", "\ta\n", "\xa0a\u2003", "\x1ca", "a b", "", "\n"]
    df = spark.createDataFrame([(a,) for a in accounts], "account string").selectExpr("date'2024-01-15' date", "'x' description", "1.0D amount", "account")
    got = [r.transaction_id for r in V.add_transaction_id(df).collect()]
    assert got == [hashlib.sha1(f"2024-01-15-X-1.00-{a.strip()}".encode()).hexdigest() for a in accounts]
