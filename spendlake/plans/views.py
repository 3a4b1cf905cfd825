"""Transaction views over the test tables, and the rule sets the catalog uses.

TXN_L: lineitem joined to part -> date = ship day, description = part name + " #" +
supplier (a branch number), amount = extended price, account = return flag.
TXN_E: events -> date = event day, description = upper(type) + " STORE " + user,
amount = value, account = user; ``event_id`` is a unique row order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.text import merchant_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def txn_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag",
        "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.select("l_orderkey", "l_linenumber",
                    F.to_date("l_shipdate").alias("date"),
                    F.concat(F.col("p_name"), F.lit(" #"), F.col("l_suppkey").cast("string")).alias("description"),
                    F.col("l_extendedprice").alias("amount"),
                    F.col("l_returnflag").alias("account"))


TXN_L_SQL = ("SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_shipdate AS DATE) AS date, "
             "p.p_name || ' #' || CAST(l.l_suppkey AS VARCHAR) AS description, "
             "l.l_extendedprice AS amount, l.l_returnflag AS account "
             "FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey")


def txn_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.to_date("ts").alias("date"),
                     F.concat(F.upper("event_type"), F.lit(" STORE "), F.col("user_id").cast("string"))
                     .alias("description"),
                     F.col("value").alias("amount"),
                     F.col("user_id").cast("string").alias("account"))


TXN_E_SQL = ("SELECT event_id, CAST(ts AS DATE) AS date, "
             "upper(event_type) || ' STORE ' || CAST(user_id AS VARCHAR) AS description, "
             "value AS amount, CAST(user_id AS VARCHAR) AS account FROM events")

# Keyword rules over the part-name nouns and event types, with overlaps so
# that rule order matters (e.g. "plate" is listed twice; "hot plate" goes to Goods).
RULES_P = {
    "Jewelry": ["ring", "small ring"],
    "Tools": ["anvil", "bolt", "rod", "gear", "large anvil"],
    "Goods": ["widget", "gizmo", "plate", "small widget"],
    "Kitchen": ["hot plate", "plate", "cold gizmo"],
    "Colors": ["red", "blue"],
}
RULES_E = {
    "Engagement": ["click", "view"],
    "Revenue": ["purchase"],
    "Growth": ["signup"],
    "Ops": ["error", "1 error store", "2 error store"],
}
BUDGETS = {"Jewelry": 1_000_000.0, "Tools": 5_000_000.0, "Goods": 2_500_000.0,
           "Travel": 10_000.0}


def memory_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned merchants derived from part: a category from the brand for rods and bolts, none (empty) for the others."""
    hardware = F.col("p_name").endswith(" rod") | F.col("p_name").endswith(" bolt")
    category = F.when(hardware, F.concat(F.lit("Hardware "), "p_brand")).otherwise("")
    return table(spark, sf_dir, "part").groupBy(merchant_name("p_name").alias("merchant")).agg(F.max(category).alias("category"))


MEMORY_P_SQL_SRC = ("SELECT p_name, CASE WHEN p_name LIKE '% rod' OR p_name LIKE '% bolt' THEN 'Hardware ' || p_brand ELSE '' END AS c FROM part")
