"""Category rules (C8, C9): an ordered (ord, category, keyword) table.

Order is semantic: the keyword step takes the first matching rule in order, and the fuzzy
step breaks score ties by the earliest keyword.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.schema import RULES
from spendlake.session import number_rows

# The default category rules, in their semantic order.
DEFAULT_RULES: dict[str, list[str]] = {
    "Groceries": ["grocery", "market", "supermarket", "sobeys", "loblaws", "costco", "walmart"],
    "Rent": ["rent", "lease", "landlord"],
    "Utilities": ["hydro", "electricity", "water", "gas bill", "telus", "rogers", "bell",
                  "internet", "freedom mobile"],
    "Dining": ["restaurant", "cafe", "coffee", "starbucks", "tim hortons", "timhortons",
               "mcdonald", "burger", "ubereats", "uber eats", "doordash", "grubhub", "pizza"],
    "Transport": ["uber", "lyft", "taxi", "parking", "fuel", "gas station", "transit", "bus",
                  "train", "compass", "compass account", "compass card"],
    "Salary": ["payroll", "salary", "pay cheque", "direct deposit", "deposit"],
    "Transfer": ["transfer", "interac", "e-transfer", "eft"],
    "Entertainment": ["netflix", "spotify", "movie", "cinema", "theatre", "concert"],
    "Healthcare": ["pharmacy", "drug", "hospital", "clinic", "doctor", "dentist"],
    "Subscription": ["subscription", "membership", "monthly fee"],
    "Insurance": ["insurance"],
    "ATM/Cash": ["atm", "cash"],
    "Interest/Fees": ["interest", "fee", "service charge"],
    "Fitness": ["gym", "fitness", "evolve strength post", "evolve strength", "evolve"],
    "Avoidable Expenses": ["vapezilla smoke shop", "the blarney stone", "the portside pub",
                           "viti wine and lager"],
}

# Rule tables up to this many keywords are inlined into expressions / broadcast with their masks.
MAX_INLINE_KEYWORDS = 1000


def rule_rows(rules: Mapping[str, Sequence[str]]) -> list[tuple[int, str, str]]:
    """(ord, category, keyword) in iteration order; an empty mapping means the defaults."""
    rules = rules or DEFAULT_RULES
    out, n = [], 0
    for cat, kws in rules.items():
        for kw in kws:
            out.append((n, cat, kw))
            n += 1
    return out


def rules_frame(spark: SparkSession, rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The rule table as a DataFrame (a few hundred rows at most), built as a JVM-local
    relation (no Python RDD job when it is scanned)."""
    rows = rule_rows(rules or DEFAULT_RULES)
    if not rows:
        return spark.createDataFrame([], RULES)
    structs = ", ".join(f"named_struct('ord', CAST({o} AS INT), 'category', {sql_string(c)}, "
                        f"'keyword', {sql_string(k)})" for o, c, k in rows)
    # one SQL expression parsed in the JVM instead of hundreds of Column calls
    return spark.range(1).select(F.expr(f"inline(array({structs}))"))


def sql_string(s: str) -> str:
    """A Spark SQL string literal for ``s`` (backslash and quote escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyword_table(rules: DataFrame) -> DataFrame:
    """Keyword -> category as a dict would hold it: position of the first occurrence,
    category of the last one (used by the fuzzy step)."""
    return (rules.groupBy("keyword")
            .agg(F.min("ord").alias("ord"), F.max_by("category", "ord").alias("category")))


def replace_rules(spark: SparkSession, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """A new rule table (rules are immutable values, never mutated in place)."""
    return rules_frame(spark, rules)


def extend_rules(rules: DataFrame, category: str, keywords: Iterable[str]) -> DataFrame:
    """Add keywords to ``category`` (a new category goes last); keywords already listed
    for that category are skipped; ``ord`` is renumbered densely (``number_rows``, so that rule
    tables may be of any size)."""
    kws = list(dict.fromkeys(keywords))
    if not kws:
        return rules
    add = rules.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(category).alias("category"), F.lit(k).alias("keyword"), F.lit(1).alias("_added"), F.lit(i).alias("_pos"))
        for i, k in enumerate(kws)]))).join(rules.select("category", "keyword"), ["category", "keyword"], "left_anti")
    first = rules.groupBy("category").agg(F.min("ord").alias("_first"))
    both = rules.select("category", "keyword", F.lit(0).alias("_added"), F.col("ord").alias("_pos")).unionByName(add)
    both = both.join(first, "category", "left").withColumn("_first", F.coalesce("_first", F.lit((1 << 31) - 1)))
    return number_rows(both, "ord", "_first", "_added", "_pos").select(F.col("ord").cast("int").alias("ord"), "category", "keyword")
