"""Query catalog: one Spark plan per operator over the test tables, each with a DuckDB
oracle (``ORACLE``) computing the same rows from the same parquet files.

Every query reads whole tables; nothing is sampled or capped (``merchant_summary_topk`` is
a top-k report by definition).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions import text as X
from spendlake.functions import values as V
from spendlake.functions.similarity import score_pairs, token_set
from spendlake.operators import categorize as C
from spendlake.operators import dedupe as D
from spendlake.operators import rules as R
from spendlake.operators import summaries as S
from spendlake.plans import oracle as O
from spendlake.plans.views import (
    BUDGETS, MEMORY_P_SQL_SRC, RULES_E, RULES_P, TXN_E_SQL, TXN_L_SQL, memory_from_part, table,
    txn_e, txn_l,
)

from spendlake.session import number_rows, spread, spread_few_splits  # noqa: E402

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
ROWS_P = R.rule_rows(RULES_P)
ROWS_E = R.rule_rows(RULES_E)


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------- text

@query("normalize_merchant", (
    "SELECT src, key, merchant FROM ("
    + O.merchant_select(f"SELECT DISTINCT 'txn' AS src, description AS key, description AS raw FROM ({TXN_L_SQL}) _l "
                        "UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer "
                        "UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier", "raw")
    + ") _q"))
def normalize_merchant(spark: SparkSession, sf: str) -> DataFrame:
    """F1 over transaction descriptions, customer and supplier names."""
    t = txn_l(spark, sf).select(F.lit("txn").alias("src"), F.col("description").alias("key"),
                                F.col("description").alias("raw")).distinct()
    c = table(spark, sf, "customer").select(F.lit("customer"), F.col("c_custkey").cast("string"), "c_name")
    s = table(spark, sf, "supplier").select(F.lit("supplier"), F.col("s_suppkey").cast("string"), "s_name")
    return t.union(c).union(s).select("src", "key", X.merchant_name("raw").alias("merchant"))


@query("normalize_merchant_docs", (
    "SELECT doc_id, merchant FROM ("
    + O.merchant_select("SELECT doc_id, text FROM documents", "text") + ") _q"))
def normalize_merchant_docs(spark: SparkSession, sf: str) -> DataFrame:
    """F1 over whole document texts (accents, punctuation, newlines, long inputs)."""
    d = spread_few_splits(table(spark, sf, "documents"))
    return d.select("doc_id", X.merchant_name("text").alias("merchant"))


@query("normalize_description",
       f"SELECT doc_id, {O.f2('text')} AS description FROM documents")
def normalize_description(spark: SparkSession, sf: str) -> DataFrame:
    """F2 over whole document texts."""
    d = spread_few_splits(table(spark, sf, "documents"))
    return d.select("doc_id", X.description_key("text").alias("description"))


_EXTRACT_SRC = ("SELECT 'part' AS src, CAST(p_partkey AS VARCHAR) AS key, "
                "upper(p_name) || ' ' || CAST(p_size AS VARCHAR) || ' MAIN ST' AS raw FROM part "
                "UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), "
                "s_name || ' ' || CAST(s_nationkey AS VARCHAR) || ' ' || CAST(s_suppkey AS VARCHAR) FROM supplier")


@query("extract_merchant", (
    "SELECT src, key, merchant FROM ("
    + O.merchant_select(f"SELECT src, key, trim(string_split_regex(raw, '\\s+\\d+\\s+')[1]) AS head "
                        f"FROM ({_EXTRACT_SRC}) _e", "head") + ") _q"))
def extract_merchant(spark: SparkSession, sf: str) -> DataFrame:
    """F4 over composed "MERCHANT 123 STREET" texts from part and supplier."""
    p = table(spark, sf, "part").select(
        F.lit("part").alias("src"), F.col("p_partkey").cast("string").alias("key"),
        F.concat(F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" MAIN ST")).alias("raw"))
    s = table(spark, sf, "supplier").select(
        F.lit("supplier"), F.col("s_suppkey").cast("string"),
        F.concat_ws(" ", "s_name", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")))
    return p.union(s).select("src", "key", X.extract_merchant("raw").alias("merchant"))


# --------------------------------------------------------------------- values

_AMOUNT_TEXTS_SQL = (
    "SELECT o_orderkey, 1 AS variant, '$' || format('{:,.2f}', o_totalprice) AS txt FROM orders "
    "UNION ALL SELECT o_orderkey, 2, '(' || printf('%.2f', o_totalprice) || ')' FROM orders "
    "UNION ALL SELECT o_orderkey, 3, '-$' || printf('%.2f', o_totalprice) FROM orders "
    "UNION ALL SELECT o_orderkey, 4, printf('%.2f', o_totalprice) || 'd' FROM orders "
    "UNION ALL SELECT o_orderkey, 5, CASE WHEN o_orderstatus = 'F' THEN 'N/A' ELSE ' ' || printf('%.2f', o_totalprice) || ' ' END FROM orders")


@query("parse_amount", (
    "SELECT o_orderkey, variant, txt, coalesce(CASE WHEN regexp_matches(regexp_replace(txt, '[$,]', '', 'g'), "
    "'^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN TRY_CAST(trim(regexp_replace(txt, '[$,]', '', 'g')) AS DOUBLE) END, 0.0) AS amount "
    f"FROM ({_AMOUNT_TEXTS_SQL}) _a"))
def parse_amount(spark: SparkSession, sf: str) -> DataFrame:
    """F5 over bank-style amount texts composed from order totals."""
    o = table(spark, sf, "orders")
    p2 = F.format_string("%.2f", "o_totalprice")
    variants = [
        (1, F.concat(F.lit("$"), F.format_number("o_totalprice", 2))),
        (2, F.concat(F.lit("("), p2, F.lit(")"))),
        (3, F.concat(F.lit("-$"), p2)),
        (4, F.concat(p2, F.lit("d"))),
        (5, F.when(F.col("o_orderstatus") == "F", F.lit("N/A")).otherwise(F.concat(F.lit(" "), p2, F.lit(" ")))),
    ]
    parts = [o.select("o_orderkey", F.lit(v).alias("variant"), e.alias("txt")) for v, e in variants]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.select("o_orderkey", "variant", "txt", V.parse_amount("txt").alias("amount"))


_DATE_TEXTS = [  # variant, Spark format, DuckDB format
    (1, "yyyy-MM-dd", "%Y-%m-%d"), (2, "M/d/yyyy", "%-m/%-d/%Y"), (3, "dd-MMM-yy", "%d-%b-%y"),
    (4, "yyyy/MM/dd", "%Y/%m/%d"), (5, "MMM dd, yyyy", "%b %d, %Y"),
    (6, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "%Y-%m-%dT%H:%M:%S.%gZ"), (7, "M/d/yyyy HH:mm", "%-m/%-d/%Y %H:%M"),
    (8, "dd MMMM yyyy", "%d %B %Y"), (9, "yyyyMMdd", "%Y%m%d")]
_DATE_TEXTS_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey, {v} AS variant, strftime(CAST(o_orderdate AS TIMESTAMP), '{fmt}') AS txt FROM orders" for v, _, fmt in _DATE_TEXTS)


@query("parse_date", (
    "SELECT o_orderkey, variant, txt, CAST(coalesce(try_strptime(trim(txt), '%Y-%m-%d'), try_strptime(trim(txt), '%m/%d/%Y'), "
    "try_strptime(trim(txt), '%d-%b-%y'), try_strptime(trim(txt), '%Y/%m/%d'), try_strptime(trim(txt), '%b %d, %Y'), "
    "try_strptime(trim(txt), '%Y-%m-%dT%H:%M:%S.%gZ'), try_strptime(trim(txt), '%m/%d/%Y %H:%M'), "
    f"try_strptime(trim(txt), '%d %B %Y')) AS DATE) AS date FROM ({_DATE_TEXTS_SQL}) _d"))
def parse_date(spark: SparkSession, sf: str) -> DataFrame:
    """F6 over order dates rendered in the shapes of statements, and as bare digits (no date)."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    texts = F.array(*[F.struct(F.lit(v).alias("variant"), F.date_format("t", fmt).alias("txt")) for v, fmt, _ in _DATE_TEXTS])
    u = o.select("o_orderkey", F.explode(texts).alias("x")).select("o_orderkey", "x.variant", "x.txt")
    return u.select("o_orderkey", "variant", "txt", V.parse_date("txt").alias("date"))


@query("transaction_id", (
    "SELECT l_orderkey, l_linenumber, "
    + O.txn_id("date", "merchant", "amount", "account") + " AS transaction_id FROM ("
    + O.merchant_select(TXN_L_SQL, "description") + ") _q"))
def transaction_id(spark: SparkSession, sf: str) -> DataFrame:
    """F7/F8 over every lineitem transaction."""
    t = V.add_transaction_id(txn_l(spark, sf))
    return t.select("l_orderkey", "l_linenumber", "transaction_id")


# --------------------------------------------------------------------- categorization

def _keyword_labeled(spark, sf):
    t = txn_l(spark, sf)
    return t.withColumn("category", F.coalesce(C.keyword_case(X.description_key("description"), RULES_P),
                                               F.lit("Uncategorized")))


_KW_L_SQL = (f"SELECT *, coalesce({O.keyword_case(O.f2('description'), ROWS_P)}, 'Uncategorized') AS category "
             f"FROM ({TXN_L_SQL}) _k")


@query("keyword_category",
       f"SELECT l_orderkey, l_linenumber, description, category FROM ({_KW_L_SQL}) _q")
def keyword_category(spark: SparkSession, sf: str) -> DataFrame:
    """First matching keyword rule, in rule order, as one generated CASE per row."""
    return _keyword_labeled(spark, sf).select("l_orderkey", "l_linenumber", "description", "category")


@query("keyword_category_join",
       f"SELECT l_orderkey, l_linenumber, description, category FROM ({_KW_L_SQL}) _q")
def keyword_category_join(spark: SparkSession, sf: str) -> DataFrame:
    """C3 through the rules-table form: distinct description keys joined with the keyword index."""
    t = txn_l(spark, sf).withColumn("_dkey", X.description_key("description"))
    rules = R.rules_frame(spark, RULES_P)
    kw = C.keyword_first(t.select("_dkey").distinct(), rules)
    out = t.join(kw, "_dkey", "left")
    return out.select("l_orderkey", "l_linenumber", "description",
                      F.coalesce("keyword_category", F.lit("Uncategorized")).alias("category"))


_MANY_RULES = ("SELECT CAST(row_number() OVER (ORDER BY p_partkey, k, keyword) - 1 AS INTEGER) AS ord, category, keyword FROM ("
               "SELECT p_partkey, 1 AS k, p_brand AS category, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS keyword FROM part "
               "UNION ALL SELECT p_partkey, 2, p_type, split_part(p_name, ' ', 2) || ' ' || CAST(p_partkey % 1000 AS VARCHAR) FROM part "
               "UNION ALL SELECT p_partkey, 3, p_name, CAST(p_partkey AS VARCHAR) || ' ' || p_name FROM part "
               "UNION ALL SELECT p_partkey, 4, 'Size ' || CAST(p_size AS VARCHAR), substring(p_name, 3, 6) || CAST(p_size AS VARCHAR) FROM part "
               "UNION ALL SELECT p_partkey, 5, 'Tail ' || CAST(p_size AS VARCHAR), right(CAST(p_partkey AS VARCHAR), 2) FROM part) _r")


def _many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Five keywords per part (10,000 at sf0.01), some of them short, in part order."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    shapes = [("p_brand", F.concat_ws(" ", "p_name", key)),
              ("p_type", F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), (F.col("p_partkey") % 1000).cast("string"))),
              ("p_name", F.concat_ws(" ", key, "p_name")),
              (F.concat(F.lit("Size "), F.col("p_size").cast("string")), F.concat(F.substring("p_name", 3, 6), F.col("p_size").cast("string"))),
              (F.concat(F.lit("Tail "), F.col("p_size").cast("string")), F.right(key, F.lit(2)))]
    rows = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(c) if isinstance(c, str) else c).alias("category"), kw.alias("keyword"))
                     for k, (c, kw) in enumerate(shapes, 1)])
    return number_rows(p.select("p_partkey", F.inline(rows)), "ord", "p_partkey", "k", "keyword").select(
        F.col("ord").cast("int").alias("ord"), "category", "keyword")


@query("keyword_many_rules", (
    f"WITH d AS (SELECT DISTINCT {O.f2('description')} AS dkey FROM ({TXN_L_SQL}) _l), r AS ({_MANY_RULES}) "
    "SELECT dkey, (SELECT arg_min(category, ord) FROM r WHERE contains(dkey, keyword)) AS category FROM d"))
def keyword_many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """C3/J5/F10 with five rules per part, through the keyword index."""
    d = txn_l(spark, sf).select(X.description_key("description").alias("_dkey")).distinct()
    hits = C.keyword_first(d, _many_rules(spark, sf))
    return d.join(hits, "_dkey", "left").select(F.col("_dkey").alias("dkey"), F.col("keyword_category").alias("category"))


_CATSUM_SQL = (
    f"WITH per AS (SELECT category, sum(CAST(amount AS DECIMAL(18,2))) AS t, count(*) AS n_txn FROM ({_KW_L_SQL}) _k GROUP BY category) "
    "SELECT category, CAST(t AS DOUBLE) AS total, n_txn, round(CAST(t AS DOUBLE) / n_txn, 6) AS average, "
    "round(CASE WHEN g <> 0 THEN CAST(t AS DOUBLE) * 100 / CAST(g AS DOUBLE) END, 6) AS percent "
    "FROM per CROSS JOIN (SELECT sum(t) AS g FROM per) _g")


def _rules_p_label(d):
    return F.coalesce(C.keyword_case(X.description_key(d), RULES_P), F.lit("Uncategorized"))


@query("category_summary", _CATSUM_SQL)
def category_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: transactions -> keyword categories -> total/count/average/share.
    Money is aggregated per description first; each distinct description is labeled once."""
    return S.category_summary(S.labeled_partials(txn_l(spark, sf), _rules_p_label))


_MERCH_L_SQL = O.merchant_select(f"SELECT DISTINCT description FROM ({TXN_L_SQL}) _d", "description",
                                 keep="description")


def _fuzzy_sql(threshold: int, rows=ROWS_P) -> str:
    return (f"SELECT m.merchant, coalesce(f.fuzzy_category, 'Uncategorized') AS category, "
            f"round(coalesce(f.fuzzy_confidence, 0.0), 6) AS confidence "
            f"FROM (SELECT DISTINCT merchant FROM ({_MERCH_L_SQL}) _m) m "
            f"LEFT JOIN ({O.fuzzy_best(_MERCH_L_SQL, rows, threshold)}) f ON m.merchant = f.merchant")


@query("fuzzy_threshold_50", _fuzzy_sql(50))
def fuzzy_threshold_50(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold as a parameter, halfway."""
    return fuzzy_category(spark, sf, 50)


@query("fuzzy_threshold_0", _fuzzy_sql(0))
def fuzzy_threshold_0(spark: SparkSession, sf: str) -> DataFrame:
    """Any positive score is accepted."""
    return fuzzy_category(spark, sf, 0)


@query("fuzzy_threshold_100", _fuzzy_sql(100))
def fuzzy_threshold_100(spark: SparkSession, sf: str) -> DataFrame:
    """Only full scores are accepted."""
    return fuzzy_category(spark, sf, 100)


@query("fuzzy_category", _fuzzy_sql(80))
def fuzzy_category(spark: SparkSession, sf: str, threshold: int = 80) -> DataFrame:
    """Best keyword by token-set ratio for every distinct merchant."""
    d = spread(txn_l(spark, sf).select("description").distinct())  # see resolve()
    m = d.select(X.merchant_name("description").alias("_merchant")).distinct()
    best = C.fuzzy_best(m, R.rules_frame(spark, RULES_P), threshold, n_keywords=len(ROWS_P))
    out = m.join(best, "_merchant", "left")
    return out.select(F.col("_merchant").alias("merchant"),
                      F.coalesce("fuzzy_category", F.lit("Uncategorized")).alias("category"),
                      r6(F.coalesce("fuzzy_confidence", F.lit(0.0))).alias("confidence"))


_LONG_TEXTS = [(1, 7), (3, 11)]  # start and step of the walk over nations that makes a text


def _long_sql(k: int) -> str:
    a, b = _LONG_TEXTS[k]
    return (f"SELECT s_suppkey, string_agg(n_name || ' ' || CAST(s_suppkey % (i + {a}) AS VARCHAR), ' ' ORDER BY i) AS t FROM "
            f"(SELECT s_suppkey, s_nationkey, unnest(range(7 + s_suppkey % 25)) AS i FROM supplier) _s "
            f"JOIN nation ON n_nationkey = (s_nationkey * {a} + i * {b}) % 25 GROUP BY s_suppkey")


@query("fuzzy_long_keywords", (
    f"WITH p AS (SELECT a.s_suppkey, {O.tokens('a.t')} AS a, {O.tokens('b.t')} AS b FROM ({_long_sql(0)}) a JOIN ({_long_sql(1)}) b ON a.s_suppkey = b.s_suppkey) "
    f"SELECT s_suppkey, length(y) AS pattern, round({O.token_set_score('a', 'b')}, 6) AS score FROM ({O.token_set_prep('SELECT * FROM p', 'a', 'b', O.long_lcs)}) _l"))
def fuzzy_long_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """F9 between two long texts per supplier; patterns of up to 400 characters and more take several words."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name")
    pairs = None
    for name, (a, b) in zip("ab", _LONG_TEXTS):
        walk = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 25 + 6).cast("int"))).alias("i"))
        piece = F.concat_ws(" ", "n_name", (F.col("s_suppkey") % (F.col("i") + a)).cast("string"))
        text = (walk.withColumn("n", ((F.col("s_nationkey") * a + F.col("i") * b) % 25).cast("long")).join(nation, "n").groupBy("s_suppkey")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("p")))), lambda x: x["p"]), " ").alias(name)))
        pairs = text if pairs is None else pairs.join(text, "s_suppkey")
    pairs = pairs.select("s_suppkey", token_set("a").alias("a"), token_set("b").alias("b"))
    pattern = F.length(F.array_join(F.array_except("b", "a"), " "))
    return score_pairs(pairs.withColumn("pattern", pattern.cast("long")), "a", "b").select("s_suppkey", "pattern", r6(F.col("score")).alias("score"))


def _categorize_sql(base_sql: str, rows, threshold: int, memory_sql: str | None, cols: str) -> str:
    """SQL twin of categorize(): returns base columns + mem/fuzzy/keyword results."""
    keyed = O.merchant_select(base_sql, "description", out="merchant")
    keyed2 = O.merchant_select(f"SELECT * EXCLUDE (_cs) FROM ({keyed}) _k1", "merchant", out="mkey")
    keyed3 = f"SELECT * EXCLUDE (_cs), {O.f2('description')} AS dkey FROM ({keyed2}) _k2"
    mem = ("SELECT merchant AS mkey, max(category) AS memory_category FROM (" + memory_sql +
           ") _mm WHERE category IS NOT NULL AND category <> '' GROUP BY merchant") if memory_sql else \
        "SELECT NULL::VARCHAR AS mkey, NULL::VARCHAR AS memory_category WHERE false"
    fz = O.fuzzy_best(f"SELECT merchant FROM ({keyed3}) _f", rows, threshold)
    kw = f"(SELECT DISTINCT dkey, {O.keyword_case('dkey', rows)} AS keyword_category FROM ({keyed3}) _kk)"
    return (f"SELECT {cols}, k.description AS _desc, k.merchant AS _merchant, k.mkey AS _mkey, m.memory_category, f.fuzzy_category, "
            f"f.fuzzy_confidence, w.keyword_category FROM ({keyed3}) k "
            f"LEFT JOIN ({mem}) m ON k.mkey = m.mkey LEFT JOIN ({fz}) f ON k.merchant = f.merchant "
            f"LEFT JOIN {kw} w ON k.dkey = w.dkey")


def _label_sql(src: str, cols: str) -> str:
    return (f"SELECT {cols}, CASE WHEN coalesce(_desc, '') = '' THEN 'Uncategorized' "
            "WHEN memory_category IS NOT NULL THEN memory_category WHEN fuzzy_category IS NOT NULL THEN fuzzy_category "
            "WHEN keyword_category IS NOT NULL THEN keyword_category ELSE 'Uncategorized' END AS category, "
            "round(CASE WHEN coalesce(_desc, '') = '' THEN 0.0 WHEN memory_category IS NOT NULL THEN 0.95 "
            "WHEN fuzzy_category IS NOT NULL THEN fuzzy_confidence WHEN keyword_category IS NOT NULL THEN 0.5 "
            "ELSE 0.0 END, 6) AS confidence, CASE WHEN coalesce(_desc, '') = '' THEN 'default' "
            "WHEN memory_category IS NOT NULL THEN 'memory' WHEN fuzzy_category IS NOT NULL THEN 'fuzzy' "
            f"WHEN keyword_category IS NOT NULL THEN 'keyword' ELSE 'default' END AS matched_by FROM ({src}) _lb")


_MEM_P_SQL = ("SELECT merchant, max(c) AS category FROM ("
              + O.merchant_select(MEMORY_P_SQL_SRC, "p_name") + ") _mp GROUP BY merchant")


@query("categorize_full", _label_sql(
    _categorize_sql(TXN_L_SQL, ROWS_P, 80, _MEM_P_SQL, "k.l_orderkey, k.l_linenumber, k.description"),
    "l_orderkey, l_linenumber, description"))
def categorize_full(spark: SparkSession, sf: str) -> DataFrame:
    """C0-C4 + J1: memory (built from part) -> fuzzy -> keyword -> default."""
    out = C.categorize(txn_l(spark, sf), RULES_P, memory_from_part(spark, sf), 80)
    return out.select("l_orderkey", "l_linenumber", "description", "category",
                      r6(F.col("confidence")).alias("confidence"), "matched_by")


_LEARN_BASE = _categorize_sql(TXN_E_SQL, ROWS_E, 80, None, "k.event_id")
_LEARN_SQL = (
    f"WITH b AS ({_LEARN_BASE}), o AS (SELECT *, CASE WHEN coalesce(_desc, '') <> '' AND memory_category IS NULL "
    "THEN coalesce(fuzzy_category, keyword_category) END AS own FROM b), "
    "fh AS (SELECT _mkey, min(event_id) AS seq, arg_min(own, event_id) AS cat FROM o WHERE own IS NOT NULL AND _mkey <> '' GROUP BY _mkey) "
    "SELECT o.event_id, CASE WHEN coalesce(o._desc, '') = '' THEN 'Uncategorized' WHEN memory_category IS NOT NULL THEN memory_category "
    "WHEN fh.seq < o.event_id THEN fh.cat WHEN own IS NOT NULL THEN own ELSE 'Uncategorized' END AS category, "
    "round(CASE WHEN coalesce(o._desc, '') = '' THEN 0.0 WHEN memory_category IS NOT NULL THEN 0.95 WHEN fh.seq < o.event_id THEN 0.95 "
    "WHEN fuzzy_category IS NOT NULL THEN fuzzy_confidence WHEN keyword_category IS NOT NULL THEN 0.5 ELSE 0.0 END, 6) AS confidence, "
    "CASE WHEN coalesce(o._desc, '') = '' THEN 'default' WHEN memory_category IS NOT NULL THEN 'memory' WHEN fh.seq < o.event_id THEN 'memory' "
    "WHEN fuzzy_category IS NOT NULL THEN 'fuzzy' WHEN keyword_category IS NOT NULL THEN 'keyword' ELSE 'default' END AS matched_by "
    "FROM o LEFT JOIN fh ON o._mkey = fh._mkey")


@query("categorize_learn", _LEARN_SQL)
def categorize_learn(spark: SparkSession, sf: str) -> DataFrame:
    """Categorize with learning in event order (set-based first-hit form)."""
    out, _ = C.categorize_learn(txn_e(spark, sf), "event_id", RULES_E, None, 80)
    return out.select("event_id", "category", r6(F.col("confidence")).alias("confidence"), "matched_by")


# --------------------------------------------------------------------- duplicates

_E2_SQL = ("SELECT event_id AS row_seq, CAST(ts AS DATE) AS date, upper(event_type) AS description, "
           "round(value, 0) AS amount, CAST(user_id AS VARCHAR) AS account FROM events")


def _e2(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("row_seq"), F.to_date("ts").alias("date"),
                     F.upper("event_type").alias("description"), F.round("value", 0).alias("amount"),
                     F.col("user_id").cast("string").alias("account"))


@query("find_duplicates", (
    f"SELECT * FROM ({TXN_E_SQL}) t WHERE (date, description) IN (SELECT (date, description) FROM ({TXN_E_SQL}) _g "
    "WHERE date IS NOT NULL AND description IS NOT NULL GROUP BY date, description HAVING count(*) > 1)"))
def find_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """A1: rows of repeated (date, description) groups, amount ignored."""
    return D.find_duplicates(txn_e(spark, sf), sort=False)


@query("find_duplicates_order", (
    f"SELECT event_id, CAST(row_number() OVER (ORDER BY date, description, event_id) - 1 AS BIGINT) AS row_no FROM ({TXN_E_SQL}) t "
    f"WHERE (date, description) IN (SELECT (date, description) FROM ({TXN_E_SQL}) _g "
    "WHERE date IS NOT NULL AND description IS NOT NULL GROUP BY date, description HAVING count(*) > 1)"))
def find_duplicates_order(spark: SparkSession, sf: str) -> DataFrame:
    """O1: the duplicates in the order of day and description, numbered."""
    return number_rows(D.find_duplicates(txn_e(spark, sf), sort=False), "row_no", "date", "description", "event_id").select("event_id", "row_no")


@query("find_duplicates_tolerance", (
    f"WITH c AS (SELECT *, CAST(round(amount * 100) AS BIGINT) AS cents FROM ({TXN_E_SQL}) _t "
    "WHERE date IS NOT NULL AND description IS NOT NULL), "
    "w AS (SELECT *, lag(cents) OVER (PARTITION BY date, description ORDER BY cents, event_id) AS pc, "
    "lead(cents) OVER (PARTITION BY date, description ORDER BY cents, event_id) AS nc FROM c) "
    "SELECT event_id, date, description, amount, account FROM w WHERE cents - pc <= 2500 OR nc - cents <= 2500"))
def find_duplicates_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Same day and description, amounts within 25.00."""
    return D.find_near_duplicates(txn_e(spark, sf), 2500, sort=False)


@query("dedupe_first", f"SELECT * FROM ({_E2_SQL}) _e QUALIFY row_number() OVER (PARTITION BY date, description, amount ORDER BY row_seq) = 1")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    """N1 keep='first' on (date, description, amount)."""
    return D.remove_duplicates(_e2(spark, sf), "first", "row_seq")


@query("dedupe_last", f"SELECT * FROM ({_E2_SQL}) _e QUALIFY row_number() OVER (PARTITION BY date, description, amount ORDER BY row_seq DESC) = 1")
def dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    """N1 keep='last'."""
    return D.remove_duplicates(_e2(spark, sf), "last", "row_seq")


@query("dedupe_none", f"SELECT * FROM ({_E2_SQL}) _e QUALIFY count(*) OVER (PARTITION BY date, description, amount) = 1")
def dedupe_none(spark: SparkSession, sf: str) -> DataFrame:
    """N1 keep=False: drop every row of a repeated key."""
    return D.remove_duplicates(_e2(spark, sf), False, "row_seq")


@query("dedupe_by_id", (
    "SELECT event_id, transaction_id FROM (SELECT event_id, " + O.txn_id("date", "merchant", "amount", "account")
    + " AS transaction_id FROM (" + O.merchant_select(TXN_E_SQL, "description") + ") _m) _i "
    "QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY event_id) = 1"))
def dedupe_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """N1 keyed by transaction_id (the column exists -> it is the key)."""
    t = V.add_transaction_id(txn_e(spark, sf))
    return D.remove_duplicates(t, "first", "event_id").select("event_id", "transaction_id")


# --------------------------------------------------------------------- reports

def _money(x):
    return f"sum(CAST({x} AS DECIMAL(18,2)))"


@query("monthly_summary", (
    f"WITH per AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, category, {_money('amount')} AS t, "
    f"count(*) AS n_txn FROM ({_KW_L_SQL}) _k GROUP BY ALL) "
    "SELECT month, category, CAST(t AS DOUBLE) AS total, n_txn, CAST(lag(t) OVER (PARTITION BY category ORDER BY month) AS DOUBLE) AS prev_total, "
    "CAST(t - lag(t) OVER (PARTITION BY category ORDER BY month) AS DOUBLE) AS change FROM per"))
def monthly_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly totals per category with month-over-month change."""
    t = S.with_period(txn_l(spark, sf), "month", "month")
    return S.monthly_summary(S.labeled_partials(t, _rules_p_label, ["month"]))


_F4_L = O.merchant_select(
    f"SELECT amount, trim(string_split_regex(description, '\\s+\\d+\\s+')[1]) AS head FROM ({TXN_L_SQL}) _l",
    "head")


@query("merchant_summary_topk", (
    f"SELECT merchant, CAST({_money('amount')} AS DOUBLE) AS total, count(*) AS n_txn FROM ({_F4_L}) _f "
    "GROUP BY merchant ORDER BY total DESC, merchant LIMIT 10"))
def merchant_summary_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Top 10 merchants by total (ties by name)."""
    return S.merchant_summary(txn_l(spark, sf), top=10)


@query("account_summary", (
    f"SELECT account, CAST({_money('amount')} AS DOUBLE) AS total, count(*) AS n_txn FROM ({TXN_L_SQL}) _l GROUP BY account"))
def account_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Totals per account."""
    return S.account_summary(txn_l(spark, sf))


_BUDGET_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', {v})" for k, v in BUDGETS.items()) + ") AS _b(category, budget))"


@query("budget_vs_actual", (
    f"WITH a AS (SELECT category, {_money('amount')} AS t FROM ({_KW_L_SQL}) _k GROUP BY category), "
    f"b AS (SELECT category, CAST(budget AS DECIMAL(18,2)) AS b FROM {_BUDGET_SQL}) "
    "SELECT coalesce(a.category, b.category) AS category, CAST(coalesce(a.t, 0) AS DOUBLE) AS actual, "
    "CAST(b.b AS DOUBLE) AS budget, CAST(coalesce(a.t, 0) - b.b AS DOUBLE) AS variance, "
    "round(CASE WHEN b.b <> 0 THEN CAST(coalesce(a.t, 0) AS DOUBLE) / CAST(b.b AS DOUBLE) END, 6) AS ratio "
    "FROM a FULL OUTER JOIN b ON a.category = b.category"))
def budget_vs_actual(spark: SparkSession, sf: str) -> DataFrame:
    """Actual vs budget per category (full outer join)."""
    budgets = spark.createDataFrame(list(BUDGETS.items()), "category string, budget double")
    return S.budget_vs_actual(S.labeled_partials(txn_l(spark, sf), _rules_p_label), budgets)


@query("period_over_period", (
    f"WITH per AS (SELECT CAST(date_trunc('year', date) AS DATE) AS period, category, {_money('amount')} AS t "
    f"FROM ({_KW_L_SQL}) _k GROUP BY ALL), l AS (SELECT *, lag(t) OVER (PARTITION BY category ORDER BY period) AS p FROM per) "
    "SELECT period, category, CAST(t AS DOUBLE) AS total, CAST(p AS DOUBLE) AS prev_total, "
    "round(CASE WHEN p <> 0 THEN CAST(t - p AS DOUBLE) * 100 / CAST(p AS DOUBLE) END, 6) AS pct_change FROM l"))
def period_over_period(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly totals per category against the previous year."""
    t = S.with_period(txn_l(spark, sf), "year", "period")
    return S.period_over_period(S.labeled_partials(t, _rules_p_label, ["period"]), "year")
