"""I/O side of the catalog: statement text, scans, sinks, ledger, memory and rules.

Queries that need files write data derived from the test tables into the shared scratch
folder (``spark.checkpoint.dir``) and read it back, so their work grows with the tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions import text as X
from spendlake.functions import values as V
from spendlake.operators import categorize as C
from spendlake.operators import memory as M
from spendlake.operators import rules as R
from spendlake.plans import oracle as O
from spendlake.plans.catalog import _KW_L_SQL, _LEARN_SQL, _categorize_sql, _keyword_labeled, _label_sql, query
from spendlake.plans.views import RULES_E as RULES_E_MAP
from spendlake.plans.views import MEMORY_P_SQL_SRC, TXN_E_SQL, TXN_L_SQL, memory_from_part, table, txn_e, txn_l
from spendlake.session import number_rows, scratch_path
from spendlake.sources import ingest as I
from spendlake.sources import ledger as L
from spendlake.sources import lines as LN
from spendlake.sources import records as CR
from spendlake.sources import sink as K

DATE_RE = LN.DATE_RE
AMOUNT_RE = LN.AMOUNT_RE

# --------------------------------------------------------------------- statement text

_LINES_SQL = (
    "SELECT o_orderkey, 1 AS variant, strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority || ' ' || printf('%.2f', o_totalprice) AS value FROM orders "
    "UNION ALL SELECT o_orderkey, 2, strftime(o_orderdate, '%m/%d/%Y') || ' | ' || o_orderstatus || ' | -$' || format('{:,.2f}', o_totalprice) FROM orders "
    "UNION ALL SELECT o_orderkey, 3, '  ' || strftime(o_orderdate, '%d-%b-%y') || ' REF ' || CAST(o_custkey AS VARCHAR) || ', ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '  ' FROM orders "
    "UNION ALL SELECT o_orderkey, 4, 'Statement for ' || CAST(o_custkey AS VARCHAR) || ' ' || o_orderpriority FROM orders "
    "UNION ALL SELECT o_orderkey, 5, '   ' FROM orders "
    "UNION ALL SELECT o_orderkey, 6, 'Statement date ' || strftime(o_orderdate, '%Y-%m-%d') FROM orders")


def _lines(spark, sf):
    o = table(spark, sf, "orders")
    shapes = [
        (1, F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority",
                        F.format_string("%.2f", "o_totalprice"))),
        (2, F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" | "), "o_orderstatus",
                     F.lit(" | -$"), F.format_number("o_totalprice", 2))),
        (3, F.concat(F.lit("  "), F.date_format("o_orderdate", "dd-MMM-yy"), F.lit(" REF "),
                     F.col("o_custkey").cast("string"), F.lit(", "), F.floor("o_totalprice").cast("long").cast("string"),
                     F.lit("  "))),
        (4, F.concat(F.lit("Statement for "), F.col("o_custkey").cast("string"), F.lit(" "), "o_orderpriority")),
        (5, F.lit("   ")),
        (6, F.concat(F.lit("Statement date "), F.date_format("o_orderdate", "yyyy-MM-dd"))),
    ]
    out = None
    for v, e in shapes:
        part = o.select("o_orderkey", F.lit(v).alias("variant"), e.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("statement_lines", (
    "WITH l AS (SELECT o_orderkey, variant, trim(value) AS line FROM (" + _LINES_SQL + ") _l), "
    f"m AS (SELECT *, regexp_extract(line, '{DATE_RE}', 0) AS date_text, regexp_extract(line, '{AMOUNT_RE}', 0) AS aall, "
    f"regexp_extract(line, '{AMOUNT_RE}', 1) AS amount_text FROM l WHERE line <> '') "
    "SELECT o_orderkey, variant, date_text, trim(CASE WHEN length(line) - length(aall) + 1 > instr(line, date_text) + length(date_text) "
    "THEN substring(line, instr(line, date_text) + length(date_text), length(line) - length(aall) + 1 - instr(line, date_text) - length(date_text)) "
    "ELSE '' END, ' -|,') AS description, amount_text, TRY_CAST(replace(amount_text, ',', '') AS DOUBLE) AS amount "
    "FROM m WHERE date_text <> '' AND aall <> ''"))
def statement_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Statement rows from text lines (the PDF text branch)."""
    return LN.parse_lines(_lines(spark, sf), "value", keep_sign=False).drop("value")


def _cells(spark, sf):
    o = table(spark, sf, "orders")
    date_txt = F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd-MMM-yy")) \
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cells = F.array(date_txt, F.col("o_orderpriority"),
                    F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" cust "), F.col("o_custkey").cast("string"))),
                    F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" ")))
    return o.select("o_orderkey", cells.alias("cells"))


_CELLS_SQL = (
    "SELECT o_orderkey, [CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%d-%b-%y') ELSE strftime(o_orderdate, '%Y-%m-%d') END, "
    "o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN ' cust ' || CAST(o_custkey AS VARCHAR) END, "
    "' ' || format('{:,.2f}', o_totalprice) || ' '] AS cells FROM orders")


@query("statement_cells", (
    "WITH c AS (SELECT o_orderkey, list_transform(cells, lambda x: coalesce(trim(x), '')) AS cs FROM (" + _CELLS_SQL + ") _c), "
    "j AS (SELECT *, array_to_string(cs, ' | ') AS joined FROM c), "
    f"m AS (SELECT *, regexp_extract(joined, '{DATE_RE}', 0) AS date_text, regexp_extract(joined, '{AMOUNT_RE}', 1) AS amount_text, "
    f"regexp_extract(joined, '{AMOUNT_RE}', 0) AS aall FROM j) "
    "SELECT o_orderkey, date_text, trim(array_to_string(list_filter(cs, lambda x: x <> '' AND x <> date_text AND x <> amount_text), ' ')) AS description, "
    "amount_text, TRY_CAST(replace(amount_text, ',', '') AS DOUBLE) AS amount FROM m WHERE date_text <> '' AND aall <> ''"))
def statement_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Statement rows from table cells (the PDF table branch)."""
    return LN.parse_cells(_cells(spark, sf), "cells", keep_sign=False).drop("cells")


# --------------------------------------------------------------------- tables and headers

def _bank_table(spark, sf):
    o = table(spark, sf, "orders")
    amt = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), F.format_number("o_totalprice", 2))) \
        .otherwise(F.format_string("%.2f", "o_totalprice"))
    return o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
                    F.concat(F.col("o_orderpriority"), F.lit(" #"), F.col("o_custkey").cast("string")).alias("Merchant Name"),
                    amt.alias("Amount CAD"), F.col("o_orderstatus").alias("Notes"))


_BANK_SQL = ("SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority || ' #' || CAST(o_custkey AS VARCHAR) AS m, "
             "CASE WHEN o_orderstatus = 'F' THEN '$' || format('{:,.2f}', o_totalprice) ELSE printf('%.2f', o_totalprice) END AS a FROM orders")
_NUMERIC = "'^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$'"
_BANK_TXN = (f"SELECT CAST(try_strptime(d, '%Y-%m-%d') AS DATE) AS date, {O.f2('m')} AS description, "
             f"coalesce(CASE WHEN regexp_matches(a, {_NUMERIC}) THEN TRY_CAST(trim(a) AS DOUBLE) END, 0.0) AS amount, "
             f"'chequing' AS account FROM ({_BANK_SQL}) _b")


@query("normalize_table", (
    "SELECT date, description, amount, account, " + O.txn_id("date", "merchant", "amount", "account")
    + " AS transaction_id FROM (" + O.merchant_select(_BANK_TXN, "description") + ") _q"))
def normalize_table(spark: SparkSession, sf: str) -> DataFrame:
    """A bank-like table (spreadsheet branch: no currency stripping) -> Txn."""
    return I.normalize_table(_bank_table(spark, sf), "chequing", strip_currency=False)


def _headers(spark, sf):
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    a = F.array(F.concat(F.lit("Posted Date ("), F.col("n_name"), F.lit(")")),
                F.concat(F.col("r_name"), F.lit("  Payee")),
                F.concat(F.lit("Total "), F.col("n_name"), F.lit(" CAD$")), F.lit("Reference-No."))
    b = F.array(F.lit("Transaction Type"), F.concat(F.col("n_name"), F.lit(" Merchant")),
                F.lit("USD$ Amount"), F.concat(F.lit("Date of "), F.col("r_name")))
    return j.select("n_nationkey", F.when(F.col("r_name").isin("AFRICA", "ASIA"), a).otherwise(b).alias("raw"))


_HEADERS_SQL = (
    "SELECT n_nationkey, CASE WHEN r_name IN ('AFRICA', 'ASIA') THEN ['Posted Date (' || n_name || ')', r_name || '  Payee', "
    "'Total ' || n_name || ' CAD$', 'Reference-No.'] ELSE ['Transaction Type', n_name || ' Merchant', 'USD$ Amount', "
    "'Date of ' || r_name] END AS raw FROM nation JOIN region ON n_regionkey = r_regionkey")


def _f3_sql(x):
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[\\s\\-]+', '_', 'g'), "
            f"'[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')")


def _pos_sql(names, pats):
    rx = "|".join(pats)
    return f"CAST(coalesce(list_position(list_transform({names}, lambda n: regexp_matches(n, '{rx}')), true), 0) AS INTEGER)"


@query("normalize_headers", (
    "WITH h AS (SELECT n_nationkey, list_transform(raw, lambda x: " + _f3_sql("x") + ") AS names FROM (" + _HEADERS_SQL + ") _h) "
    "SELECT n_nationkey, array_to_string(names, '|') AS names, " + _pos_sql("names", I.DATE_PATTERNS) + " AS date_idx, "
    + _pos_sql("names", I.DESCRIPTION_PATTERNS) + " AS desc_idx, " + _pos_sql("names", I.AMOUNT_PATTERNS)
    + " AS amount_idx FROM h"))
def normalize_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Header names normalized and column roles picked (reference rules)."""
    h = _headers(spark, sf).select("n_nationkey", F.transform("raw", X.column_name).alias("names"))
    roles = I.header_roles(F.col("names"), compat=True)
    return h.select("n_nationkey", F.array_join("names", "|").alias("names"), roles.date_idx.cast("int").alias("date_idx"),
                    roles.desc_idx.cast("int").alias("desc_idx"), roles.amount_idx.cast("int").alias("amount_idx"))


# --------------------------------------------------------------------- records and export

_IDS_L = ("SELECT *, " + O.txn_id("date", "merchant", "amount", "account") + " AS transaction_id FROM ("
          + O.merchant_select(_KW_L_SQL, "description") + ") _q")


@query("to_transactions", (
    "SELECT date, description AS name, category, account AS spent_from, amount, '' AS notes, transaction_id "
    f"FROM ({_IDS_L}) _i"))
def to_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Labeled transactions -> target records."""
    return K.to_transactions(V.add_transaction_id(_keyword_labeled(spark, sf)))


@query("export_projection", (
    "SELECT date AS \"Date\", description AS \"Description\", amount AS \"Amount\", category AS \"Category\", "
    "account AS \"Account\", '' AS \"Notes\", transaction_id AS \"Transaction ID\" "
    f"FROM ({_IDS_L}) _i"))
def export_projection(spark: SparkSession, sf: str) -> DataFrame:
    """P5/S14 columns: records renamed to the CSV export headings."""
    return K.export_projection(K.to_transactions(V.add_transaction_id(_keyword_labeled(spark, sf))))


# --------------------------------------------------------------------- memory and rules

_UPSERT_PAIRS = O.merchant_select("SELECT p_name || CASE WHEN p_name LIKE '%t' THEN ' extra' ELSE '' END AS p_name, p_type, p_partkey FROM part", "p_name")
_MEMP = ("SELECT merchant, max(c) AS category FROM ("
         + O.merchant_select(MEMORY_P_SQL_SRC, "p_name") + ") _mp GROUP BY merchant")
_UPSERT_SQL = (f"WITH n AS (SELECT merchant, arg_max(p_type, p_partkey) AS category FROM ({_UPSERT_PAIRS}) _u "
               f"WHERE merchant <> '' GROUP BY merchant) "
               f"SELECT merchant, category FROM ({_MEMP}) _o WHERE merchant NOT IN (SELECT merchant FROM n) "
               "UNION ALL SELECT merchant, category FROM n")


def _upserted(spark, sf):
    part = table(spark, sf, "part")
    name = F.when(F.col("p_name").endswith("t"), F.concat("p_name", F.lit(" extra"))).otherwise(F.col("p_name"))  # new keys beside the old
    pairs = part.select(name.alias("merchant"), F.col("p_type").alias("category"), "p_partkey")
    return M.learn_batch(memory_from_part(spark, sf), pairs, version="p_partkey")


@query("memory_upsert", _UPSERT_SQL)
def memory_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Learn a batch of (part name -> type) pairs into a memory; the latest pair
    (highest part key) wins per merchant; existing entries not in the batch stay."""
    return _upserted(spark, sf)


@query("memory_lookup", (
    "SELECT description FROM (" + O.merchant_select(f"SELECT DISTINCT description FROM ({TXN_L_SQL}) _l", "description")
    + f") _q WHERE merchant IN (SELECT merchant FROM ({_MEMP}) _m)"))
def memory_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Which transaction descriptions are known merchants (semi join)."""
    d = txn_l(spark, sf).select("description").distinct()
    return M.has_merchant(memory_from_part(spark, sf), d, "description")


@query("memory_roundtrip", _UPSERT_SQL)
def memory_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Save the memory as JSON (one record per line, written in parallel) and load it
    back; the reference's single-object file is ``fmt="json_object"`` (tested)."""
    path = scratch_path(spark, "memory-json")
    M.save(_upserted(spark, sf), path, fmt="json")
    return M.load(spark, path, fmt="json")


def _rules_from_part(spark, sf):
    part = table(spark, sf, "part")
    pairs = part.select(F.col("p_type").alias("category"), F.col("p_name").alias("keyword")).distinct()
    return number_rows(pairs, "ord", "category", "keyword").select(F.col("ord").cast("int").alias("ord"), "category", "keyword")


_RULES_PART_SQL = ("SELECT CAST(row_number() OVER (ORDER BY category, keyword) - 1 AS INTEGER) AS ord, category, keyword "
                   "FROM (SELECT DISTINCT p_type AS category, p_name AS keyword FROM part) _d")
_EXT = [("SMALL", ["small ring", "tiny ring", "small ring"]), ("Custom", ["gizmo", "doohickey"])]


def _ext_sql(base: str, cat: str, kws: list[str]) -> str:
    kws = list(dict.fromkeys(kws))
    vals = ", ".join(f"({i}, '{k}')" for i, k in enumerate(kws))
    return (f"WITH b AS ({base}), cp AS (SELECT category, min(ord) AS co FROM b GROUP BY category), "
            f"mx AS (SELECT coalesce(max(ord), -1) AS mx FROM b), "
            f"a AS (SELECT v.pos, '{cat}' AS category, v.keyword FROM (VALUES {vals}) v(pos, keyword) "
            f"WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.category = '{cat}' AND b.keyword = v.keyword)), "
            "u AS (SELECT cp.co AS co, 0 AS grp, b.ord AS pos, b.category, b.keyword FROM b JOIN cp ON b.category = cp.category "
            "UNION ALL SELECT coalesce((SELECT co FROM cp WHERE cp.category = a.category), (SELECT mx FROM mx) + 1), 1, a.pos, a.category, a.keyword FROM a) "
            "SELECT CAST(row_number() OVER (ORDER BY co, grp, pos) - 1 AS INTEGER) AS ord, category, keyword FROM u")


_RULES_EXT_SQL = _RULES_PART_SQL
for _c, _k in _EXT:
    _RULES_EXT_SQL = _ext_sql(_RULES_EXT_SQL, _c, _k)


@query("rules_extend", _RULES_EXT_SQL)
def rules_extend(spark: SparkSession, sf: str) -> DataFrame:
    """Rules derived from part (type -> names), then keywords added to an existing
    category and a new category appended."""
    rules = _rules_from_part(spark, sf)
    for cat, kws in _EXT:
        rules = R.extend_rules(rules, cat, kws)
    return rules


@query("rules_replace", (
    "SELECT l_orderkey, l_linenumber, CASE WHEN contains(d, 'ring') THEN 'Round' WHEN contains(d, 'l') THEN 'Has L' ELSE 'Uncategorized' END AS category "
    f"FROM (SELECT l_orderkey, l_linenumber, {O.f2('description')} AS d FROM ({TXN_L_SQL}) _l) _r"))
def rules_replace(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog's rules replaced by others; the old ones no longer apply."""
    rules = R.replace_rules(spark, {"Round": ["ring"], "Has L": ["l"]})
    t = txn_l(spark, sf).withColumn("_dkey", X.description_key("description"))
    hit = C.keyword_first(t.select("_dkey").distinct(), rules)
    return t.join(hit, "_dkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("keyword_category", F.lit("Uncategorized")).alias("category"))


# --------------------------------------------------------------------- ids, append

@query("existing_ids", f"SELECT DISTINCT transaction_id FROM ({_IDS_L}) _i")
def existing_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ids of a target that has an id column."""
    records = K.to_transactions(V.add_transaction_id(_keyword_labeled(spark, sf)))
    return K.existing_ids(K.workbook_projection(records))


@query("existing_ids_recomputed", f"SELECT DISTINCT transaction_id FROM ({_IDS_L}) _i")
def existing_ids_recomputed(spark: SparkSession, sf: str) -> DataFrame:
    """A target without an id column: ids recomputed from date/name/amount/account."""
    records = K.to_transactions(V.add_transaction_id(_keyword_labeled(spark, sf)))
    target = records.drop("transaction_id").toDF("Date", "Transaction Name", "Category", "Spent From", "Amount", "Notes")
    return K.existing_ids(target)


_IDS_E = ("SELECT event_id, date, merchant, amount, account, " + O.txn_id("date", "merchant", "amount", "account")
          + " AS transaction_id FROM (" + O.merchant_select(TXN_E_SQL, "description") + ") _q")
_CUTOFF = "2024-01-10"


def _ids_e(spark, sf):
    return V.add_transaction_id(txn_e(spark, sf))


@query("append_new", (
    f"WITH b AS ({_IDS_E}) SELECT event_id, transaction_id FROM b WHERE transaction_id NOT IN "
    f"(SELECT transaction_id FROM b WHERE date <= DATE '{_CUTOFF}')"))
def append_new(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the batch whose id is not in the target yet (the target holds
    the events up to the cutoff day)."""
    b = _ids_e(spark, sf)
    target = b.where(F.col("date") <= F.lit(_CUTOFF).cast("date"))
    return K.new_rows(b, K.existing_ids(target)).select("event_id", "transaction_id")


@query("append_multi_file", (
    f"WITH b AS ({_IDS_E}), n AS (SELECT * FROM b WHERE transaction_id NOT IN "
    f"(SELECT transaction_id FROM b WHERE date <= DATE '{_CUTOFF}')) "
    "SELECT event_id, transaction_id FROM n QUALIFY date = min(date) OVER (PARTITION BY transaction_id)"))
def append_multi_file(spark: SparkSession, sf: str) -> DataFrame:
    """The batch is one file per day loaded in day order: an id already seen in an
    earlier file is dropped, repeats inside one file are kept."""
    b = _ids_e(spark, sf)
    target = b.where(F.col("date") <= F.lit(_CUTOFF).cast("date"))
    return K.new_rows(b, K.existing_ids(target), file_order="date").select("event_id", "transaction_id")


@query("run_counters", (
    f"WITH b AS ({_IDS_E}), s AS (SELECT CASE WHEN transaction_id IN (SELECT transaction_id FROM b WHERE date <= DATE '{_CUTOFF}') "
    "THEN 'already_loaded' WHEN row_number() OVER (PARTITION BY transaction_id ORDER BY event_id) > 1 THEN 'duplicate' "
    "ELSE 'new' END AS status FROM b) SELECT status, count(*) AS n_rows FROM s GROUP BY status"))
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per outcome of a load: already loaded, duplicate within the batch, new."""
    from spendlake.operators import summaries as S
    b = _ids_e(spark, sf)
    target = K.existing_ids(b.where(F.col("date") <= F.lit(_CUTOFF).cast("date")))
    s = S.load_statuses(b, target, "event_id")
    return S.run_counters(s)


# --------------------------------------------------------------------- ledger

def _ledger_entries(spark, sf):
    o = table(spark, sf, "orders")
    per = o.groupBy("o_orderdate", "o_orderstatus").agg(F.count("*").alias("n"),
                                                        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("u"))
    offset = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return per.select(
        F.concat(F.lit("/stmts/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".csv")).alias("file_path"),
        (F.col("o_orderdate") + F.make_interval(hours=offset)).alias("processed_at"),
        (F.col("n") * 100).cast("long").alias("file_size"),
        F.sha2(F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderstatus"), 256).alias("file_hash"),
        F.col("n").cast("long").alias("row_count"), F.col("o_orderstatus").alias("account"),
        F.col("u").cast("long").alias("transactions_added"))


_LEDGER_ENTRIES_SQL = (
    "SELECT '/stmts/' || strftime(o_orderdate, '%Y-%m-%d') || '.csv' AS file_path, "
    "CAST(o_orderdate + to_hours(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS TIMESTAMP) AS processed_at, "
    "CAST(count(*) * 100 AS BIGINT) AS file_size, sha256(strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderstatus) AS file_hash, "
    "CAST(count(*) AS BIGINT) AS row_count, o_orderstatus AS account, "
    "CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS transactions_added "
    "FROM orders GROUP BY o_orderdate, o_orderstatus")
_LEDGER_SQL = (f"SELECT file_path, arg_max(processed_at, processed_at) AS processed_at, arg_max(file_size, processed_at) AS file_size, "
               "arg_max(file_hash, processed_at) AS file_hash, arg_max(row_count, processed_at) AS row_count, "
               "arg_max(account, processed_at) AS account, arg_max(transactions_added, processed_at) AS transactions_added "
               f"FROM ({_LEDGER_ENTRIES_SQL}) _e GROUP BY file_path")


def _ledger(spark, sf):
    entries = _ledger_entries(spark, sf)
    return L.upsert(entries.limit(0), entries)


@query("ledger_upsert", _LEDGER_SQL)
def ledger_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Marks for every statement day, several per file; the latest wins."""
    return _ledger(spark, sf)


_LISTING_SQL = ("SELECT DISTINCT '/stmts/' || strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderpriority WHEN '1-URGENT' THEN '.csv' "
                "WHEN '2-HIGH' THEN '.PDF' WHEN '3-MEDIUM' THEN '.xlsx' WHEN '4-NOT SPECIFIED' THEN '.txt' ELSE '.xls' END AS file_path FROM orders")


def _listing(spark, sf):
    o = table(spark, sf, "orders")
    ext = (F.when(F.col("o_orderpriority") == "1-URGENT", ".csv").when(F.col("o_orderpriority") == "2-HIGH", ".PDF")
           .when(F.col("o_orderpriority") == "3-MEDIUM", ".xlsx").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", ".txt")
           .otherwise(".xls"))
    return o.select(F.concat(F.lit("/stmts/"), F.date_format("o_orderdate", "yyyy-MM-dd"), ext).alias("file_path")).distinct()


@query("ledger_pending", (
    f"SELECT file_path FROM ({_LISTING_SQL}) _l WHERE lower(regexp_extract(file_path, '(\\.[^.]*)$', 1)) IN ('.csv', '.pdf', '.xlsx', '.xls') "
    f"AND file_path NOT IN (SELECT file_path FROM ({_LEDGER_SQL}) _g)"))
def ledger_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Supported statement files not processed yet."""
    return L.pending(_listing(spark, sf), _ledger(spark, sf))


@query("ledger_unmark", (
    f"SELECT * FROM ({_LEDGER_SQL}) _g WHERE file_path NOT IN (SELECT '/stmts/' || strftime(o_orderdate, '%Y-%m-%d') || '.csv' "
    "FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P')"))
def ledger_unmark(spark: SparkSession, sf: str) -> DataFrame:
    """Unmark the statement days that had a low-priority pending order."""
    o = table(spark, sf, "orders").where((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"))
    paths = o.select(F.concat(F.lit("/stmts/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".csv")).alias("file_path"))
    return L.unmark(_ledger(spark, sf), paths)


@query("ledger_summary", (
    f"SELECT count(*) AS total_files, CAST(coalesce(sum(coalesce(row_count, 0)), 0) AS BIGINT) AS total_rows, "
    f"CAST(coalesce(sum(coalesce(transactions_added, 0)), 0) AS BIGINT) AS total_transactions FROM ({_LEDGER_SQL}) _g"))
def ledger_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A2: files, rows and appended transactions in the ledger."""
    return L.summary(_ledger(spark, sf))


# --------------------------------------------------------------------- files on disk

def _month_bodies(spark, sf) -> DataFrame:
    """One row per order month: its orders as lines ``day order cents``, in key order."""
    line = F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string")),
                       F.format_string("%.2f", "o_totalprice"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"])
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.array_join(lines, "\n").alias("value"))


_BODIES_SQL = ("SELECT strftime(o_orderdate, '%Y-%m') AS month, string_agg(strftime(o_orderdate, '%Y-%m-%d') || ' ORDER ' || CAST(o_orderkey AS VARCHAR) "
               "|| ' ' || printf('%.2f', o_totalprice), chr(10) ORDER BY o_orderkey) || chr(10) AS body, count(*) AS n FROM orders GROUP BY 1")
_MONTH_KIND = "CASE CAST(substring(month, 6) AS INTEGER) % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END"


def _mixed_files(spark, sf) -> str:
    """Order months as files, a third each: CSV statements, lines of text, text with a PDF header; and all as JSON."""
    root = scratch_path(spark, "mixed")
    bodies = _month_bodies(spark, sf).withColumn("kind", F.substring("month", 6, 2).cast("int") % 3)
    o = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).where(F.substring("month", 6, 2).cast("int") % 3 == 0)
    o.select("month", F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string")).alias("Description"),
             F.format_string("%.2f", "o_totalprice").alias("Amount")).repartition("month").write.partitionBy("month").option("header", True).csv(f"{root}/csv")
    bodies.where("kind = 1").select("month", "value").write.partitionBy("month").text(f"{root}/txt")
    bodies.where("kind = 2").select("month", F.concat(F.lit("%PDF-1.4\n"), F.col("value")).alias("value")).write.partitionBy("month").text(f"{root}/pdf")
    bodies.write.partitionBy("month").json(f"{root}/json")
    return root


def _file_cells():
    return [F.regexp_extract("file_path", "/([a-z]+)/month=", 1).alias("folder"), F.regexp_extract("file_path", "/month=([0-9-]+)/", 1).alias("month")]


@query("classify_files", (
    "WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders) "
    "SELECT month, " + _MONTH_KIND.format("'csv'", "'txt'", "'pdf'") + " AS folder, " + _MONTH_KIND.format("'csv'", "'unknown'", "'pdf'") + " AS file_type FROM m "
    "UNION ALL SELECT month, 'json', 'unknown' FROM m"))
def classify_files(spark: SparkSession, sf: str) -> DataFrame:
    """S3: order months as CSV, text, PDF-headed text and JSON files, by folder."""
    files = I.classify_files(spark, _mixed_files(spark, sf))
    return files.where(F.col("file_path").contains("/month=")).select(*_file_cells(), "file_type").distinct()


_DISPATCH_CSV = ("SELECT CAST(o_orderdate AS DATE) AS date, 'order ' || CAST(o_orderkey AS VARCHAR) AS description, o_totalprice AS amount, "
                 "strftime(o_orderdate, '%Y-%m') AS month FROM orders")


@query("dispatch_statements", (
    f"WITH o AS ({_DISPATCH_CSV}), m AS (SELECT DISTINCT month FROM o) "
    "SELECT " + _MONTH_KIND.format("'csv'", "'txt'", "NULL") + " AS folder, month, date, "
    + _MONTH_KIND.format("description", "upper(description)", "NULL") + " AS description, amount, NULL AS reason FROM o WHERE CAST(substring(month, 6) AS INTEGER) % 3 < 2 "
    "UNION ALL SELECT 'pdf', month, NULL, NULL, NULL, 'needs a document decoder' FROM m WHERE CAST(substring(month, 6) AS INTEGER) % 3 = 2 "
    "UNION ALL SELECT 'json', month, NULL, NULL, NULL, 'unknown file type' FROM m"))
def dispatch_statements(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of CSV, text, PDF-headed and JSON files: rows of the first two, the others as rejects."""
    rows, rejects = I.dispatch_statements(spark, _mixed_files(spark, sf), "chequing")
    rejects = rejects.where(F.col("file_path").contains("/month="))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("date", "date"), ("description", "string"), ("amount", "double"))]
    return (rows.select(*_file_cells(), "date", "description", "amount", F.lit(None).cast("string").alias("reason"))
            .unionByName(rejects.select(*_file_cells(), *nothing, "reason").distinct()))


LEDGER_BLOCK = 4096


@query("ledger_entries", (
    f"WITH b AS ({_BODIES_SQL}), h AS (SELECT month, strlen(body) AS file_size, n, "
    f"list_transform(range(0, greatest(CAST(ceil(strlen(body) / {LEDGER_BLOCK}) AS BIGINT), 1)), lambda i: sha256(substring(body, i * {LEDGER_BLOCK} + 1, {LEDGER_BLOCK}))) AS blocks FROM b) "
    "SELECT month, CAST(file_size AS BIGINT) AS file_size, CASE WHEN len(blocks) = 1 THEN blocks[1] ELSE sha256(array_to_string(blocks, '')) END AS file_hash, "
    "CAST(n AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS transactions_added, 'chequing' AS account FROM h"))
def ledger_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger entries of a file per order month: size, content hash (a tree over blocks of 4 kB) and row count."""
    root = scratch_path(spark, "ledger-files")
    _month_bodies(spark, sf).write.partitionBy("month").text(root)
    files = L.list_files(spark, root, recursive=True).where(F.col("file_path").contains("/month="))
    counts = CR.lines_of(spark, root).groupBy("file_path").agg(F.count("*").alias("row_count")).withColumn("transactions_added", F.lit(0))
    entries = L.entries_for(files, "chequing", counts, block_bytes=LEDGER_BLOCK)
    return entries.select(F.regexp_extract("file_path", "/month=([0-9-]+)/", 1).alias("month"), "file_size", "file_hash", "row_count", "transactions_added", "account")


def _statement_files(spark, sf, one_folder: bool = False) -> str:
    """Orders exported as two bank CSV layouts (by order status) into the scratch folder:
    ``layout_a`` / ``layout_b`` sub-folders, or both appended into one folder."""
    root = scratch_path(spark, "statements")
    o = table(spark, sf, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        F.concat(F.col("o_orderpriority"), F.lit(" #"), F.col("o_custkey").cast("string")).alias("Description"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("CAD$"),
        F.col("o_orderstatus").alias("Notes"))
    b = o.where(F.col("o_orderstatus") != "F").select(
        F.date_format("o_orderdate", "M/d/yyyy").alias("Posted Date"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("N/A"))
         .otherwise(F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority")).alias("Payee"),
        F.format_string("%.2f", "o_totalprice").alias("Amount"),
        F.col("o_custkey").cast("string").alias("Ref No"))
    if one_folder:
        a.write.option("header", True).csv(root)
        b.write.mode("append").option("header", True).csv(root)
    else:
        a.write.option("header", True).csv(f"{root}/layout_a")
        b.write.option("header", True).csv(f"{root}/layout_b")
    return root


_INGEST_SRC = ("SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ' #' || CAST(o_custkey AS VARCHAR) "
               "WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'ORDER ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority END AS raw, "
               "o_totalprice AS amount, CASE WHEN o_orderstatus = 'F' THEN 'chequing' ELSE 'savings' END AS account FROM orders")
_INGEST_TXN = f"SELECT date, {O.f2('raw')} AS description, amount, account FROM ({_INGEST_SRC}) _s"


@query("ingest_csv", (
    "SELECT date, description, amount, account, " + O.txn_id("date", "merchant", "amount", "account")
    + " AS transaction_id FROM (" + O.merchant_select(_INGEST_TXN, "description") + ") _q"))
def ingest_csv(spark: SparkSession, sf: str) -> DataFrame:
    """CSV statements in two header layouts read in one scan."""
    root = _statement_files(spark, sf)
    acct = F.when(F.col("file_path").contains("/layout_a/"), F.lit("chequing")).otherwise(F.lit("savings"))
    t = I.read_statements(spark, [f"{root}/layout_a", f"{root}/layout_b"], account=acct)
    return t.select("date", "description", "amount", "account", "transaction_id")


def _messy_files(spark, sf) -> str:
    """Orders as statements that are hard to read, by priority: 36 columns with the roles
    last; a header cell without a name; descriptions that go on over two lines; no amount;
    dates as bare digits."""
    root = scratch_path(spark, "messy")
    o = table(spark, sf, "orders")
    day, amount = F.date_format("o_orderdate", "yyyy/MM/dd"), F.format_string("%.2f", "o_totalprice")
    name = F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string"))
    roles = [day.alias("Date"), name.alias("Description"), amount.alias("Amount")]
    shapes = {"1-URGENT": [*[F.lit("x").alias(f"Extra {i}") for i in range(33)], *roles],
              "2-HIGH": [F.col("o_custkey").alias(" "), *roles],
              "3-MEDIUM": [day.alias("Date"), F.concat(F.lit("LINE\n"), name).alias("Payee"), amount.alias("Total")],
              "4-NOT SPECIFIED": [day.alias("Date"), name.alias("Description")],
              "5-LOW": [F.date_format("o_orderdate", "yyyyMMdd").alias("Date"), *roles[1:]]}
    for n, (priority, cells) in enumerate(shapes.items()):
        o.where(F.col("o_orderpriority") == priority).select(*cells) \
            .write.option("header", True).csv(f"{root}/shape_{n}")
    return root


_MESSY_SRC = ("SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'LINE ' ELSE '' END || 'ORDER ' "
              "|| CAST(o_orderkey AS VARCHAR) AS raw, o_totalprice AS amount, 'unknown' AS account FROM orders "
              "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
_MESSY_TXN = f"SELECT date, {O.f2('raw')} AS description, amount, account FROM ({_MESSY_SRC}) _s"


@query("ingest_csv_messy", (
    "SELECT date, description, amount, account, " + O.txn_id("date", "merchant", "amount", "account")
    + " AS transaction_id FROM (" + O.merchant_select(_MESSY_TXN, "description") + ") _q"))
def ingest_csv_messy(spark: SparkSession, sf: str) -> DataFrame:
    """Wide files, unnamed header cells and quoted line breaks are read; a file
    without an amount and rows with unreadable dates are left out."""
    t = I.read_statements(spark, [f"{_messy_files(spark, sf)}/*"])
    return t.select("date", "description", "amount", "account", "transaction_id")


@query("ingest_rejects", (
    "SELECT 'shape_4' AS folder, 'unreadable date' AS reason, strftime(o_orderdate, '%Y%m%d') AS date_text, "
    "'order ' || CAST(o_orderkey AS VARCHAR) AS description, o_totalprice AS amount FROM orders WHERE o_orderpriority = '5-LOW' "
    "UNION ALL SELECT 'shape_3', 'no amount column', NULL, NULL, NULL"))
def ingest_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What ``ingest_csv_messy`` leaves out: rows with their date text, and the folders of whole files."""
    r = I.statement_rejects(spark, [f"{_messy_files(spark, sf)}/*"])
    cells = [F.regexp_extract("file_path", "shape_[0-9]", 0).alias("folder"), "reason", "date_text", "description", "amount"]
    whole = F.col("row_seq").isNull()  # a folder has as many files as its write had tasks
    return r.where(~whole).select(*cells).unionByName(r.where(whole).select(*cells).distinct())


@query("ingest_order", (
    "SELECT CAST(row_number() OVER (ORDER BY k, o_orderkey) - 1 AS BIGINT) AS row_no, CAST(o_orderkey AS VARCHAR) || CASE k WHEN 1 THEN ' x' ELSE '' END AS description FROM ("
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS k FROM orders) _o"))
def ingest_order(spark: SparkSession, sf: str) -> DataFrame:
    """O2: rows numbered in the order of file names, then of rows in their file; the statements hold order
    keys in order, cells of one file go on over lines."""
    root = scratch_path(spark, "ordered")
    o = table(spark, sf, "orders")
    for name, status, text in (("a", F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")),
                               ("b", F.col("o_orderstatus") == "F", F.concat(F.col("o_orderkey").cast("string"), F.lit("\nx")))):
        rows = o.where(status).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), text.alias("Description"), F.lit("1").alias("Amount"))
        rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").drop("o_orderkey").write.option("header", True).csv(f"{root}/{name}")
    t = I.read_statements(spark, [f"{root}/a", f"{root}/b"])
    return number_rows(t, "row_no", "row_seq").select("row_no", "description")


@query("ingest_csv_large", (
    "SELECT date, description, amount, account, " + O.txn_id("date", "merchant", "amount", "account")
    + " AS transaction_id FROM (" + O.merchant_select(
        "SELECT CAST(o_orderdate AS DATE) AS date, 'line order ' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ' x y' ELSE '' END AS description, "
        "o_totalprice AS amount, 'unknown' AS account FROM orders", "description") + ") _q"))
def ingest_csv_large(spark: SparkSession, sf: str) -> DataFrame:
    """One file per order priority with a line break in every record, split over tasks."""
    root = scratch_path(spark, "large")
    key = F.col("o_orderkey")
    text = F.concat(F.lit("LINE\n"), F.lit("ORDER "), key.cast("string"), F.when(key % 3 == 0, F.lit(" \"x\"\n\n,y")).otherwise(F.lit("")))
    table(spark, sf, "orders").repartition("o_orderpriority").select(
        "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), text.alias("Payee"), F.format_string("%.2f", "o_totalprice").alias("Total")) \
        .write.partitionBy("o_orderpriority").option("header", True).option("escape", '"').csv(root)
    t = I.read_statements(spark, f"{root}/*")
    return t.select("date", "description", "amount", "account", "transaction_id")


@query("append_sink", (
    f"SELECT date, description AS name, category, account AS spent_from, amount, '' AS notes, transaction_id FROM ({_IDS_L}) _i"))
def append_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to a real target, the second of all rows and no more than the
    first left out; the target read back."""
    target = scratch_path(spark, "append-target")
    records = K.to_transactions(V.add_transaction_id(_keyword_labeled(spark, sf)))
    early = records.where(F.month("date") <= 6)
    K.append_new(early, target)
    K.append_new(records, target)
    return K.read_target(spark, target).drop(K.PARTITION)


# --------------------------------------------------------------------- streams

_EVENT_CSV_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


BATCHES = 4


def _event_batches(spark, sf, folder: str):
    """Appends the events to ``folder`` as CSV files, a ``BATCHES``-th of the event ids at a time; yields after each."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ids = ev.agg(F.min("event_id").alias("a"), F.max("event_id").alias("z")).first()
    part = F.floor((F.col("event_id") - ids.a) * BATCHES / (ids.z - ids.a + 1))
    for k in range(BATCHES):
        ev.where(part == k).write.mode("append").option("header", True).csv(folder)
        yield k


def _event_txn(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.to_date("ts").alias("date"),
                     F.concat(F.upper("event_type"), F.lit(" STORE "), F.col("user_id").cast("string")).alias("description"),
                     F.col("value").alias("amount"), F.col("user_id").cast("string").alias("account"))


@query("stream_ingest_append", (
    f"SELECT DISTINCT transaction_id, date, amount, account FROM ({_IDS_E}) _i"))
def stream_ingest_append(spark: SparkSession, sf: str) -> DataFrame:
    """Events arriving as CSV in several batches, read as a file stream (availableNow), appended
    through an idempotent foreachBatch with id anti join, the last batch replayed; the target read back."""
    from spendlake.streaming import stream as ST
    src, target, ckpt = (scratch_path(spark, f"stream-{x}") for x in ("in", "target", "ckpt"))
    append, last = ST.append_batch(target, order="event_id"), {}

    def run(df, batch_id):
        append(df, batch_id)
        last["id"], last["rows"] = batch_id, df.count()
    for _ in _event_batches(spark, sf, src):
        ST.run_available(ST.statement_stream(spark, src, _EVENT_CSV_SCHEMA, lambda d: V.add_transaction_id(_event_txn(d))), run, ckpt)
    again = spark.read.schema(_EVENT_CSV_SCHEMA).option("header", True).csv(src)
    append(V.add_transaction_id(_event_txn(again)), last["id"])  # a replay of the last batch, with all rows
    return spark.read.parquet(target).select("transaction_id", "date", "amount", "account")


@query("stream_learn", _LEARN_SQL)
def stream_learn(spark: SparkSession, sf: str) -> DataFrame:
    """T4: categorization with learning over a file stream of several batches (each adds what it learns)."""
    from spendlake.streaming import stream as ST
    src, labels, mem, ckpt = (scratch_path(spark, f"stream-{x}") for x in ("in", "labels", "memory", "ckpt"))
    for _ in _event_batches(spark, sf, src):
        ST.run_available(ST.statement_stream(spark, src, _EVENT_CSV_SCHEMA, _event_txn), ST.learn_batch(labels, mem, "event_id", RULES_E_MAP, 80), ckpt)
    out = spark.read.parquet(labels)
    return out.select("event_id", F.round("confidence", 6).alias("confidence"), "category", "matched_by")


# --------------------------------------------------------------------- end to end

_PIPE_SRC = _INGEST_SRC.replace("CASE WHEN o_orderstatus = 'F' THEN 'chequing' ELSE 'savings' END AS account",
                                "'chequing' AS account")
_PIPE_TXN = f"SELECT date, {O.f2('raw')} AS description, amount, account FROM ({_PIPE_SRC}) _s"
_PIPE_IDS = ("SELECT date, description, amount, account, " + O.txn_id("date", "merchant", "amount", "account")
             + " AS transaction_id FROM (" + O.merchant_select(_PIPE_TXN, "description") + ") _q")
_PIPE_SQL = _label_sql(_categorize_sql(_PIPE_IDS, R.rule_rows(R.DEFAULT_RULES), 80, None,
                                       "k.date, k.description, k.amount, k.account, k.transaction_id"),
                       "date, description, amount, account, transaction_id")
_PIPE_OUT = ("SELECT date, description AS name, category, account AS spent_from, amount, '' AS notes, transaction_id "
             f"FROM ({_PIPE_SQL}) _p")


@query("pipeline_end_to_end", _PIPE_OUT)
def pipeline_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Statements (two header layouts, one folder) -> scan -> categorize (default
    rules) -> append to a new target; the target read back."""
    from spendlake.plans.pipeline import run_pipeline
    folder = _statement_files(spark, sf, one_folder=True)
    target = scratch_path(spark, "pipeline-target")
    run_pipeline(spark, folder, target, scratch_path(spark, "pipeline-ledger"),
                 scratch_path(spark, "pipeline-memory"), account="chequing", learn=False)
    return spark.read.parquet(target).drop("month")


# --------------------------------------------------------------------- more sources / sinks

def _probe_sql_any(pats):
    return " OR ".join(f"contains(lower(n), '{p}')" for p in pats)


@query("header_probe", (
    "SELECT n_nationkey, list_filter(raw, lambda n: " + _probe_sql_any(I.PROBE_DATE_PATTERNS) + ")[1] AS date_col, "
    "list_filter(raw, lambda n: " + _probe_sql_any(I.PROBE_AMOUNT_PATTERNS_FIXED) + ")[1] AS amount_col, "
    "array_to_string(list_filter(raw, lambda n: " + _probe_sql_any(I.DESCRIPTION_PATTERNS) + "), '|') AS descriptions "
    "FROM (" + _HEADERS_SQL + ") _h"))
def header_probe(spark: SparkSession, sf: str) -> DataFrame:
    """The header probe on raw header names (date, amount, every description-like
    column), with the D2 currency patterns."""
    r = I.probe_roles(F.col("raw"))
    return _headers(spark, sf).select("n_nationkey", r.date.alias("date_col"), r.amount.alias("amount_col"),
                                      F.array_join(r.descriptions, "|").alias("descriptions"))


@query("ledger_lookup", (
    f"SELECT l.file_path, g.processed_at, g.row_count, g.transactions_added FROM ({_LISTING_SQL}) l "
    f"LEFT JOIN ({_LEDGER_SQL}) g ON l.file_path = g.file_path"))
def ledger_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Processed-file info for every listed file (null when never processed)."""
    info = L.processed_info(_listing(spark, sf), _ledger(spark, sf))
    return info.select("file_path", "processed_at", "row_count", "transactions_added")


@query("export_csv_roundtrip", (
    "SELECT CAST(date AS VARCHAR) AS \"Date\", description AS \"Description\", CAST(amount AS VARCHAR) AS \"Amount\", "
    "category AS \"Category\", account AS \"Account\", NULL::VARCHAR AS \"Notes\", transaction_id AS \"Transaction ID\" "
    f"FROM ({_IDS_L}) _i"))
def export_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Records exported as CSV (overwrite, export headings) and read back as text."""
    path = scratch_path(spark, "export-csv")
    K.write_csv(K.to_transactions(V.add_transaction_id(_keyword_labeled(spark, sf))), path)
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


@query("summary_input", (
    "SELECT date, description, amount, category, account FROM (" + _KW_L_SQL + ") _k"))
def summary_input(spark: SparkSession, sf: str) -> DataFrame:
    """Target records -> the report input frame."""
    from spendlake.operators import summaries as S
    recs = K.to_transactions(V.add_transaction_id(_keyword_labeled(spark, sf)))
    return S.summary_frame(recs)


_NET_SQL = ("SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_shipdate AS DATE) AS date, p.p_name || ' #' || CAST(l.l_suppkey AS VARCHAR) AS description, "
            "l.l_extendedprice * (1 - l.l_discount) AS amount, l.l_returnflag AS account FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey")


@query("transaction_id_exact", (
    "SELECT l_orderkey, l_linenumber, " + O.txn_id("date", "merchant", "amount", "account") + " AS transaction_id FROM ("
    + O.merchant_select(_NET_SQL, "description") + ") _q"))
def transaction_id_exact(spark: SparkSession, sf: str) -> DataFrame:
    """F7 with Python-exact cent rounding on net prices (many decimals), in generated code."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount",
                                               "l_extendedprice", "l_returnflag", "l_shipdate")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    net = li.join(part, li.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("l_suppkey").cast("string")).alias("description"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        F.col("l_returnflag").alias("account"))
    return V.add_transaction_id(net, exact_rounding=True).select("l_orderkey", "l_linenumber", "transaction_id")


@query("stream_dedupe", f"SELECT DISTINCT transaction_id, date, amount, account FROM ({_IDS_E}) _i")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """File stream of several batches deduplicated by id within a watermark horizon (30 days covers the
    whole event month), written through foreachBatch and read back."""
    from spendlake.streaming import stream as ST
    src, out, ckpt = (scratch_path(spark, f"stream-{x}") for x in ("in", "dedupe", "ckpt"))

    def write(df, batch_id):
        df.drop("_event_ts").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    for _ in _event_batches(spark, sf, src):
        s = ST.statement_stream(spark, src, _EVENT_CSV_SCHEMA, lambda d: V.add_transaction_id(_event_txn(d)))
        ST.run_available(ST.dedupe_stream(s, "date", "30 days"), write, ckpt)
    return spark.read.parquet(out).select("transaction_id", "date", "amount", "account")


_COARSE_SQL = ("SELECT event_id, CAST(ts AS DATE) AS date, upper(event_type) AS description, floor(value / 50) * 50 AS amount, 'all' AS account FROM events")


def _coarse_txn(df: DataFrame) -> DataFrame:
    """Events by day, type and amount in steps of 50: many rows of one id."""
    return df.select("event_id", F.to_date("ts").alias("date"), F.upper("event_type").alias("description"),
                     (F.floor(F.col("value") / 50) * 50.0).alias("amount"), F.lit("all").alias("account"))


@query("stream_dedupe_first", (
    "SELECT transaction_id, min(event_id) AS event_id FROM (SELECT event_id, " + O.txn_id("date", "merchant", "amount", "account") + " AS transaction_id FROM ("
    + O.merchant_select(_COARSE_SQL, "description") + ") _m) _i GROUP BY transaction_id"))
def stream_dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    """T3, first wins: events arriving in several batches, the later ids first; one row far ahead ends the
    stream, so that the watermark passes all others."""
    from spendlake.streaming import stream as ST
    src, out, ckpt = (scratch_path(spark, f"stream-{x}") for x in ("in", "first", "ckpt"))

    def write(df, batch_id):
        df.select("transaction_id", "event_id").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    def run():
        s = ST.statement_stream(spark, src, _EVENT_CSV_SCHEMA, lambda d: V.add_transaction_id(_coarse_txn(d)))
        ST.run_available(ST.first_by_id(s, "date", "event_id", "40 days"), write, ckpt)
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for k in reversed(range(BATCHES)):  # rows of one id come in several batches, the smallest event id often last
        ev.where(F.pmod(F.col("event_id"), F.lit(BATCHES)) == k).write.mode("append").option("header", True).csv(src)
        run()
    end = table(spark, sf, "events").agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 1000 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    end.write.mode("append").option("header", True).csv(src)
    run()
    return spark.read.parquet(out).where("event_id >= 0").select("transaction_id", "event_id")
