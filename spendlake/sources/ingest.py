"""Statement scans (S1-S3, S6, S7, U1, O2, O5): many CSV files with differing headers
into one Txn table.

Plan: a text scan finds the header line of every file and sums up the quotes of every block
(``records``; one row per block) -> column roles per file are computed from the header (F3 +
substring patterns) and written to the shared scratch folder -> one more text scan, cut into
records where quoted cells hold line breaks, parsed as wide as the last role column of any
file, joined to the roles and projected with native expressions. Files never pass through the
driver and are split over tasks; the per-file table is tiny compared with the rows.
"""
from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.text import column_name, description_key, normalize_column_name
from spendlake.functions.values import parse_amount, parse_date, transaction_hash
from spendlake.schema import DEFAULT_ACCOUNT
from spendlake.session import scratch_path
from spendlake.sources import records as CR
from spendlake.sources.ledger import extension, list_files
from spendlake.sources.lines import parse_lines
from spendlake.sources.ranges import first_bytes

# Header patterns per role (substring tests on normalized names, first
# column in file order wins), and the text pandas' CSV reader turns into nulls.
DESCRIPTION_PATTERNS = ("description", "merchant", "payee", "reference")
AMOUNT_PATTERNS = ("amount", "cad", "usd", "transaction", "total")
DATE_PATTERNS = ("date", "posted", "transaction")
PROBE_DATE_PATTERNS = ("transaction date", "date", "posted date")
PROBE_AMOUNT_PATTERNS = ("cad\\$", "usd\\$", "amount", "transaction amount")  # as written (Q2)
PROBE_AMOUNT_PATTERNS_FIXED = ("cad$", "usd$", "amount", "transaction amount")     # D2
NULL_MARKERS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
HEADER_CELL = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*)'
ROLE_COLUMNS = ("date_idx", "desc_idx", "amount_idx")
MAX_CELLS = 262_144             # cells of a row that the CSV parser takes
MAX_BROADCAST_FILES = 500_000   # roles rows are ~200 bytes: at most ~100 MB broadcast


def _any_of(pats: Sequence[str]) -> str:
    return "|".join(re.escape(p) for p in pats)


def _first_index(names: Column, pats: Sequence[str], exclude: Column | None = None) -> Column:
    """1-based position of the first name containing any pattern, 0 when none."""
    rx = _any_of(pats)

    def hit(n, i):
        h = F.coalesce(n.rlike(rx), F.lit(False))
        return h if exclude is None else h & ((i + 1) != exclude)
    return F.array_position(F.transform(names, hit), True)


def header_roles(names: Column, compat: bool = False) -> Column:
    """S2a on an array of normalized header names -> struct(date_idx, desc_idx, amount_idx)
    (1-based, 0 = missing). ``compat=True`` is the reference: amount patterns include
    "transaction" and the first column wins, so "transaction_date" can become the amount
    column. ``compat=False`` (D1) picks the date first, keeps it out of the amount role and
    prefers amount/cad/usd/total over transaction."""
    date_idx = _first_index(names, DATE_PATTERNS)
    desc_idx = _first_index(names, DESCRIPTION_PATTERNS)
    if compat:
        amount_idx = _first_index(names, AMOUNT_PATTERNS)
    else:
        strong = _first_index(names, ("amount", "cad", "usd", "total"), date_idx)
        weak = _first_index(names, ("transaction",), date_idx)
        amount_idx = F.when(strong > 0, strong).otherwise(weak)
    return F.struct(date_idx.alias("date_idx"), desc_idx.alias("desc_idx"),
                    amount_idx.alias("amount_idx"))


def _contains_any(n: Column, pats: Sequence[str]) -> Column:
    out = None
    for p in pats:
        c = F.instr(F.lower(n), F.lit(p)) > 0
        out = c if out is None else out | c
    return F.coalesce(out, F.lit(False))


def probe_roles(raw_names: Column, compat: bool = False) -> Column:
    """S2b, the header probe, on the raw header names (lower-cased substring tests):
    struct(date = first date-like name, descriptions = every description-like name,
    amount = first amount-like name); a missing role is null. The written amount
    patterns "cad\\$"/"usd\\$" contain a literal backslash and never match (Q2);
    ``compat=False`` (D2) matches "cad$"/"usd$"."""
    amounts = PROBE_AMOUNT_PATTERNS if compat else PROBE_AMOUNT_PATTERNS_FIXED
    first = lambda pats: F.try_element_at(
        F.filter(raw_names, lambda n: _contains_any(n, pats)), F.lit(1))
    return F.struct(first(PROBE_DATE_PATTERNS).alias("date"),
                    F.filter(raw_names, lambda n: _contains_any(n, DESCRIPTION_PATTERNS)).alias("descriptions"),
                    first(amounts).alias("amount"))


def _nullify(c: Column) -> Column:
    return F.when(c.isin(*NULL_MARKERS), F.lit(None)).otherwise(c)


def txn_columns(date: Column, desc: Column, amount: Column, account: Column,
                strip_currency: bool = True) -> list[Column]:
    """The Txn projection shared by every scan: F2 description, F5 amount, F6 date,
    F7 id (null when the date is bad, which the caller handles)."""
    d = parse_date(date)
    description = description_key(F.coalesce(_nullify(desc), F.lit("")))
    amt = parse_amount(_nullify(amount), strip_currency)
    tid = F.when(d.isNotNull(), transaction_hash(d, description, amt, account))
    return [d.alias("date"), description.alias("description"), amt.alias("amount"),
            account.alias("account"), tid.alias("transaction_id")]


@dataclass
class Probe:
    """The lines of some files, and what a first pass over them found: a row per file and a row per
    block, both written. Later passes read ``lines``, whose file listing is fixed."""

    lines: DataFrame
    roles: DataFrame
    blocks: DataFrame


def probe_files(spark: SparkSession, paths: str | Sequence[str], compat: bool = False, glob: str | None = None) -> Probe:
    """O5, the header probe, one pass over the lines. ``roles`` has one row per non-empty file: file_path,
    date_idx, desc_idx, amount_idx (1-based, 0 = missing), reason, multi (a line has an odd number of quotes),
    head_mid (row id of the header).

    The header is the file's first non-empty line. A cell without a name keeps its place.
    ``reason`` is null when every role was found; a header record that goes on over several
    lines has no roles and says so, as does a file whose last quote is never closed."""
    lines = CR.lines_of(spark, paths, glob)
    blocks = CR.blocks_of(lines)
    heads = (blocks.groupBy("file_path").agg(F.max("head").alias("_line"), F.max("head_mid").alias("head_mid"), F.max("multi").alias("multi"),
                                             (F.sum("odd") % 2).alias("_open")).where(F.col("_line").isNotNull()))
    whole = CR.quotes("_line") == 0
    # every cell is a comma and what follows it; quoted cells may hold commas and doubled quotes
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.col("_line")), F.lit(HEADER_CELL), F.lit(1))
    names = F.transform(F.when(whole, cells).otherwise(F.array()), column_name)
    r = header_roles(names, compat)
    reason = (F.when(~whole, "header record spans lines").when(F.col("_open") == 1, "unclosed quote")
              .when(r.desc_idx == 0, "no description column").when(r.amount_idx == 0, "no amount column").when(r.date_idx == 0, "no date column"))
    path = scratch_path(spark, "file-roles")
    heads.select("file_path", r.date_idx.alias("date_idx"), r.desc_idx.alias("desc_idx"), r.amount_idx.alias("amount_idx"),
                 reason.alias("reason"), "multi", "head_mid").write.parquet(path)
    return Probe(lines, spark.read.parquet(path), blocks)


def file_roles(spark: SparkSession, paths: str | Sequence[str], compat: bool = False) -> DataFrame:
    """The ``roles`` of ``probe_files``."""
    return probe_files(spark, paths, compat).roles


def read_statements(spark: SparkSession, paths: str | Sequence[str], account=DEFAULT_ACCOUNT,
                    compat: bool = False, bad_dates: str = "quarantine", probe: Probe | None = None, glob: str | None = None) -> DataFrame:
    """Every CSV statement under ``paths`` as one Txn DataFrame. Files are split over tasks
    whether or not quoted cells hold line breaks.

    ``account``: a literal, or a Column computed from ``file_path``. Output columns: Txn +
    ``file_path`` and ``row_seq`` (struct of file path, block start, row id: the file-name
    order of the reference's folder walk, then row order). Files whose header lacks a
    role are skipped (per-file error isolation). ``bad_dates``: "quarantine" drops rows
    without a parsable date, "fail_file" drops every row of a file that has one, "keep"
    keeps them with a null id. ``statement_rejects`` lists what is skipped or dropped.

    ``probe``: the files' ``probe_files``, when already there; ``glob``: which file names to read.
    """
    out = statement_rows(spark, paths, account, compat, probe, glob).drop("date_text")
    if bad_dates == "quarantine":
        return out.where(F.col("date").isNotNull())
    if bad_dates == "fail_file":
        bad = out.where(F.col("date").isNull()).select("file_path").distinct()
        return out.join(bad, "file_path", "left_anti")
    if bad_dates == "keep":
        return out
    raise ValueError("bad_dates must be 'quarantine', 'fail_file' or 'keep'")


def statement_rejects(spark: SparkSession, paths, compat: bool = False, probe: Probe | None = None, glob: str | None = None) -> DataFrame:
    """What ``read_statements`` skips or drops: (file_path, row_seq, reason, date_text,
    description, amount). A file without roles is one row with a null ``row_seq``; a row
    whose date cannot be read is one row, with the text of its date."""
    probe = probe_files(spark, paths, compat, glob) if probe is None else probe
    rows = statement_rows(spark, paths, DEFAULT_ACCOUNT, compat, probe, glob).where(F.col("date").isNull())
    return rejects_of(rows, probe)


def rejects_of(rows: DataFrame, probe: Probe) -> DataFrame:
    """``statement_rejects`` from rows without a date that are at hand (``statement_rows``)."""
    rows = rows.select("file_path", "row_seq", F.lit("unreadable date").alias("reason"), "date_text",
                       "description", "amount")
    files = probe.roles.where(F.col("reason").isNotNull()).select("file_path", "reason")
    return rows.unionByName(files, allowMissingColumns=True)


def statement_rows(spark: SparkSession, paths, account, compat: bool, probe: Probe | None, glob: str | None = None) -> DataFrame:
    """All rows of all files with every role: Txn + file_path, row_seq, date_text. A row
    whose cells are blank up to the last role column is a blank line, not a row."""
    probe = probe_files(spark, paths, compat, glob) if probe is None else probe
    ok = probe.roles.where(F.col("reason").isNull()).drop("reason")
    # the positions in use, per role: at most the number of columns of the widest header
    used = ok.agg(F.count("*").alias("n"), F.sum("multi").alias("multi"), *[F.collect_set(c).alias(c) for c in ROLE_COLUMNS]).first()
    cells = [f"_c{i}" for i in range(max([1, *used.date_idx, *used.desc_idx, *used.amount_idx]))]
    # one small row per file -> broadcast under a bound on the number of files, so the
    # statement rows are never shuffled for this join; beyond it AQE decides
    near = F.broadcast if used.n <= MAX_BROADCAST_FILES else (lambda df: df)
    lines = probe.lines
    single = lines.join(near(ok.where("multi = 0").select("file_path")), "file_path", "left_semi")
    multi = lines.join(near(ok.where("multi = 1").select("file_path")), "file_path", "left_semi")
    blocks = probe.blocks.join(ok.where("multi = 1").select("file_path"), "file_path", "left_semi")
    # files without an odd line need no cutting; a branch without files is left out
    raw = single if not used.multi else CR.records(multi, blocks)
    if used.multi and used.multi < used.n:
        raw = raw.unionByName(single.select(*raw.columns))
    # RFC 4180 quoting (a quote inside a quoted field is doubled), as pandas reads it
    schema = ", ".join(f"{c} string" for c in cells)
    data = raw.join(near(ok.drop("multi")), "file_path").where(F.col("_mid") != F.col("head_mid"))
    # a generator, so that no filter on the cells is moved below it and parses every row again
    row = F.inline(F.array(F.from_csv("value", schema, {"escape": '"', "maxColumns": str(MAX_CELLS)})))
    data = data.select("file_path", "_blk", "_mid", *ROLE_COLUMNS, row).where(F.trim(F.concat_ws("", *cells)) != "")
    acct = account if isinstance(account, Column) else F.lit(account)
    date_text, desc, amount = (_pick(c, used[c]) for c in ROLE_COLUMNS)
    return data.select("file_path", F.struct("file_path", "_blk", "_mid").alias("row_seq"), date_text.alias("date_text"),
                       *txn_columns(date_text, desc, amount, acct))


def _pick(idx: str, used: Sequence[int]) -> Column:
    """Cell ``idx`` (1-based, a column name) of a row: a generated CASE over the positions in use."""
    whens = " ".join(f"WHEN {i} THEN _c{i - 1}" for i in sorted(used))
    return F.expr(f"CASE {idx} {whens} END" if whens else "CAST(NULL AS STRING)")


def classify_files(spark: SparkSession, paths, recursive: bool = True) -> DataFrame:
    """S3: (file_path, file_type) with type csv / pdf / excel by lower-cased suffix, else
    pdf when the content starts with ``%PDF``, else unknown. Only files whose suffix says
    nothing are opened, for their first four bytes."""
    files = list_files(spark, paths, recursive).select("file_path")
    ext = extension("file_path")
    by_ext = (F.when(ext == ".csv", "csv").when(ext == ".pdf", "pdf")
              .when(ext.isin(".xls", ".xlsx"), "excel"))
    files = files.withColumn("file_type", by_ext)
    odd = first_bytes(files.where("file_type is null").select("file_path"), 4)
    magic = F.when(F.col("head") == F.lit(bytearray(b"%PDF")), "pdf").otherwise("unknown")
    return files.where("file_type is not null").unionByName(odd.select("file_path", magic.alias("file_type")))


def normalize_table(df: DataFrame, account=DEFAULT_ACCOUNT, strip_currency: bool = False,
                    compat: bool = False) -> DataFrame:
    """A table that is already tabular (e.g. a decoded spreadsheet) -> Txn. Header
    names are normalized (P1, collisions get a position suffix) and roles picked like
    S1; amounts keep ``$``/``,`` unless ``strip_currency`` (the reference's spreadsheet
    branch does not strip them). A missing role raises ValueError."""
    names = [normalize_column_name(c) for c in df.columns]
    seen: dict[str, int] = {}
    uniq = []
    for i, n in enumerate(names):
        uniq.append(n if n not in seen else f"{n}_{i}")
        seen.setdefault(n, i)
    t = df.toDF(*uniq)

    def first(pats, exclude=None):
        return next((c for c in uniq if c != exclude and any(p in c for p in pats)), None)
    date_c = first(DATE_PATTERNS)
    desc_c = first(DESCRIPTION_PATTERNS)
    amt_c = first(AMOUNT_PATTERNS) if compat else (
        first(("amount", "cad", "usd", "total"), date_c) or first(("transaction",), date_c))
    for role, c in (("description", desc_c), ("amount", amt_c), ("date", date_c)):
        if c is None:
            raise ValueError(f"no {role} column")
    acct = account if isinstance(account, Column) else F.lit(account)
    return t.select(*txn_columns(F.col(date_c).cast("string"), F.col(desc_c).cast("string"),
                                 F.col(amt_c).cast("string"), acct, strip_currency))


CSV_FILES, TEXT_FILES = "*.[cC][sS][vV]", "*.[tT][xX][tT]"


def dispatch_statements(spark: SparkSession, paths, account=DEFAULT_ACCOUNT, compat: bool = False,
                        keep_sign: bool = True) -> tuple[DataFrame, DataFrame]:
    """S7, the dispatch over a folder of mixed files: (rows, rejects).

    CSV statements go through ``read_statements``, text files holding extracted statement lines (``.txt``) through
    ``lines.parse_lines``, picked by file name as Spark lists the folder; rows are Txn rows with ``file_path``.
    Rejects (columns of ``statement_rejects``): what the CSV scan leaves out, lines whose date
    cannot be read, PDFs and spreadsheets, which need a document decoder, and files of unknown type.
    A text file that starts with ``%PDF`` is a PDF."""
    acct = account if isinstance(account, Column) else F.lit(account)
    kinds = classify_files(spark, paths)
    probe = probe_files(spark, paths, compat, CSV_FILES)
    csv = read_statements(spark, paths, acct, compat, "quarantine", probe).drop("row_seq")
    pdfs = kinds.where("file_type = 'pdf'").select("file_path")
    text = CR.lines_of(spark, paths, TEXT_FILES).join(pdfs, "file_path", "left_anti")
    found = parse_lines(text, "value", keep_sign=keep_sign).withColumn("date", parse_date(F.col("date_text")))
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    rows = found.where("date is not null").select(
        "file_path", "date", "description", amount.alias("amount"), acct.alias("account"),
        transaction_hash(F.col("date"), F.col("description"), amount, acct).alias("transaction_id"))
    bad = found.where("date is null").select("file_path", F.struct("file_path", "_blk", "_mid").alias("row_seq"),
                                             F.lit("unreadable date").alias("reason"), "date_text", "description", amount.alias("amount"))
    why = (F.when(F.col("file_type").isin("pdf", "excel"), "needs a document decoder")
           .when((F.col("file_type") == "unknown") & (extension("file_path") != ".txt"), "unknown file type"))
    files = kinds.select("file_path", why.alias("reason")).where("reason is not null")
    rejects = (statement_rejects(spark, paths, compat, probe).unionByName(bad).unionByName(files, allowMissingColumns=True))
    return csv.unionByName(rows), rejects


def parse_statements(spark: SparkSession, paths, account=DEFAULT_ACCOUNT, keep_sign: bool = True) -> DataFrame:
    """The rows of ``dispatch_statements``."""
    return dispatch_statements(spark, paths, account, keep_sign=keep_sign)[0]
