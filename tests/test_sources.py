"""S1-S11, S4/S5 and T1-T4 on small files written by the tests."""
import datetime

import pytest
from pyspark.sql import functions as F

from spendlake.sources import ingest as I
from spendlake.sources import ledger as L
from spendlake.sources import lines as LN
from spendlake.streaming import stream as ST


def test_statement_lines(spark):
    lines = ["2024-01-15 COFFEE SHOP 5.50", "01/15/2024 REFUND -$1,234.56", "15-Jan-24 ATM | 20",
             "Statement date 2024-01-15", "2024-01-15 Y 12.345", "2024-01-15 NOTHING", "no date 5.00", "   "]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, value string")
    got = [(r.date_text, r.description, r.amount_text, r.amount)
           for r in LN.parse_lines(df, keep_sign=False).orderBy("i").collect()]
    assert got == [("2024-01-15", "COFFEE SHOP", "5.50", 5.5), ("01/15/2024", "REFUND", "1,234.56", 1234.56),
                   ("15-Jan-24", "ATM", "20", 20.0), ("2024-01-15", "", "15", 15.0),
                   ("2024-01-15", "Y 12.", "345", 345.0)]
    signed = LN.parse_lines(df, keep_sign=True).where(F.col("i") == 1).first()
    assert signed.amount == -1234.56


def test_statement_cells(spark):
    df = spark.createDataFrame([(["2024-01-15", " COFFEE ", None, "5.50"],), (["x", "y"],)], "cells array<string>")
    r = LN.parse_cells(df).collect()
    assert [(x.date_text, x.description, x.amount) for x in r] == [("2024-01-15", "COFFEE", 5.5)]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_read_statements_two_layouts(spark, tmp_path):
    write(tmp_path / "a" / "jan.csv", "Date,Description,CAD$\n2024-01-15,STARBUCKS COFFEE #12,\"$1,005.50\"\n"
                                      "2024-01-16,NA,3\nbad-date,X,1\n")
    write(tmp_path / "b" / "feb.csv", "Posted Date,Payee,Amount,Ref\n2/1/2024,Tim Hortons,5.25,r1\n"
                                      '2/2/2024,"JOE\'S ""BEST"" CAFE, INC",1.00,r2\n')
    write(tmp_path / "c" / "odd.csv", "Foo,Bar\n1,2\n")
    t = I.read_statements(spark, [str(tmp_path / d) for d in "abc"], account="chequing")
    rows = sorted((r.date, r.description, r.amount) for r in t.collect())
    assert rows == [(datetime.date(2024, 1, 15), "starbucks coffee 12", 1005.5),
                    (datetime.date(2024, 1, 16), "", 3.0), (datetime.date(2024, 2, 1), "tim hortons", 5.25),
                    (datetime.date(2024, 2, 2), "joe s best cafe inc", 1.0)]
    assert I.read_statements(spark, str(tmp_path / "a"), bad_dates="fail_file").count() == 0
    rej = I.statement_rejects(spark, [str(tmp_path / d) for d in "abc"]).collect()
    assert sorted((r.file_path[-7:], r.reason, r.date_text) for r in rej) == [
        ("jan.csv", "unreadable date", "bad-date"), ("odd.csv", "no description column", None)]


def test_read_statements_wide_unnamed_and_multi_line(spark, tmp_path):
    wide = [f"x{i}" for i in range(40)]
    write(tmp_path / "wide.csv", ",".join([*wide, "Date", "Payee", "Amount"]) + "\n"
          + ",".join(["1"] * 40 + ["2024-01-15", "WIDE", "7.5"]) + "\n")
    write(tmp_path / "index.csv", ',Date,"Payee, ""short""",Amount\n0,2024/01/16,INDEX,2\n')
    write(tmp_path / "lines.csv", 'Date,Payee,Amount\n2024-01-17,"TIM\nHORTONS",5.50\n\n   \n')
    write(tmp_path / "spans.csv", 'Date,"Pay\nee",Amount\n2024-01-18,X,1\n')
    write(tmp_path / "empty.csv", "")
    rows = sorted((r.date.day, r.description, r.amount) for r in I.read_statements(spark, str(tmp_path)).collect())
    assert rows == [(15, "wide", 7.5), (16, "index", 2.0), (17, "tim hortons", 5.5)]
    rej = I.statement_rejects(spark, str(tmp_path)).collect()
    assert [(r.file_path[-9:], r.reason) for r in rej] == [("spans.csv", "header record spans lines")]


def test_read_statements_no_usable_file(spark, tmp_path):
    write(tmp_path / "odd.csv", "Foo,Bar\n1,2\n")
    assert I.read_statements(spark, str(tmp_path)).count() == 0


def test_pipeline_retries_failed_files(spark, tmp_path):
    from spendlake.plans.pipeline import run_pipeline
    from spendlake.sources import snapshots as SN
    d = tmp_path / "stmts"
    write(d / "good.csv", "Date,Description,Amount\n2024-01-15,ONE,1\n")
    write(d / "bad.csv", "Date,Description,Amount\n2024-01-16,TWO,2\nsoon,THREE,3\n")
    write(d / "norole.csv", "A,B\n1,2\n")
    paths = dict(target_path=str(tmp_path / "t"), ledger_root=str(tmp_path / "l"), memory_root=str(tmp_path / "m"))
    r = run_pipeline(spark, str(d), rejects_path=str(tmp_path / "r"), learn=False, **paths)
    assert (r.files_processed, r.files_failed, r.rows_parsed, r.rows_appended, r.rows_rejected) == (1, 2, 1, 1, 1)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    write(d / "bad.csv", "Date,Description,Amount\n2024-01-16,TWO,2\n2024-01-15,ONE,1\n")
    r = run_pipeline(spark, str(d), learn=False, **paths)
    assert (r.files_processed, r.files_failed, r.rows_parsed, r.rows_appended) == (1, 1, 2, 1)
    led = {x.file_path[-8:]: (x.row_count, x.transactions_added) for x in SN.load_latest(spark, paths["ledger_root"]).collect()}
    assert led == {"good.csv": (1, 1), "/bad.csv": (2, 1)}
    assert spark.read.parquet(paths["target_path"]).count() == 2


def test_stream_append_keeps_rows_without_id(spark, tmp_path):
    append = ST.append_batch(str(tmp_path / "t"), order="n")
    schema = "date date, transaction_id string, n long"
    day = datetime.date(2024, 1, 15)
    append(spark.createDataFrame([(day, None, 1), (day, None, 2), (day, "a", 3), (day, "a", 4)], schema), 0)
    append(spark.createDataFrame([(datetime.date(2024, 2, 1), "a", 5), (None, "b", 6), (day, None, 7)], schema), 1)
    append(spark.createDataFrame([(None, "b", 8), (day, "c", 9)], schema), 2)
    append(spark.createDataFrame([(None, "b", 8), (day, "c", 9)], schema), 2)   # a replay
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3, 6, 7, 9]


def test_header_roles_compat_and_fixed(spark):
    df = spark.createDataFrame([(["transaction_date", "description", "cad"],)], "names array<string>")
    ref = df.select(I.header_roles(F.col("names"), True).alias("r")).first().r
    fixed = df.select(I.header_roles(F.col("names"), False).alias("r")).first().r
    assert (ref.date_idx, ref.desc_idx, ref.amount_idx) == (1, 2, 1)      # Q1: amount -> the date column
    assert (fixed.date_idx, fixed.desc_idx, fixed.amount_idx) == (1, 2, 3)


def test_normalize_table_missing_role(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    import pytest
    with pytest.raises(ValueError):
        I.normalize_table(df)


def test_classify_files(spark, tmp_path):
    write(tmp_path / "a.CSV", "x\n")
    write(tmp_path / "b.xlsx", "x")
    (tmp_path / "c.bin").write_bytes(b"%PDF-1.4 rest")
    write(tmp_path / "d.txt", "hello")
    got = dict((r.file_path.rsplit("/", 1)[1], r.file_type) for r in I.classify_files(spark, str(tmp_path)).collect())
    assert got == {"a.CSV": "csv", "b.xlsx": "excel", "c.bin": "pdf", "d.txt": "unknown"}


def test_ledger_upsert_pending_unmark_summary(spark):
    ts = datetime.datetime
    led = L.empty_ledger(spark)
    e = spark.createDataFrame([("/s/a.csv", ts(2024, 1, 1), 10, "h1", 5, "chq", 5),
                               ("/s/a.csv", ts(2024, 1, 2), 11, "h2", 6, "chq", 2),
                               ("/s/b.pdf", ts(2024, 1, 1), 1, "h3", None, "chq", None)], led.schema)
    led = L.upsert(led, e)
    a = led.where(F.col("file_path") == "/s/a.csv").first()
    assert (a.file_hash, a.row_count) == ("h2", 6)
    files = spark.createDataFrame([("/s/a.csv",), ("/s/b.pdf",), ("/s/c.XLS",), ("/s/d.txt",)], "file_path string")
    assert [r.file_path for r in L.pending(files, led).collect()] == ["/s/c.XLS"]
    s = L.summary(led).first()
    assert (s.total_files, s.total_rows, s.total_transactions) == (2, 6, 2)
    gone = L.unmark(led, spark.createDataFrame([("/s/a.csv",)], "file_path string"))
    assert [r.file_path for r in gone.collect()] == ["/s/b.pdf"]
    assert sorted(r.file_path for r in L.is_processed(files, led).collect()) == ["/s/a.csv", "/s/b.pdf"]
    assert L.clear_all(led).count() == 0


def test_stream_append_replay_safe_and_learning_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows = ["event_id,ts,user_id,event_type,value"]
    # two files, written one after another: the second arrives in a later micro-batch
    write(src / "f1.csv", "\n".join(rows + ["1,2024-01-01 00:00:00,1,click,1.0", "2,2024-01-01 00:00:00,1,click,1.0"]) + "\n")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"

    def txn(d):
        return d.select("event_id", F.to_date("ts").alias("date"), F.upper("event_type").alias("description"),
                        F.col("value").alias("amount"), F.col("user_id").cast("string").alias("account"))
    from spendlake.functions.values import add_transaction_id
    target, ck = str(tmp_path / "t"), str(tmp_path / "ck")
    s = ST.statement_stream(spark, str(src), schema, lambda d: add_transaction_id(txn(d)), 1)
    ST.run_available(s, ST.append_batch(target, order="event_id"), ck)
    write(src / "f2.csv", "\n".join(rows + ["3,2024-01-01 00:00:00,1,click,1.0", "4,2024-01-02 00:00:00,2,view,2.0"]) + "\n")
    ST.run_available(ST.statement_stream(spark, str(src), schema, lambda d: add_transaction_id(txn(d)), 1),
                     ST.append_batch(target, order="event_id"), ck)
    t = spark.read.parquet(target)
    assert sorted(r.event_id for r in t.collect()) == [1, 4]
    # replaying batch 0 rewrites only its own partition
    b0 = add_transaction_id(txn(spark.read.schema(schema).option("header", True).csv(str(src / "f1.csv"))))
    ST.append_batch(target, order="event_id")(b0, 0)
    assert spark.read.parquet(target).count() == 2
    # learning carried from batch 0 to batch 1
    labels, mem = str(tmp_path / "l"), str(tmp_path / "m")
    fn = ST.learn_batch(labels, mem, "event_id", {"Fun": ["click"], "Look": ["view"]})
    fn(txn(spark.read.schema(schema).option("header", True).csv(str(src / "f1.csv"))), 0)
    fn(txn(spark.read.schema(schema).option("header", True).csv(str(src / "f2.csv"))), 1)
    out = {r.event_id: (r.category, r.matched_by) for r in spark.read.parquet(labels).collect()}
    assert out[1] == ("Fun", "fuzzy") and out[2] == ("Fun", "memory") and out[3] == ("Fun", "memory")
    assert out[4] == ("Look", "keyword")


def test_pipeline_end_to_end_idempotent(spark, tmp_path):
    from spendlake.plans.pipeline import run_pipeline
    from spendlake.sources import snapshots as SN
    d = tmp_path / "stmts"
    write(d / "2024-01.csv", "Date,Description,Amount\n2024-01-15,STARBUCKS COFFEE #12,5.50\n"
                              "2024-01-16,TIM HORTONS #1,2.00\n2024-01-17,STARBUCKS COFFEE #99,7.00\n")
    write(d / "2024-02.csv", "Date,Description,Amount\n2024-01-15,STARBUCKS COFFEE #12,5.50\n"
                              "2024-02-01,PAYROLL DEPOSIT,1000\n")
    write(d / "notes.pdf", "%PDF-1.4")
    write(d / "readme.md", "x")
    paths = dict(target_path=str(tmp_path / "t"), ledger_root=str(tmp_path / "l"), memory_root=str(tmp_path / "m"))
    r1 = run_pipeline(spark, str(d), account="chequing", **paths)
    assert (r1.files_processed, r1.files_skipped, r1.rows_parsed, r1.rows_appended) == (2, 1, 5, 4)
    t = spark.read.parquet(paths["target_path"])
    cats = {r.name: (r.category) for r in t.collect()}
    assert cats["payroll deposit"] == "Salary" and cats["tim hortons 1"] == "Dining"
    led = SN.load_latest(spark, paths["ledger_root"]).orderBy("file_path").collect()
    assert [(r.row_count, r.transactions_added) for r in led] == [(3, 3), (2, 1)]
    assert SN.load_latest(spark, paths["memory_root"]).count() >= 2
    r2 = run_pipeline(spark, str(d), account="chequing", **paths)
    assert (r2.files_processed, r2.rows_appended) == (0, 0)
    assert spark.read.parquet(paths["target_path"]).count() == 4


def test_probe_roles_and_dedupe_stream(spark):
    df = spark.createDataFrame([(["Transaction Date", "Description", "Merchant", "CAD$"],)], "names array<string>")
    r = df.select(I.probe_roles(F.col("names")).alias("r")).first().r
    assert (r.date, r.amount, list(r.descriptions)) == ("Transaction Date", "CAD$", ["Description", "Merchant"])
    ref = df.select(I.probe_roles(F.col("names"), compat=True).alias("r")).first().r
    assert ref.amount is None  # the written patterns never match "CAD$" (Q2)
    s = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    s = s.select(F.col("timestamp").alias("ts"), (F.col("value") % 3).cast("string").alias("transaction_id"))
    out = ST.dedupe_stream(s, "ts", "1 hour")
    assert out.isStreaming and "transaction_id" in out.columns


def test_parse_statements_dispatch(spark, tmp_path):
    write(tmp_path / "a.csv", "Date,Description,Amount\n2024-01-15,STARBUCKS COFFEE #12,5.50\n")
    write(tmp_path / "b.txt", "2024-01-16 TIM HORTONS #3 2.00\nnot a row\n")
    write(tmp_path / "c.xlsx", "binary")
    out = I.parse_statements(spark, str(tmp_path), account="chq")
    got = sorted((r.date.isoformat(), r.description, r.amount) for r in out.collect())
    assert got == [("2024-01-15", "starbucks coffee 12", 5.5), ("2024-01-16", "TIM HORTONS #3", 2.0)]


def test_fixed_roles_read_and_table_options(spark, tmp_path):
    # Q1: "Transaction Date" also matches the amount patterns; D1 picks CAD$ instead
    write(tmp_path / "q1" / "s.csv", "Transaction Date,Description,CAD$\n2024-03-01,COFFEE,\"$1,250.00\"\n")
    ref = I.read_statements(spark, str(tmp_path / "q1"), compat=True).first()
    fixed = I.read_statements(spark, str(tmp_path / "q1")).first()
    assert (ref.amount, fixed.amount) == (0.0, 1250.0)
    t = spark.createDataFrame([("2024-03-01", "Coffee Shop", "$1,250.00")], "Date string, Payee string, Amount string")
    assert I.normalize_table(t, "chq").first().amount == 0.0                      # spreadsheet branch (Q16)
    assert I.normalize_table(t, "chq", strip_currency=True).first().amount == 1250.0


def test_cells_keep_sign(spark):
    df = spark.createDataFrame([(["2024-01-15", "REFUND", "-$12.50"],)], "cells array<string>")
    assert LN.parse_cells(df, keep_sign=False).first().amount == 12.5
    assert LN.parse_cells(df).first().amount == -12.5


def test_stream_learning_equals_batch_over_many_micro_batches(spark, tmp_path):
    import os

    from spendlake.operators.categorize import categorize_learn
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", "value").toPandas()
    ev = ev.sort_values("event_id")
    assert ev["ts"].is_monotonic_increasing  # event order = time order = file order below
    src = tmp_path / "days"
    src.mkdir()
    days = sorted(ev["ts"].dt.date.unique())
    chunk = {d: i * 6 // len(days) for i, d in enumerate(days)}   # 6 files of consecutive days
    for i, part in ev.groupby(ev["ts"].dt.date.map(chunk), sort=True):
        p = src / f"part{i}.csv"
        part.assign(ts=part["ts"].dt.strftime("%Y-%m-%d %H:%M:%S")).to_csv(p, index=False)
        os.utime(p, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"

    def txn(d):
        return d.select("event_id", F.concat(F.upper("event_type"), F.lit(" STORE "),
                                             F.col("user_id").cast("string")).alias("description"))
    rules = {"Engagement": ["click", "view"], "Revenue": ["purchase"], "Ops": ["error", "1 error store"]}
    labels, mem = str(tmp_path / "l"), str(tmp_path / "m")
    s = ST.statement_stream(spark, str(src), schema, txn, max_files_per_trigger=1)
    ST.run_available(s, ST.learn_batch(labels, mem, "event_id", rules), str(tmp_path / "ck"))
    streamed = spark.read.parquet(labels)
    assert streamed.select("batch_id").distinct().count() == 6
    batch_df = spark.createDataFrame(ev[["event_id", "user_id", "event_type"]]).transform(
        lambda d: d.select("event_id", F.concat(F.upper("event_type"), F.lit(" STORE "),
                                                F.col("user_id").cast("string")).alias("description")))
    batch, _ = categorize_learn(batch_df, "event_id", rules)
    key = lambda r: (r.event_id, r.category, round(r.confidence, 9), r.matched_by)
    assert sorted(map(key, streamed.collect())) == sorted(map(key, batch.collect()))


@pytest.mark.parametrize("block", [400, 100_000])
def test_quoted_line_breaks_cut_in_parallel(spark, tmp_path, block):
    """Records over many lines and many blocks, against pandas; files are split over tasks."""
    import random

    import pandas as pd
    rnd = random.Random(block)
    word = lambda: rnd.choice(["coffee", "a b", 'say ""hi""', "x,y", "line\nbreak", "\n", "two\n\nbreaks " + "long " * 30, "é"])
    for f in range(3):
        rows = [f'2024-01-{rnd.randrange(1, 28):02d},"{word()} {word()}",{rnd.randrange(100)}.{rnd.randrange(10, 99)},"{word() if f % 2 else "n"}"' for _ in range(25)]
        if f == 2:
            rows = [x.replace('"', "").replace("\n", " ").replace("x,y", "xy") for x in rows]  # a file without quotes
        rows[5:5] = ["", "   "]
        write(tmp_path / "s" / f"f{f}.csv", "\nDate,Payee,Amount,Note\n" + "\n".join(rows) + ("\n" if f else ""))
    write(tmp_path / "s" / "open.csv", 'Date,Payee,Amount\n2024-01-17,"never closed,5.50\n2024-01-18,X,1\n')
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        probe = I.probe_files(spark, str(tmp_path / "s"))
        got = sorted((r.file_path[-6:], str(r.date), r.description, r.amount) for r in I.read_statements(spark, str(tmp_path / "s"), probe=probe).collect())
        rejects = [(r.file_path[-8:], r.reason) for r in I.statement_rejects(spark, str(tmp_path / "s"), probe=probe).collect()]
        n_blocks = probe.blocks.count()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = []
    for f in range(3):
        t = pd.read_csv(tmp_path / "s" / f"f{f}.csv", dtype=str, keep_default_na=False)
        t = t[t["Date"].str.strip() != ""]
        want += [(f"f{f}.csv", d, " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in p.lower()).split()), float(a))
                 for d, p, a in zip(t["Date"], t["Payee"], t["Amount"])]
    assert got == sorted(want)
    assert rejects == [("open.csv", "unclosed quote")]
    assert n_blocks > 5 or block == 100_000


def test_content_hashes_by_range_and_tree(spark, tmp_path):
    import hashlib

    from spendlake.sources import ranges
    bodies = {"one": b"x" * 10, "edge": b"ab" * 8, "odd name+%20.bin": bytes(range(256)) * 3, "many": bytes(k % 251 for k in range(16 * 300 + 5))}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)

    def root(body, block=16, fan=4):
        nodes = [hashlib.sha256(body[k:k + block]).hexdigest() for k in range(0, max(1, len(body)), block)]
        while len(nodes) > 1:
            nodes = [hashlib.sha256("".join(nodes[k:k + fan]).encode()).hexdigest() if len(nodes) > 1 else nodes[0] for k in range(0, len(nodes), fan)]
        return nodes[0]
    files = L.list_files(spark, str(tmp_path))
    got = {r.file_path.rsplit("/", 1)[1]: r.file_hash for r in ranges.content_hashes(files, 16, 4).collect()}
    assert got == {name: root(body) for name, body in bodies.items()}
    plain = {r.file_path.rsplit("/", 1)[1]: r.file_hash for r in ranges.content_hashes(files).collect()}
    assert plain == {name: hashlib.sha256(body).hexdigest() for name, body in bodies.items()}
    assert "content:binary" not in L.entries_for(files, "a", files.limit(0).selectExpr("file_path", "1 row_count", "1 transactions_added"))._jdf.queryExecution().executedPlan().toString()


def test_dispatch_of_mixed_files(spark, tmp_path):
    write(tmp_path / "in" / "a b+c.CSV", "Date,Description,Amount\n2024-01-15,STARBUCKS COFFEE #12,5.50\nsoon,X,1\n")
    write(tmp_path / "in" / "sub" / "b.txt", "2024-01-16 TIM HORTONS #3 -$2.00\n99/99/2024 BAD DAY 3.00\nnot a row\n")
    write(tmp_path / "in" / "c.xlsx", "binary")
    write(tmp_path / "in" / "d.txt", "%PDF-1.4\n2024-01-16 HIDDEN 2.00\n")
    write(tmp_path / "in" / "e.dat", "%PDF-1.4")
    write(tmp_path / "in" / "f.dat", "?")
    write(tmp_path / "in" / "g.csv", "A,B\n1,2\n")
    rows, rejects = I.dispatch_statements(spark, str(tmp_path / "in"), "chq")
    assert sorted((r.date.isoformat(), r.description, r.amount, r.account) for r in rows.collect()) == [
        ("2024-01-15", "starbucks coffee 12", 5.5, "chq"), ("2024-01-16", "TIM HORTONS #3", -2.0, "chq")]
    assert sorted((r.file_path.rsplit("/", 1)[1], r.reason, r.date_text) for r in rejects.collect()) == [
        ("a b+c.CSV", "unreadable date", "soon"), ("b.txt", "unreadable date", "99/99/2024"), ("c.xlsx", "needs a document decoder", None),
        ("d.txt", "needs a document decoder", None), ("e.dat", "needs a document decoder", None), ("f.dat", "unknown file type", None),
        ("g.csv", "no description column", None)]


def test_pipeline_in_batches_of_files(spark, tmp_path):
    from spendlake.plans.pipeline import run_pipeline
    from spendlake.sources import snapshots as SN
    for k in range(5):
        write(tmp_path / "in" / f"jan {k}.csv", f"Date,Description,Amount\n2024-01-1{k},\"SHOP\n{k}\",{k}\n2024-01-20,SAME,1\n")
    paths = dict(target_path=str(tmp_path / "t"), ledger_root=str(tmp_path / "l"), memory_root=str(tmp_path / "m"))
    r = run_pipeline(spark, str(tmp_path / "in"), files_per_batch=2, **paths)
    assert (r.files_processed, r.rows_parsed, r.rows_appended, r.files_failed) == (5, 10, 6, 0)
    assert SN.versions(spark, paths["ledger_root"]) == [1, 2, 3]
    assert sorted(x.transactions_added for x in SN.load_latest(spark, paths["ledger_root"]).collect()) == [1, 1, 1, 1, 2]
    r = run_pipeline(spark, str(tmp_path / "in"), files_per_batch=2, **paths)
    assert (r.files_processed, r.rows_appended) == (0, 0)


def test_two_snapshot_writers_cannot_tear(spark, tmp_path):
    from spendlake.sources import snapshots as SN
    root = str(tmp_path / "snap")
    one, two = spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(2,)], "n int")
    assert SN.load_latest(spark, root) is None
    assert SN.save_next(one, root, base=0) == 1
    with pytest.raises(SN.ConflictError):
        SN.save_next(two, root, base=0)   # both saw no version
    assert [r.n for r in SN.load_latest(spark, root).collect()] == [1]
    tried = []

    def change(latest):
        tried.append(latest.first().n)
        if len(tried) == 1:
            SN.save_next(two, root)        # another writer comes first
        return latest.unionByName(spark.createDataFrame([(9,)], "n int"))
    assert SN.update(spark, root, change) == 3
    assert tried == [1, 2] and sorted(r.n for r in SN.load_latest(spark, root).collect()) == [2, 9]
    one.write.parquet(f"{tmp_path}/old/version=1")  # the older layout
    assert SN.save_next(two, f"{tmp_path}/old") == 2 and SN.load_latest(spark, f"{tmp_path}/old").first().n == 2


def test_memory_load_raises_on_a_damaged_file(spark, tmp_path):
    from spendlake.operators import memory as M
    assert M.load(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        M.load(spark, str(tmp_path / "bad")).collect()
