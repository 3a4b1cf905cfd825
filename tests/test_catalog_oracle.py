"""Every catalog query against its DuckDB oracle at sf0.001 (multiset of rows, columns by
name, doubles to 6 places) - the same check the correctness gate runs at sf0.01."""
import duckdb
import pytest

import __spark_entry__ as E
from spendlake.plans import catalog
from tools.check_oracle import TABLES, canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    a, ac = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    b, bc = canon([d[0] for d in cur.description], cur.fetchall())
    assert ac == bc
    assert a == b


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["category", "total", "n_txn", "average", "percent"]
    assert df.count() > 0


def test_messy_statements_over_several_files(spark, con, tmp_path):
    from spendlake.plans import catalog_io
    spark.read.parquet(f"{SF}/orders.parquet").repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    files = spark.read.text(f"{catalog_io._messy_files(spark, str(tmp_path))}/*").selectExpr("_metadata.file_path f").distinct()
    assert files.where("f like '%/shape_3/%'").count() > 1  # files follow the tasks of the write
    for name in ("ingest_csv_messy", "ingest_rejects"):
        df = E.queries()[name](spark, str(tmp_path))
        a, ac = canon(df.columns, [tuple(r) for r in df.collect()])
        cur = con.execute(E.oracle_sql()[name])
        assert (a, ac) == canon([d[0] for d in cur.description], cur.fetchall())
