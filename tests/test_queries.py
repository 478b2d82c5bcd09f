"""Every query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

NAMES = sorted(n for n in __spark_entry__.oracle_sql())


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(tidy(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, db, name):
    df = __spark_entry__.queries()[name](spark, sf)
    want = db.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", ["merged_evidence", "evidence_found_again"])
def test_finds_of_one_place_and_of_none_equal_sql(spark, tmp_path, name):
    """Lines of many parts at one place, and lines without a number, an order, a part or a flag."""
    lines = [(n % 4 if n % 11 else None, n % 23 if n % 13 else None, 1 + n % 3 if n % 7 else None, "ANRa"[n % 5] if n % 5 < 4 else None) for n in range(600)]
    table = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = con.execute(__spark_entry__.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
