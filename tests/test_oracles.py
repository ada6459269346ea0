"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else round(float(value), 5)
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(columns).collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_tables_without_rows_and_with_nulls(spark, bare_tables, name):
    for folder in bare_tables:
        QUERIES[name](spark, folder).collect()
