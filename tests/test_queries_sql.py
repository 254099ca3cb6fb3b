"""Every registered query of the call log against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tests.conftest import SF
from tracewell.plans import catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return v
    if isinstance(v, (float, decimal.Decimal, int)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == names
    assert got == sorted(repr([plain(r[at.index(c)]) for c in names]) for r in cur.fetchall())
