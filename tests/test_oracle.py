"""Every query that has SQL must give the SQL's rows on the smallest tables."""

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

ORACLE, QUERIES = entry.oracle_sql(), entry.queries()


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(repr([norm(r[c]) for c in cols]) for r in df.collect())
    res = db.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    want = Counter(repr([norm(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert sorted(names) == cols
    assert got == want


RUNS = sorted(set(QUERIES) - set(ORACLE))
#: Facts of which the tables hold none.
NONE_THERE = {"code_protocols", "code_supervisors", "code_children", "code_tables", "code_callbacks", "free_variables"}


@pytest.mark.parametrize("name", RUNS)
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and (df.count() > 0 or name in NONE_THERE)
    assert len(set(df.columns)) == len(df.columns)
