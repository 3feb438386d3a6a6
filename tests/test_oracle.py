"""Every query of the library against its SQL, on the given tables."""

import glob
import math
import os

import duckdb
import pytest

from pingmill.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    return f"{float(v) + 0.0:.6f}"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, DATA)
    result = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in result.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
