"""Every registered query with SQL against DuckDB."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from quillgraph import plans

D = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(plans.ORACLES))
def test_against_sql(spark, con, name):
    cursor = con.execute(plans.ORACLES[name])
    names = [c[0] for c in cursor.description]
    df = plans.QUERIES[name](spark, D)
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(plain(r[n]) for n in names) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    plans.QUERIES[name](spark, D).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1 and set(entry.oracle_sql()) <= set(entry.queries())
