"""Every query against the SQL that states the same result."""

import glob
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(cols).collect())
    if name not in ORACLES:
        assert rows
        return
    cur = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({ORACLES[name]}) q")
    expected = sorted(repr(tuple(plain(v) for v in r)) for r in cur.fetchall())
    assert rows == expected
    for c, d in zip(cols, cur.description):
        spark_type = df.schema[c].dataType.simpleString()
        assert TYPES.get(spark_type, spark_type) == str(d[1]), c


def test_entry(spark):
    assert entry(spark).count() == 2
