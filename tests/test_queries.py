"""Every registered query that has SQL, against that SQL, on the smallest tables."""

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


@pytest.mark.parametrize("name", sorted(n for n in SQL if not re.match(r"op\d+_", n)))
def test_query_equals_its_sql(spark, tables, name):
    got = entry.queries()[name](spark, FOLDER)
    want = tables.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    ours = sorted(str([_plain(v) for v in row]) for row in got.select(sorted(names)).collect())
    order = [names.index(c) for c in sorted(names)]
    theirs = sorted(str([_plain(row[i]) for i in order]) for row in want.fetchall())
    assert ours == theirs
