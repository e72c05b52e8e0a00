"""Queries against their SQL on more rows than one record of the format holds."""

import duckdb
import pytest

import __spark_entry__ as entry
from treeline import model as M
from treeline.operators import change_set, checks
from treeline.sources import relations as R


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    some = "SELECT i AS doc_id, 't' || i AS text, CASE WHEN i % 9 < 4 THEN 'de' ELSE 'en' END AS lang, 'src' || i % 2 AS source, octet_length(encode('t' || i))::BIGINT AS n_chars"
    duckdb.execute(f"COPY ({some} FROM range({2 * M.MAX_ENTRIES}) t(i)) TO '{at}/documents.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["index_rows", "index_states", "broken_version_findings", "envelope_findings", "findings_in_order", "version_findings"])
def test_no_bound_cuts_a_query(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = entry.queries()[name](spark, folder)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want))


def test_a_version_beyond_its_bound_is_found(spark):
    v = R.new_version(spark, "/root/testdata/sf0.001")
    n = sum(rows.count() for rows in v.values())
    codes = lambda **most: [r.code for r in checks.version_findings(v["bindings"], v["tombstones"], v["exclusions"], **most).collect()]
    assert codes(most=n - 1) == ["too_many_entries"] and codes(most=n) == codes(most=None) == codes() == []


def test_a_change_set_is_not_empty_nor_beyond_its_bound(spark):
    rows = spark.createDataFrame([("o1", None, ("a", "s")), ("o2", None, ("b", "s"))], "object_id string, before struct<path string, sha string>, after struct<path string, sha string>")
    codes = lambda rows, **most: [r.code for r in change_set.envelope_findings(rows, **most).collect()]
    assert codes(rows, most=1) == ["delta_count"] and codes(rows, most=2) == codes(rows, most=None) == codes(rows) == []
    assert codes(rows.limit(0)) == ["delta_count"] and codes(rows.limit(0), most=None) == []
