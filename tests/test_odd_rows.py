"""Queries against their SQL on documents that lack a text, a language or a source."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    lacks = lambda name, k: f"CASE WHEN i % 7 = {k} AND i % 50 <> 9 THEN NULL ELSE {name} END"
    some = f"SELECT i AS doc_id, {lacks("'t' || i", 3)} AS text, {lacks("CASE WHEN i % 9 < 4 THEN 'de' ELSE 'en' END", 4)} AS lang, {lacks("'src' || i % 2", 5)} AS source, 9::BIGINT AS n_chars"
    duckdb.execute(f"COPY ({some} FROM range(1000) t(i)) TO '{at}/documents.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["broken_version_findings", "findings_in_order"])
def test_rows_that_lack_a_value(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = entry.queries()[name](spark, folder)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert any(row[names.index("path")] is None for row in want)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want))
