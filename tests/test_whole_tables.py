"""Queries hold every row of their tables: figures are counted here, from the rows, as the SQL could share a cut."""

import duckdb

import __spark_entry__ as entry


def test_an_index_holds_every_row(spark, tmp_path):
    some = "SELECT i AS doc_id, 't' || i AS text, CASE WHEN i % 7 <> 4 THEN ['de', 'en', 'fr'][1 + i % 3] END AS lang, CASE WHEN i % 11 <> 5 THEN 'src' || i % 20 END AS source, 9::BIGINT AS n_chars"
    con = duckdb.connect()
    con.execute(f"COPY ({some} FROM range(2000) t(i)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    rows = con.execute("SELECT doc_id, source, lang FROM documents").fetchall()
    placed = [(source, lang) for _, source, lang in rows if source and lang]
    records = len(placed) + len({source for source, _ in placed}) + len(set(placed))
    exclusions = sum(source is not None and (i % 31 == 9 or i % 31 == 6 and i % 10 != 7) for i, source, _ in rows)
    want = [("before", "absent", 0, True, exclusions), ("later", "stale", records, True, exclusions), ("rebuilt", "fresh", records, True, exclusions), ("spoilt", "stale", records, True, exclusions)]
    got = entry.queries()["index_states"](spark, str(tmp_path)).select("step", "state", "records", "whole", "exclusions")
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(con.execute(f"SELECT step, state, records, whole, exclusions FROM ({entry.oracle_sql()['index_states']})").fetchall()) == want
