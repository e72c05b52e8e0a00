import json

from treeline.streaming import events as E

EVENT = "event_id long, path string, sequence long, arrival long, ready boolean"
MESSAGE = "session string, arrival long, kind string, ok boolean"


def _streamed(spark, tmp_path, schema, batches, apply):
    """Each batch is a file and a trigger of its own."""
    names, out = [c.split()[0] for c in schema.split(", ")], []
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        (tmp_path / "in" / f"{i:03d}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = apply(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    return out


def test_events_apply_once_and_in_sequence(spark, tmp_path):
    first = [(1, "a", 2, 1, True), (2, "a", 1, 2, True), (3, "b", 5, 3, False), (4, None, 1, 4, True), (5, "c", None, 5, True), (6, "c", 1, 6, None)]
    again = [(1, "a", 2, 7, True), (3, "b", 5, 8, True), (7, "a", 3, 10, True), (8, "a", 4, 9, True)]
    rows = _streamed(spark, tmp_path, EVENT, [first, again], E.applied_stream)
    got = sorted((r["event_id"], r["outcome"]) for r in rows)
    assert got == [(1, "applied"), (1, "late"), (2, "late"), (3, "applied"), (3, "held"), (4, "applied"), (5, "late"), (6, "held"), (7, "late"), (8, "applied")]


def test_hints_are_coalesced(spark, tmp_path):
    first = [("s", 1, "workspace_changed", None), ("s", 2, "subscribe", True), ("s", 3, "workspace_changed", None), ("s", 4, "rescan_required", None), ("s", 5, "query", False), ("s", 6, "workspace_changed", None), ("t", 7, "workspace_changed", None)]
    later = [("s", 8, "query", True), ("s", 9, "rescan_required", None), ("s", 10, "unsubscribe", True), ("s", 11, "workspace_changed", None), ("s", 12, "subscribe", True), ("s", 13, "shutdown", True), ("s", 14, "workspace_changed", None)]
    rows = _streamed(spark, tmp_path, MESSAGE, [first, later], E.hints)
    assert [tuple(r) for r in rows] == [("s", "workspace_changed", 1, 3), ("s", "rescan_required", 2, 9)]


def test_journal_skips_torn_lines_and_replays(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.ndjson").write_text('{"event_id": 1, "path": "a"}\n{"event_id": 2, "path": "b"}\n{"event_id": 3, "pa')
    events, torn = E.journal(spark, str(tmp_path / "j"), "event_id long, path string", stream=False)
    assert sorted(r["event_id"] for r in events.collect()) == [1, 2]
    assert [r["line"] for r in torn.collect()] == ['{"event_id": 3, "pa']
    at = str(tmp_path / "journal")
    for batch in (events, events, events.unionByName(spark.createDataFrame([(4, "d"), (4, "d"), (None, "n")], "event_id long, path string"))):
        E.append_new(batch, at)
    assert sorted(r["event_id"] for r in spark.read.parquet(at).collect()) == [1, 2, 4]
