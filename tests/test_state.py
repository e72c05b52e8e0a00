"""Sessions, watches, packages and other state that SQL can't show."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from treeline.operators import closure, index, query, records, seal, transfer, workspace
from treeline.sources import folder, package
from treeline.streaming import session as S


def test_frames_outlive_a_long_one():
    data = b"one\n" + b"x" * 200_000 + b"\nthree\n" + b"y" * 11
    assert list(S.frames(io.BytesIO(data), 10)) == [b"one", None, b"three", None]
    assert list(S.frames(io.BytesIO(b"z" * 10 + b"\n"), 10)) == [b"z" * 10]


def test_sessions_serve_until_the_root_changes():
    root, changes, out = ["a"], S.ChangeQueue(2), io.BytesIO()

    def refresh(arguments):
        changes.offer(["x"])
        return arguments

    def swap(arguments):
        root[0] = "b"

    s = S.Session({"refresh": refresh, "query": swap}, lambda: root[0], changes)
    lines = [{"id": 1, "operation": "subscribe"}, {"id": 2, "operation": "refresh", "arguments": {"k": 1}}, {"id": 3, "operation": "refresh"}, {"id": 4, "operation": "query"}, {"id": 5, "operation": "refresh"}]
    s.serve(io.BytesIO(b"".join(json.dumps(x).encode() + b"\n" for x in lines)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert got[:5] == [{"id": 1, "ok": True, "result": None}, {"id": 2, "ok": True, "result": {"k": 1}}, {"event": "workspace_changed", "sequence": 1}, {"id": 3, "ok": True, "result": {}}, {"event": "workspace_changed", "sequence": 2}]
    assert got[5]["terminal"] and got[5]["error"] == "root_authority_changed" and len(got) == 6 and not s.open


def test_queues_ask_for_a_rescan_when_full():
    q = S.ChangeQueue(2)
    assert [q.offer([str(i)]) for i in range(4)] == [True, True, False, False] and q.drain() == "rescan_required" and q.drain() is None
    assert q.offer(["x"]) and q.drain() == "workspace_changed"
    assert json.loads(S.message({"id": 7, "result": "x" * 100}, 50)) == {"id": 7, "ok": False, "error": "message_too_large"}


def test_failed_requests_leave_a_session(spark):
    def bad(arguments):
        raise query.QueryError("invalid_query_request")

    s = S.Session({"query": bad}, lambda: 1)
    assert s.respond(b'{"id": 1, "operation": "query"}')["error"] == "invalid_query_request" and s.open
    assert s.respond(b"[]")["error"] == s.respond(b'{"id": 1}')["error"] == "invalid_request"


def test_rules_cannot_hide_their_own_file(spark, tmp_path):
    for name in (folder.IGNORE_FILE, "a.md", "sub/b.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("*")
    got = {r["path"]: r["reason"] for r in folder.scan(spark, str(tmp_path), ["*"]).collect()}
    assert got == {folder.IGNORE_FILE: None, "a.md": "capture-ignore-policy", "sub": "capture-ignore-policy"}


def test_fences_see_changes_of_rules_and_root(tmp_path):
    (tmp_path / "x").write_text("1")
    look = lambda: folder.token(str(tmp_path))
    assert seal.fenced(lambda: 5, look) == 5

    def meddle():
        (tmp_path / folder.IGNORE_FILE).write_text("*.tmp")

    with pytest.raises(seal.SealError) as error:
        seal.fenced(meddle, look)
    assert error.value.code == "planning_state_changed"


def test_watching_a_folder(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.md").write_text("1")

    def read():
        stream = folder.watch(spark, str(source)).select("path")
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(str(out)).collect())

    try:
        first = read()
    except Exception as error:  # a source without bounds for one trigger
        pytest.skip(str(error)[:100])
    assert first == ["a.md"]
    (source / "b.md").write_text("2")
    os.utime(source / "b.md", ns=(4 * 10**18, 4 * 10**18))
    assert read() == ["a.md", "b.md"]


def test_packages_detect_spoilt_chunks(spark, tmp_path):
    rows = [("o1", "a", b"x" * 5000), ("o2", "b", b""), ("o3", "c", b"x" * 5000 + b"y"), ("o4", "d", bytes(range(256)) * 40)]
    objects = spark.createDataFrame(rows, "object_id string, path string, content binary")
    package.write_package(objects, str(tmp_path / "p"), (64, 256, 1024))
    held = package.read_package(spark, str(tmp_path / "p"))
    assert package.package_problems(held).count() == 0
    assert {r.path: bytes(r.content) for r in package.rebuilt(held).collect()} == {p: c for _, p, c in rows}
    spoilt = held | {"chunks": held["chunks"].withColumn("data", F.encode(F.lit("z"), "UTF-8"))}
    with pytest.raises(Exception, match="don't make the object"):
        package.rebuilt(spoilt).collect()


def test_an_index_is_kept_while_a_larger_one_fails(spark, tmp_path):
    rows = query.live_rows(spark.createDataFrame([("a", "regular_file", 1, False, None), ("b", "directory", None, None, None)], "path string, kind string, bytes long, executable boolean, symlink_target string"))
    none = spark.createDataFrame([], "path string, reason string, kind string")
    at = str(tmp_path / "index")
    assert index.rebuild(rows, none, at, "g1") == {"records": 2, "exclusions": 0}
    with pytest.raises(ValueError):
        index.rebuild(rows, none, at, "g2", most=1)
    assert index.status(spark, at, "g1")["state"] == "fresh" and index.status(spark, at, "g2")["state"] == "stale"
    (tmp_path / "index/current.json").write_text("{")
    assert index.status(spark, at, "g1")["state"] == "stale" and index.read(spark, at, "g1") is None


def test_sealing_refuses_what_it_cannot_tell(spark):
    live = "path string, kind string, bytes long, executable boolean, target string, content_sha256 string, physical_identity string"
    prior = {
        "bindings": spark.createDataFrame([(p, "regular_file", 1, False, None, "s", "i", f"obj_{p}", f"version_{p}") for p in "ab"], live + ", object_id string, object_version_id string"),
        "tombstones": spark.createDataFrame([], "path string, object_id string, deleted_kind string, last_object_version_id string"), "exclusions": spark.createDataFrame([], "path string, kind string, reason string"),
    }
    mint = lambda prefix, text: F.concat(F.lit(f"{prefix}_"), text)
    none = spark.createDataFrame([], "path string")
    new = lambda *rows: spark.createDataFrame([(p, "regular_file", 1, False, None, s, i) for p, s, i in rows], live)
    with pytest.raises(seal.SealError) as error:
        seal.sealed(new(("c", "s", "i")), prior["exclusions"], none, prior, mint)
    assert error.value.code == "ambiguous_identity"
    out = seal.sealed(new(("a", "s", "i"), ("b", "t", "i")), prior["exclusions"], none, prior, mint)
    assert sorted((r.path, r.object_id, r.object_version_id) for r in out["bindings"].collect()) == [("a", "obj_a", "version_a"), ("b", "obj_b", "version_obj_b/t")] and out["tombstones"].count() == 0
    assert seal.sealed(new(("a", "s", "i"), ("b", "s", "i")), prior["exclusions"], none, prior, mint) is None


def test_texts_and_files_at_their_bounds(spark):
    files = spark.createDataFrame([("a", b"x" * 10), ("b", b"x" * 11), ("c", None), ("d", b"")], "path string, content binary")
    assert {r.path: (r.text, r.problem) for r in workspace.read_texts(files, 10).collect()} == {"a": ("x" * 10, None), "b": (None, "too_large"), "c": (None, None), "d": ("", None)}
    edits = spark.createDataFrame([("a", None, "y"), ("z", "q", "y")], "path string, expected_sha256 string, text string")
    after, outcome = workspace.saved_texts(files, edits)
    assert {r.path: r.outcome for r in outcome.collect()} == {"a": "conflict", "z": "missing"} and after.count() == 4


def test_records_of_odd_json(spark):
    rows = [("a", None), ("b", ""), ("c", '{"id":5,"lifecycle":[],"provenance":{"created_at":7}}'), ("d", "null")]
    got = {}
    for r in records.object_findings(spark.createDataFrame(rows, "path string, json string")).collect():
        got.setdefault(r.path, set()).add(r.code)
    assert got["a"] == got["b"] == {"object_json_invalid"} and got["d"] == {"object_not_object"}
    assert {"invalid_object_id", "invalid_object_type", "invalid_object_lifecycle", "invalid_object_created_at", "invalid_object_source", "missing_object_path"} == got["c"]


def test_resumed_transfers_of_nothing(spark):
    m = spark.createDataFrame([("o", 0, 5, "s")], "object_id string, index long, bytes long, sha256 string")
    a = spark.createDataFrame([], "object_id string, index long, bytes long, sha256 string, arrival long")
    assert transfer.accepted_chunks(m, a).count() == 0
    assert closure.coverage(m, m, ["object_id"]).count() == 0
