import hashlib
from functools import reduce

import pytest
from pyspark.sql import functions as F

from treeline.functions import chunking, classify, ignore, paths
from treeline.operators import access, change_set, diff, query, seal, sync

ENTRY = "path string, kind string, bytes long, executable boolean, symlink_target string"


def _live(spark):
    rows = [("oak", "directory", None, None, None), ("oak/bark.bin", "regular_file", 310, False, None), ("oak/leaf.txt", "regular_file", 70, False, None), ("oakum.txt", "regular_file", 400, False, None), ("pine.txt", "regular_file", 95, False, None)]
    return query.live_rows(spark.createDataFrame(rows, ENTRY))


def _paths(df):
    return [r.path for r in df.collect()]


def test_filter_algebra(spark):
    rows = _live(spark)
    request = query.Request(paths=("oak/bark.bin", "oakum.txt"), path_prefixes=("oak",), kinds=("regular_file",), lifecycles=("live",), minimum_bytes=100, maximum_bytes=400)
    assert _paths(query.filtered(rows, request)) == ["oak/bark.bin"]
    assert sorted(_paths(query.filtered(rows, query.Request(path_prefixes=("oak",))))) == ["oak", "oak/bark.bin", "oak/leaf.txt"]
    assert query.filtered(rows, query.Request(lifecycles=("deleted",))).count() == 0


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 1001}, {"kinds": ("table",)}, {"minimum_bytes": -1}, {"minimum_bytes": 9, "maximum_bytes": 3}, {"path_prefixes": ("../outside",)}, {"paths": ("Pine.txt", "pine.txt")}, {"paths": ("con",)}, {"paths": ("a\x1f",)}, {"object_ids": ("obj_1",)}])
def test_request_bounds(bad):
    with pytest.raises(query.QueryError):
        query.normalized(query.Request(**bad))


def test_pages_join_up_and_cursors_bind(spark):
    rows, none = _live(spark), spark.createDataFrame([], "path string, reason string, kind string")
    whole = [r.path for r in query.ordered(rows).collect()]
    for limit in (1, 2, 5):
        got, cursor = [], None
        while True:
            page = query.run(rows, none, query.Request(limit=limit, cursor=cursor), "g", "d")
            got += [e["path"] for e in page["entries"]]
            cursor = page["next_cursor"]
            if not page["has_more"]:
                break
        assert got == whole
    cursor = query.run(rows, none, query.Request(limit=1), "g", "d")["next_cursor"]
    for generation, digest, code in (("other", "d", "query_snapshot_changed"), ("g", "other", "invalid_query_cursor")):
        with pytest.raises(query.QueryError) as error:
            query.run(rows, none, query.Request(limit=1, cursor=cursor), generation, digest)
        assert error.value.code == code


def test_ignore_rules(spark):
    rules = ["*.tmp", "build/", "generated/**", "/root-only.txt", "logs/[0-9].log", "classes/[!a-c].txt", r"\!literal.txt", r"\#literal.txt", "!generated/keep/", "!generated/keep/**", "generated/keep/reignored.txt", r"literal-space\ ", "trimmed-space   ", "/anchored.txt", "docs/**/draft[0-9].md", "!docs/**/draft[5-7].md", "!build/child.txt"]
    cases = [("a/x.tmp", False, True), ("build", True, True), ("build", False, False), ("build/child.txt", False, False), ("generated/a", False, True), ("generated/keep/a", False, False), ("generated/keep/reignored.txt", False, True), ("root-only.txt", False, True), ("a/root-only.txt", False, False), ("logs/7.log", False, True), ("logs/x.log", False, False), ("classes/d.txt", False, True), ("classes/a.txt", False, False), ("!literal.txt", False, True), ("#literal.txt", False, True), ("literal-space ", False, True), ("trimmed-space", False, True), ("anchored.txt", False, True), ("docs/a/b/draft3.md", False, True), ("docs/draft6.md", False, False)]
    df = spark.createDataFrame(cases, "path string, directory boolean, want boolean")
    assert df.withColumn("got", ignore.ignored(F.col("path"), F.col("directory"), rules)).where("got <> want").collect() == []
    tree = spark.createDataFrame([("build", "directory"), ("build/child.txt", "regular_file"), ("a", "regular_file")], "path string, kind string")
    assert sorted(_paths(ignore.pruned(tree, rules))) == ["a", "build"]


def test_diff_scenario(spark):
    binding = "path string, object_id string, kind string, object_version_id string, content_sha256 string"
    row = lambda p, o, v: (p, o, "regular_file", v, v)
    old = {"bindings": spark.createDataFrame([row("a.md", "o1", "v1"), row("delete.md", "o2", "v2"), row("move.md", "o3", "v3"), row("stable", "o4", "v4")], binding)}
    new = {"bindings": spark.createDataFrame([row("a.md", "o5", "v5"), row("moved.md", "o3", "v6"), row("stable", "o4", "v4")], binding)}
    stones = "path string, object_id string, deleted_kind string, last_object_version_id string"
    old["tombstones"] = spark.createDataFrame([], stones)
    new["tombstones"] = spark.createDataFrame([("a.md", "o1", "regular_file", "v1"), ("delete.md", "o2", "regular_file", "v2"), ("move.md", "o3", "regular_file", "v3")], stones)
    old["exclusions"] = spark.createDataFrame([("hard", "hard_link", "r")], "path string, kind string, reason string")
    new["exclusions"] = spark.createDataFrame([("nested", "nested_root", "r")], "path string, kind string, reason string")
    got = [(r.change_type, r.sort_path) for r in diff.in_order(diff.diff(old, new)).collect()]
    assert got == [("recreated", "a.md"), ("tombstone_added", "a.md"), ("deleted", "delete.md"), ("tombstone_added", "delete.md"), ("exclusion_removed", "hard"), ("moved", "move.md"), ("tombstone_added", "move.md"), ("updated", "moved.md"), ("exclusion_added", "nested")]


def test_one_conflict_of_each_code(spark):
    state = "struct<path:string,kind:string,content_sha256:string,bytes:long,executable:boolean,target:string>"
    s = lambda p, c="c": (p, "regular_file", c, 1, False, None)
    cases = {
        "nested_boundary": (None, s("nest/x")), "create_create": (None, s("here")), "path_alias": (None, s("HERE2")), "edit_edit": (s("edited"), s("edited", "n")), "move_edit": (s("edited"), s("to")),
        "delete_edit": (s("edited"), None), "path_occupied": (s("same"), s("here")), "edit_delete": (s("gone"), s("gone", "n")), "clean": (s("gone"), None),
    }
    deltas = spark.createDataFrame([(k, *v) for k, v in cases.items()], f"object_id string, before {state}, after {state}")
    current = spark.createDataFrame([s("here"), s("here2"), s("edited", "z"), s("same")], "path string, kind string, content_sha256 string, bytes long, executable boolean, target string")
    found = change_set.conflicts(deltas, current, spark.createDataFrame([("nest",)], "path string")).collect()
    assert {r.object_id: r.code for r in found} == {k: k for k in cases if k != "clean"}


def test_events_and_cycles(spark):
    rows = [(2, "p", 2, 1), (1, "p", 1, 2), (2, "p", 2, 3), (3, "q", 1, 4)]
    got = sync.applied_events(spark.createDataFrame(rows, "event_id long, path string, sequence long, arrival long")).orderBy("arrival").collect()
    assert [r.applied for r in got] == [True, False, False, True]
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (4, 5), (6, 5)], "child long, parent long")
    assert {r.node for r in seal.cyclic(edges).collect()} >= {4, 5} and 3 not in {r.node for r in seal.cyclic(edges).collect()}


def test_grants(spark):
    grants = spark.createDataFrame([("g1", "r", "m", "folder", "docs", None, ["read"], 9, None), ("g2", "r", "x", "root", None, None, ["read"], 1, None)], "grant_id string, root_id string, member_id string, scope_type string, scope_path string, scope_paths array<string>, permissions array<string>, expires_at int, revoked_at int")
    requests = spark.createDataFrame([(1, "r", "own", "a", "read", 1), (2, "r", "m", "docs/a", "read", 1), (3, "r", "m", "docs/a", "edit", 1), (4, "r", "m", "docs2", "read", 1), (5, "r", "m", "docs", "read", 9), (6, "r", "no", "a", "read", 1), (7, "r", "x", "a", "read", 1)], "request_id int, root_id string, member_id string, path string, permission string, at int")
    roots = spark.createDataFrame([("r", "own")], "root_id string, owner_id string")
    got = {r.request_id: r.reason for r in access.authorized(requests, grants, roots).collect()}
    assert got == {1: "owner", 2: "explicit_grant", 3: "permission_missing", 4: "outside_scope", 5: "expired", 6: "no_grant", 7: "expired"}


def test_chunks_cover_objects_and_paths(spark):
    data = bytes(hashlib.sha256(str(i).encode()).digest()[0] for i in range(5000))
    ends, none = chunking.cuts([data, b""], 64, 256, 512)
    many = [data[i:] for i in range(40)] + [b"", b"x"]
    assert chunking.cuts(many, 64, 256, 512) == [chunking.cuts([x], 64, 256, 512)[0] for x in many]
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == 5000 and max(sizes) <= 512 and min(sizes[:-1]) >= 64 and none == []
    cases = [("a/b", True), ("a//b", False), ("/a", False), ("a/../b", False), ("con", False), ("com1.txt", False), ("x.", False), ("é/ü", True), ("", False), ("a:b", False), ("a\x7fb", True), ("a\n", False), ("COM¹.x", False), ("cone", True), ("a/nul ", False), (".TREELINE/x", False)]
    df = spark.createDataFrame(cases, "path string, want boolean")
    assert df.where(paths.path_valid(F.col("path")) != F.col("want")).collect() == [] and [paths.portable(p) for p, _ in cases] == [w for _, w in cases]
    links = spark.createDataFrame([("a/l", "../b", True), ("a/l", "../../b", False), ("l", "./x", True), ("l", "/x", False)], "l string, t string, want boolean")
    assert links.where(paths.symlink_valid(F.col("l"), F.col("t")) != F.col("want")).collect() == []
    versions = spark.createDataFrame([("plan v2.docx", True), ("x().txt", True), ("finalist.txt", False), ("copy3.md", True)], "path string, want boolean")
    assert versions.where(classify.is_versioned(F.col("path")) != F.col("want")).collect() == []


def test_queries_and_sql_agree_on_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and reduce(lambda a, b: a and b, map(str.islower, map(str, entry.oracle_sql())))


def test_values_end_where_they_end(spark):
    uuid = "019f0000-0000-7000-8000-000000000001"
    cases = [(f"obj_{uuid}", "a" * 64, "2024-02-29T12:00:00Z", True), (f"obj_{uuid}\n", "a" * 64 + "\n", "2024-02-29T12:00:00Z\n", False), (f"\nobj_{uuid}", "\n" + "a" * 64, "\n2024-02-29T12:00:00Z", False)]
    df = spark.createDataFrame(cases, "id string, sha string, at string, want boolean")
    for test in (paths.id_valid(F.col("id"), "obj"), paths.sha256_valid(F.col("sha")), paths.timestamp_valid(F.col("at"))):
        assert df.where(test != F.col("want")).collect() == []


def test_publications_are_one_sequence(spark):
    rows = [(i, "ab"[i % 2], f"l{i % 3}", "r") for i in range(40)]
    got = sync.published(spark.createDataFrame(rows, "arrival long, path string, local_digest string, remote_digest string").repartition(5), 10).collect()
    assert {r.arrival: r.publication for r in got} == {i: i + 11 for i in range(40)}
    conflicts = spark.createDataFrame(rows, "arrival long, path string, local_digest string, remote_digest string")
    kept = sync.report_order(sync.distinct_conflicts(conflicts)).collect()
    assert [(r.path, r.local_digest, r.arrival) for r in kept] == [("a", "l0", 0), ("a", "l1", 4), ("a", "l2", 2), ("b", "l0", 3), ("b", "l1", 1), ("b", "l2", 5)]


def test_templates_fill_in_one_pass(spark):
    from treeline.operators import closure

    texts = spark.createDataFrame([("a ${x} and ${y}!",), ("${z}",), ("plain",), ("${x",), ("${x}${x}",)], "t string")
    got = [r[0] for r in texts.select(closure.rendered(F.col("t"), {"x": "${y}", "y": "Y"})).collect()]
    assert got == ["a ${y} and Y!", None, "plain", None, "${y}${y}"]


def test_refused_charges_leave_the_ledger(spark):
    rows = [("a", 1, 6, 1), ("a", 2, 6, 1), ("a", 3, 4, 1), ("a", 4, 1, 1), ("b", 1, 0, 9), ("b", 2, 10, 1), ("b", 3, 1, 0)]
    got = access.budget_charges(spark.createDataFrame(rows, "ledger string, at int, tokens long, cost long"), {"tokens": 10, "cost": 8}).collect()
    assert {(r.ledger, r.at): r.accepted for r in got} == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("a", 4): False, ("b", 1): False, ("b", 2): True, ("b", 3): False}


def test_order_over_ranges(spark):
    from treeline.operators import checks

    rows = [(i, f"k{i:04d}") for i in range(500)]
    frame = lambda r: spark.createDataFrame(r, "at int, key string").repartition(6)
    assert checks.out_of_order(frame(rows), "key", "at").count() == 0
    rows[250], rows[251] = (250, rows[251][1]), (251, rows[250][1])
    rows[400] = (400, rows[399][1])
    assert sorted(r.at for r in checks.out_of_order(frame(rows), "key", "at").collect()) == [251, 400]


def test_manifest_changes_and_roots(spark):
    facts = "object_version_id string, content_sha256 string, bytes long"
    sides = [{"bindings": spark.createDataFrame([], "path string, object_id string, kind string, object_version_id string, content_sha256 string"), "manifest": spark.createDataFrame([(v, v, 1)], facts), "root_id": "r"} for v in ("v1", "v1", "v2")]
    assert diff.diff(sides[0], sides[1]).count() == 0
    assert [(r.change_type, r.previous_object_version_id, r.object_version_id, r.rank) for r in diff.diff(sides[0], sides[2]).collect()] == [("manifest_updated", "v1", "v2", 0)]
    with pytest.raises(ValueError):
        diff.diff(sides[0], sides[2] | {"root_id": "other"})
