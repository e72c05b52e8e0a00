"""Registered queries of stores, journals, packages, sessions and streams, with their DuckDB SQL."""

from __future__ import annotations

import io
import json
import uuid

from pyspark.sql import functions as F

from .. import model as M
from ..functions import digest, values as V
from ..operators import change_set, closure, inventory, query, seal, sync
from ..sources import package, relations as R, store
from ..streaming import events as E
from ..streaming import session as S
from . import oracle as O
from .queries import _deltas, _historical, _live, _named, _source, events, version_diff
from .staging import shared_folder
from .validation import _CONFLICTS, _placed


def _folder(spark, name):
    return f"{shared_folder(spark)}/treeline-{name}-{uuid.uuid4().hex}"


def blobs_installed(spark, d):
    """Contents of all texts in the store after two overlapping writes: each once."""
    folder, n = _folder(spark, "blobs"), F.col("doc_id")
    docs = R.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    for part in (docs.where(n % 3 != 0), docs.where(n % 2 == 0), docs):
        store.install_blobs(part, folder)
    return spark.read.parquet(folder).select("sha256", F.octet_length("content").cast("long").alias("bytes"))


def journal_appended(spark, d):
    """Events of a journal after batches that overlap and repeat: each once."""
    folder, n = _folder(spark, "journal"), F.col("event_id")
    e = R.table(spark, d, "events").select("event_id", "event_type")
    for part in (e.where(n % 4 != 1), e.where(n % 4 != 2), e.where(n % 4 == 2).unionByName(e.where(n % 8 == 2))):
        E.append_new(part, folder)
    return spark.read.parquet(folder).select("event_id", "event_type")


def journal_repaired(spark, d):
    """How many lines of a journal with torn ones are kept and set aside."""
    folder, n = _folder(spark, "lines"), F.col("event_id")
    line = F.when(n % 10 == 3, F.concat(F.lit('{"event_id":'), n.cast("string"))).when(n % 10 == 4, "").otherwise(F.concat(F.lit('{"event_id":'), n.cast("string"), F.lit("}")))
    R.table(spark, d, "events").select(line.alias("value")).write.text(folder)
    counts = E.repaired_journal(spark, folder, "event_id long", f"{folder}-whole", f"{folder}-torn")
    return spark.createDataFrame([counts], "whole long, torn long")


def version_installed(spark, d):
    """A version is written, read back and made current; the second writer and a stale one are refused."""
    folder = _folder(spark, "versions")
    v = {k: x.withColumn("version_id", F.lit("v1")) for k, x in R.new_version(spark, d).items()}
    headers = spark.createDataFrame([("v1", "1.0", "root", [], "2026-01-01T00:00:00Z")], "version_id string, protocol string, root_id string, parents array<string>, created_at string")
    store.install_version({"headers": headers, **v}, folder, "v1")
    rows = [("first", store.swap_head(spark, f"{folder}/head", None, "v1"))]
    for name, expected in (("again", None), ("stale", "v0")):
        try:
            rows.append((name, store.swap_head(spark, f"{folder}/head", expected, "v2")))
        except store.Conflict:
            rows.append((name, -1))
    rows.append(("next", store.swap_head(spark, f"{folder}/head", "v1", "v2")))
    n = store.read_version(spark, folder, "v1")["bindings"].count()
    return spark.createDataFrame([(name, g, store.head(spark, f"{folder}/head")[1], n) for name, g in rows], "step string, generation long, current string, bindings long")


def tombstone_restored(spark, d):
    v = R.new_version(spark, d)
    t = v["tombstones"].where("path like 'old/%'").orderBy("path").first()
    bindings, stones = seal.restored(v["bindings"], v["tombstones"], t["path"], t["object_id"])
    return bindings.select("path", "object_id", F.lit("live").alias("state")).unionByName(stones.select("path", "object_id", F.lit("deleted").alias("state")))


def paged_by_cursor(spark, d):
    """The second page, reached by the first one's cursor."""
    rows, none = _historical(spark, d), spark.createDataFrame([], "path string, reason string, kind string")
    first = query.run(rows, none, query.Request(limit=30), "g", "r")
    second = query.run(rows, none, query.Request(limit=30, cursor=first["next_cursor"]), "g", "r")
    return spark.createDataFrame([tuple(e[c] for c in M.QUERY_COLUMNS) for e in second["entries"]], M.QUERY_ROW)


def explained_query(spark, d):
    out = query.explain(_live(spark, d), query.Request(path_prefixes=("src1", "src7/en"), kinds=("regular_file",), limit=7))
    return spark.createDataFrame([(out["ordering"], out["algebra"], out["strategy"], list(out["request"].path_prefixes), out["request"].limit, out["matched"])], "ordering string, algebra string, strategy string, prefixes array<string>, page long, matched long")


def observation_digest(spark, d):
    return query.ordered_digest(R.entries(spark, d).select("path", "kind", "bytes"), R.new_version(spark, d)["exclusions"].select("path", "kind", "reason"))


def domain_digests(spark, d):
    value = {"b": [1, "x"], "a": None}
    return spark.createDataFrame([(n, query.domain_digest(n, value), V.canonical_digest(value)) for n in ("cursor-v1", "plan-v1", "projection-v1")], "domain string, sha256 string, plain string")


def inspection_report(spark, d):
    return inventory.report(_named(spark, d))


def classes_in_order(spark, d):
    return _placed(inventory.classified(_named(spark, d)).select("path", "rank"), "path", "rank")


def inventory_budgets(spark, d):
    return inventory.budget_findings(R.entries(spark, d), 500, 2, 1000)


def initialisation_actions(spark, d):
    f, n = R.files(spark, d), F.col("doc_id")
    here = f.where(n % 4 != 0).select(F.when(n % 6 == 1, F.upper("path")).otherwise(F.col("path")).alias("path"), F.when(n % 10 == 3, M.DIRECTORY).otherwise(F.col("kind")).alias("kind"))
    return closure.initialisation(f.select("path", "kind"), here)


def versions_decoded(spark, d):
    n = F.col("conv_id")
    entry = F.concat_ws(",", F.array_repeat(F.lit('{"path":"a"}'), (n % 6).cast("int")))
    own = F.concat(F.lit("v"), n.cast("string"))
    body = F.concat(F.lit('{"version_id":"'), F.when(n % 7 == 3, "other").otherwise(own), F.lit('","root_id":"r","parents":["p"],"bindings":['), entry, F.lit("]}"))
    body = F.when(n % 11 == 5, "{").when(n % 13 == 6, F.concat(body, F.lpad(F.lit(""), 200, " "))).otherwise(body)
    t = R.table(spark, d, "conversations").select("conv_id").distinct().select(own.alias("version_id"), body.alias("json"))
    return closure.decoded_versions(t, 200, 4)


def _package(spark, d):
    n = F.col("doc_id")
    return R.table(spark, d, "documents").select(R.made_id("obj", n).alias("object_id"), F.concat("source", F.lit("/"), n.cast("string")).alias("path"), F.encode(F.when(n % 50 != 7, F.col("text")).otherwise(""), "UTF-8").alias("content"))


def package_rebuilt(spark, d):
    folder = _folder(spark, "package")
    package.write_package(_package(spark, d), folder, (256, 1024, 4096))
    return package.rebuilt(package.read_package(spark, folder)).select("path", F.sha2("content", 256).alias("sha256"))


def package_losses(spark, d):
    """What is found in a package without the chunks of two objects and with a wrong size."""
    folder = _folder(spark, "package")
    package.write_package(_package(spark, d).where("path like 'src1/%'"), folder, (256, 1024, 4096))
    held = package.read_package(spark, folder)
    lost = held["manifests"].where("object_id like '%21'").select("sha256")
    held |= {"chunks": held["chunks"].join(lost, "sha256", "left_anti"), "index": held["index"].withColumn("bytes", F.when(F.col("path") == "src1/41", F.col("bytes") + 1).otherwise(F.col("bytes")))}
    return package.package_problems(held).groupBy("problem").agg(F.min("key").alias("first")).where("problem = 'bytes'").unionByName(package.package_problems(held).where("problem = 'missing'").join(lost.withColumnRenamed("sha256", "key"), "key", "left_anti").groupBy("problem").agg(F.min("key").alias("first")))


def application_history(spark, d):
    """Records appended one after the other; a fork and a used id are refused."""
    folder = _folder(spark, "applications")
    rows = []
    for step, (key, after) in enumerate((("r1", None), ("r2", "r1"), ("r2", "r1"), ("r1", "r2"), ("r3", "r2"))):
        try:
            rows.append((step, store.append_application(spark, folder, key, after, "t", f"1.0.{step}")))
        except store.Conflict:
            rows.append((step, -1))
    kept = store.applications(spark, folder).select("number", "record_id", "predecessor", "version")
    return spark.createDataFrame(rows, "step long, outcome long").join(kept, F.col("outcome") == F.col("number"), "left")


def reorganisation_drafts(spark, d):
    p, n = R.table(spark, d, "part"), F.col("p_partkey")
    key = (n % 60).alias("draft_id")
    drafts = p.where("p_partkey < 60").select(key, F.lit("s").alias("scope"))
    questions = p.where("p_partkey < 120").select(key, F.when(n % 60 == 5, "q").otherwise(n.cast("string")).alias("question_id"), (n % 2 == 0).alias("required"))
    given = p.where("p_partkey < 120 and p_partkey % 60 not in (8, 9)").select(key, F.when(n % 60 == 5, "q").otherwise(n.cast("string")).alias("question_id"))
    path = F.when(n == 71, "out/x").when(n.isin(72, 132), F.concat(F.lit("s/"), F.when(n == 72, "A").otherwise("a"))).otherwise(F.concat(F.lit("s/f"), n.cast("string")))
    operations = p.where("p_partkey < 180 and p_partkey % 60 <> 3").select(key, path.alias("path"))
    operations = operations.unionByName(operations.where("draft_id = 4").select("draft_id", F.concat("path", F.lit("x")).alias("path")))
    return closure.draft_findings(drafts, questions, given, operations, 5)


def publications(spark, d):
    e, n = events(spark, d), F.col("event_id")
    return sync.published(e.select("event_id", "path", (F.col("arrival") * 100_000 + n).alias("arrival")), 1000).select("event_id", "publication")


def sync_conflicts(spark, d):
    n = F.col("event_id")
    c = R.table(spark, d, "events").select((n % 40).cast("string").alias("path"), (n % 3).cast("string").alias("local_digest"), (n % 2).cast("string").alias("remote_digest"), n.alias("arrival"))
    return _placed(sync.distinct_conflicts(c), "path", "local_digest", "remote_digest")


def applied_once(spark, d):
    """A change set is applied, then answered from its digest, and refused while there are conflicts."""
    base, changes = R.files(spark, d), _deltas(spark, d)
    none, known = changes.limit(0).select("object_id"), spark.createDataFrame([("d1",)], "change_set_sha256 string")
    real = change_set.conflicts(changes, _source(spark, d), spark.createDataFrame([], "path string"))
    rows = []
    for name, found, digest_ in (("new", none, "d2"), ("replayed", none, "d1"), ("conflicting", real, "d3")):
        outcome, after = change_set.applied_once(base, changes, found, known, digest_)
        rows.append((name, outcome, after.count() if name != "new" else after.select("object_id").distinct().count()))
    return spark.createDataFrame(rows, "attempt string, outcome string, objects long")


def _stream(spark, frame, run, name):
    """run(stream of `frame`) read in one trigger into a table."""
    source, out = _folder(spark, f"{name}-in"), _folder(spark, f"{name}-out")
    frame.write.parquet(source)
    stream = run(spark.readStream.schema(frame.schema).parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def streamed_events(spark, d):
    n = F.col("event_id")
    e = events(spark, d).select("event_id", "path", F.when(n % 50 != 9, F.col("sequence")).alias("sequence"), (F.col("arrival") * 100_000 + n).alias("arrival"), (n % 6 != 5).alias("ready"))
    return _stream(spark, e, E.applied_stream, "events").select("event_id", "sequence", "outcome")


def streamed_hints(spark, d):
    n = F.col("event_id")
    kind = F.when(n % 11 == 0, "subscribe").when(n % 29 == 1, "unsubscribe").when(n % 5 == 2, "query").when(n % 13 == 3, "rescan_required").when(n % 211 == 4, "shutdown").otherwise("workspace_changed")
    m = R.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), n.alias("arrival"), kind.alias("kind"), F.when(n % 17 != 6, n % 19 != 7).alias("ok"))
    return _stream(spark, m, E.hints, "hints")


def first_deliveries(spark, d):
    n = F.col("event_id")
    e = R.table(spark, d, "events").select((n - n % 3).alias("event_id"))
    return _stream(spark, e, E.first_deliveries, "deliveries")


#: What a scripted session is told: (step, answer), with the count of rows left open.
SCRIPT = (
    ("hello", "invalid_request"), ("q1", "rows"), ("x", "unknown_operation"), ("long", "request_too_large"), ("bad", "invalid_query_request"), ("change unheard", "-"), ("s", "ok"), ("change", "workspace_changed 1"), ("change again", "-"), ("q2", "rows"),
    ("overflow", "rescan_required 2"), ("u", "ok"), ("change after", "-"), ("end", "ok"), ("closed", "False"),
)


def session_transcript(spark, d):
    rows = _live(spark, d)

    def run(arguments):
        return query.filtered(rows, query.Request(**{k: tuple(v) if isinstance(v, list) else v for k, v in arguments.items()})).count()

    changes = S.ChangeQueue()
    s = S.Session({"query": run}, lambda: "root", changes)
    ask = lambda key, op, **a: json.dumps({"id": key, "operation": op, "arguments": a}).encode()
    told = lambda r: "rows" if isinstance(r.get("result"), int) else "ok" if r["ok"] else r["error"]
    out = []

    def say(step, frame):
        out.append((step, told(s.respond(frame))))

    def change(step, times=1):
        for i in range(times):
            changes.offer([str(i)])
        e = s.event()
        out.append((step, "-" if e is None else f"{e['event']} {e['sequence']}"))

    stream = S.frames(io.BytesIO(b"hello\n" + ask("q1", "query", path_prefixes=["src1"]) + b"\n" + ask("x", "drop") + b"\n" + b"y" * 400 + b"\n" + ask("bad", "query", limit=0) + b"\n"), 300)
    for step in ("hello", "q1", "x", "long", "bad"):
        say(step, next(stream))
    change("change unheard")
    say("s", ask("s", "subscribe"))
    change("change")
    change("change again")
    say("q2", ask("q2", "query"))
    change("overflow", 9)
    say("u", ask("u", "unsubscribe"))
    change("change after")
    say("end", ask("end", "shutdown"))
    out.append(("closed", str(s.open)))
    return spark.createDataFrame(out, "step string, answer string")


def manifest_update(spark, d):
    from ..operators import diff

    m = R.table(spark, d, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("k"), F.concat(F.lit("version_"), "r_name").alias("object_version_id"), F.sha2("r_name", 256).alias("content_sha256"), F.lit(1).cast("long").alias("bytes"))
    old, new = (R.old_version(spark, d) | {"manifest": m.where("k = 0").drop("k"), "root_id": "r"}, R.new_version(spark, d) | {"manifest": m.where("k = 1").drop("k"), "root_id": "r"})
    return diff.diff(old, new).where("rank = 0 or change_type = 'recreated'").select("change_type", "path", "previous_object_version_id", "object_version_id")


def changes_in_order(spark, d):
    return _placed(version_diff(spark, d).select("sort_path", "rank", "object_id"), "sort_path", "rank", "object_id")


def version_records(spark, d):
    """Digests of one version that is whole and of one that has a row of an unknown kind, which has none."""
    v = {k: x.withColumn("version_id", F.lit("v1")) for k, x in R.new_version(spark, d).items()}
    bad = {k: x.withColumn("version_id", F.lit("v2")) for k, x in v.items()}
    bad["bindings"] = bad["bindings"].withColumn("kind", F.lit("cloud"))
    headers = spark.createDataFrame([("v1", "1.0", "root", [], "2026-01-01T00:00:00Z"), ("v2", "1.0", "root", [], "2026-01-01T00:00:00Z")], "version_id string, protocol string, root_id string, parents array<string>, created_at string")
    got = digest.version_digests(headers, *(v[k].unionByName(bad[k]) for k in ("bindings", "tombstones", "exclusions")))
    return got.select("version_id", F.col("version_sha256").isNotNull().alias("whole"))


QUERIES = {
    f.__name__: f
    for f in (
        blobs_installed, journal_appended, journal_repaired, version_installed, tombstone_restored, paged_by_cursor, explained_query, observation_digest, domain_digests, inspection_report, classes_in_order, inventory_budgets, initialisation_actions,
        versions_decoded, package_rebuilt, package_losses, application_history, reorganisation_drafts, publications, sync_conflicts, applied_once, streamed_events, streamed_hints, first_deliveries, session_transcript, manifest_update, changes_in_order, version_records,
    )
}

_CLASSES = O.SQL["classified_paths"].removeprefix("WITH ")
SQL = {
    "blobs_installed": "SELECT DISTINCT sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes FROM documents",
    "journal_appended": "SELECT event_id, event_type FROM events",
    "journal_repaired": "SELECT count(*) FILTER (event_id % 10 NOT IN (3, 4)) AS whole, count(*) FILTER (event_id % 10 = 3) AS torn FROM events",
    "version_installed": f"WITH {O.VERSIONS} SELECT step, generation, 'v2' AS current, (SELECT count(*) FROM nb) AS bindings FROM (VALUES ('first', 1), ('again', -1), ('stale', -1), ('next', 2)) t(step, generation)",
    "tombstone_restored": f"WITH {O.VERSIONS}, one AS (SELECT path, object_id FROM nt WHERE starts_with(path, 'old/') ORDER BY path LIMIT 1) SELECT path, object_id, 'live' AS state FROM nb UNION ALL SELECT path, object_id, 'live' FROM one UNION ALL SELECT path, object_id, 'deleted' FROM nt WHERE (path, object_id) NOT IN (SELECT (path, object_id) FROM one)",
    "paged_by_cursor": f"WITH {O.VERSIONS}, {O._HIST}, k AS (SELECT *, row_number() OVER (ORDER BY path, lifecycle = 'deleted', list_position(['directory', 'regular_file', 'symlink', 'nested_root'], kind), object_id NULLS FIRST, object_version_id NULLS FIRST) AS n FROM h) SELECT * EXCLUDE n FROM k WHERE n BETWEEN 31 AND 60",
    "explained_query": f"WITH {O.ENTRIES} SELECT 'row_key_v1' AS ordering, 'families_and_values_or' AS algebra, 'bounded_scan' AS strategy, ['src1', 'src7/en'] AS prefixes, 7 AS page, count(*) AS matched FROM e WHERE {O._PREFIX} AND kind = 'regular_file'",
    "observation_digest": f"""WITH {O.VERSIONS}, e AS (SELECT path, kind, bytes FROM f UNION ALL SELECT path, 'directory', NULL FROM (SELECT source AS path FROM f UNION SELECT source || '/' || lang FROM f)),
        r AS (SELECT 'E' AS t, path, '{{"bytes":' || coalesce(bytes::VARCHAR, 'null') || ',"kind":"' || kind || '","path":"' || path || '"}}' AS j FROM e UNION ALL SELECT 'X', path, '{{"kind":"' || kind || '","path":"' || path || '","reason":"' || reason || '"}}' FROM nx)
        SELECT CASE WHEN count(*) <= 16384 THEN sha256(unhex(hex(encode('live-observation-v1')) || '00' || string_agg(hex(encode(t)) || printf('%016x', octet_length(encode(j))) || hex(encode(j)), '' ORDER BY t, path))) END AS sha256 FROM r""",
    "domain_digests": """SELECT d AS domain, sha256(unhex(hex(encode(d)) || '00' || hex(encode('{"a":null,"b":[1,"x"]}')))) AS sha256, sha256('{"a":null,"b":[1,"x"]}') AS plain FROM (VALUES ('cursor-v1'), ('plan-v1'), ('projection-v1')) t(d)""",
    "inspection_report": f"""SELECT 'class' AS section, path, class AS detail FROM (WITH {_CLASSES}) UNION ALL SELECT * FROM (WITH {O.FILES}, {O._PATHS}, up AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path FROM p),
        w AS (SELECT path, list_filter(regexp_split_to_array(lower(split_part(path, '/', -1)), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM up), h AS (SELECT path, CASE WHEN list_contains(w, 'clients') THEN 'permission' WHEN list_contains(w, 'tmp') THEN 'lifecycle' END AS hint FROM w)
        SELECT 'boundary', path, hint FROM h WHERE hint IS NOT NULL UNION ALL SELECT DISTINCT 'context', path, NULL FROM p WHERE lower(split_part(path, '/', -1)) IN ('readme', 'readme.md'))""",
    "classes_in_order": f"SELECT path, rank, row_number() OVER (ORDER BY path, rank) AS place FROM (WITH {_CLASSES})",
    "inventory_budgets": f"WITH {O.ENTRIES}, a AS (SELECT count(*) AS n, max(len(string_split(path, '/'))) AS d, sum(octet_length(encode(path)) + 1)::BIGINT AS b FROM e) SELECT * FROM (SELECT 'too_many_entries' AS code, n AS measured FROM a WHERE n > 500 UNION ALL SELECT 'too_deep', d FROM a WHERE d > 2 UNION ALL SELECT 'too_large', b FROM a WHERE b > 1000)",
    "initialisation_actions": f"WITH {O.FILES} SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'add' WHEN doc_id % 6 = 1 OR doc_id % 10 = 3 THEN 'collision' ELSE 'preserve' END AS action FROM f",
    "versions_decoded": "WITH c AS (SELECT DISTINCT conv_id AS n FROM conversations), p AS (SELECT n, CASE WHEN n % 11 <> 5 AND n % 13 = 6 THEN 'too_large' WHEN n % 11 = 5 THEN 'invalid_json' WHEN n % 6 > 4 THEN 'too_many_entries' WHEN n % 7 = 3 THEN 'wrong_id' END AS problem FROM c) SELECT 'v' || n AS version_id, problem, CASE WHEN problem IS NULL THEN 'r' END AS root_id, CASE WHEN problem IS NULL THEN ['p'] END AS parents, CASE WHEN problem IS NULL THEN (n % 6)::INT END AS entries FROM p",
    "package_rebuilt": "SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 50 = 7 THEN '' ELSE text END) AS sha256 FROM documents",
    "package_losses": f"SELECT 'bytes' AS problem, {O.OBJ} AS first FROM documents WHERE doc_id = 41 AND source = 'src1'",
    "application_history": "SELECT * FROM (VALUES (0, 1, 1, 'r1', NULL, '1.0.0'), (1, 2, 2, 'r2', 'r1', '1.0.1'), (2, -1, NULL, NULL, NULL, NULL), (3, -1, NULL, NULL, NULL, NULL), (4, 3, 3, 'r3', 'r2', '1.0.4')) t(step, outcome, number, record_id, predecessor, version)",
    "reorganisation_drafts": "SELECT * FROM (VALUES (3, 'no_operations'), (4, 'too_many_operations'), (5, 'repeated_question'), (8, 'unanswered'), (11, 'outside_scope'), (12, 'repeated_path')) t(draft_id, problem)",
    "publications": f"WITH {O._EVENTS} SELECT event_id, 1000 + row_number() OVER (ORDER BY arrival, event_id) AS publication FROM ev",
    "sync_conflicts": "WITH c AS (SELECT (event_id % 40)::VARCHAR AS path, (event_id % 3)::VARCHAR AS local_digest, (event_id % 2)::VARCHAR AS remote_digest, min(event_id) AS arrival FROM events GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY path, local_digest, remote_digest) AS place FROM c",
    "applied_once": f"WITH {_CONFLICTS}, n AS (SELECT count(*) AS n FROM f), a AS (SELECT count(DISTINCT object_id) AS n FROM (SELECT object_id FROM f WHERE object_id NOT IN (SELECT object_id FROM dl WHERE bp IS NOT NULL) UNION ALL SELECT object_id FROM dl WHERE ap IS NOT NULL)) SELECT 'new' AS attempt, 'applied' AS outcome, n AS objects FROM a UNION ALL SELECT 'replayed', 'already_applied', n FROM n UNION ALL SELECT 'conflicting', 'conflicted', n FROM n",
    "streamed_events": f"""WITH {O._EVENTS}, s AS (SELECT event_id, path, CASE WHEN event_id % 50 <> 9 THEN sequence END AS sequence, arrival * 100000 + event_id AS a, event_id % 6 <> 5 AND event_id % 50 <> 9 AS ready FROM ev), h AS (SELECT *, max(sequence) FILTER (ready) OVER (PARTITION BY path ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM s)
        SELECT event_id, sequence, CASE WHEN sequence IS NULL OR sequence <= high THEN 'late' WHEN ready THEN 'applied' ELSE 'held' END AS outcome FROM h""",
    "streamed_hints": """WITH RECURSIVE m AS (SELECT user_id::VARCHAR AS session, event_id AS n, CASE WHEN event_id % 11 = 0 THEN 'subscribe' WHEN event_id % 29 = 1 THEN 'unsubscribe' WHEN event_id % 5 = 2 THEN 'query' WHEN event_id % 13 = 3 THEN 'rescan_required' WHEN event_id % 211 = 4 THEN 'shutdown' ELSE 'workspace_changed' END AS kind,
        event_id % 17 <> 6 AND event_id % 19 <> 7 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        w AS (SELECT session, 0::BIGINT AS i, false AS sub, false AS dirty, 0 AS num, false AS closed, NULL::VARCHAR AS event, 0::BIGINT AS n FROM (SELECT DISTINCT session FROM m)
        UNION ALL SELECT w.session, m.i, CASE WHEN ok AND kind = 'subscribe' THEN true WHEN ok AND kind = 'unsubscribe' THEN false ELSE sub END, CASE WHEN kind IN ('workspace_changed', 'rescan_required') THEN dirty OR sub WHEN ok AND kind IN ('query', 'subscribe', 'unsubscribe') THEN false ELSE dirty END,
        CASE WHEN kind IN ('workspace_changed', 'rescan_required') AND sub AND NOT dirty THEN num + 1 ELSE num END, ok AND kind = 'shutdown', CASE WHEN kind IN ('workspace_changed', 'rescan_required') AND sub AND NOT dirty THEN kind END, m.n FROM w JOIN m ON m.session = w.session AND m.i = w.i + 1 WHERE NOT closed)
        SELECT session, event, num::BIGINT AS sequence, n AS arrival FROM w WHERE event IS NOT NULL""",
    "first_deliveries": "SELECT DISTINCT event_id - event_id % 3 AS event_id FROM events",
    "session_transcript": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SCRIPT) + ") t(step, answer)",
    "manifest_update": f"SELECT change_type, path, previous_object_version_id, object_version_id FROM ({O.DIFF}) WHERE change_type = 'recreated' UNION ALL SELECT 'manifest_updated', '', (SELECT 'version_' || r_name FROM region WHERE r_regionkey = 0), (SELECT 'version_' || r_name FROM region WHERE r_regionkey = 1)",
    "changes_in_order": f"SELECT sort_path, rank, object_id, row_number() OVER (ORDER BY sort_path, rank, object_id NULLS FIRST) AS place FROM ({O.DIFF})",
    "version_records": "SELECT * FROM (VALUES ('v1', true), ('v2', false)) t(version_id, whole)",
}
