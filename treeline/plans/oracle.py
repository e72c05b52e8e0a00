"""DuckDB SQL of the queries, from relations written out as common tables."""

from __future__ import annotations

from ..functions import classify as C

_ID = "'{p}_019f0000-0000-{b}-8000-' || lpad(doc_id::VARCHAR, 12, '0')"
OBJ, VER = _ID.format(p="obj", b="7000"), _ID.format(p="version", b="7000")
OBJ9, VER9 = _ID.format(p="obj", b="7999"), _ID.format(p="version", b="7999")
OBJF, VERF = _ID.format(p="obj", b="7fff"), _ID.format(p="version", b="7fff")

FILES = f"""f AS (SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.txt' AS path, 'regular_file' AS kind, octet_length(encode(text))::BIGINT AS bytes, doc_id % 5 = 0 AS executable,
  NULL::VARCHAR AS target, sha256(text) AS content_sha256, {OBJ} AS object_id, {VER} AS object_version_id, source, lang FROM documents)"""
ENTRIES = f"""{FILES}, e AS (SELECT path, kind, bytes, executable FROM f UNION ALL SELECT path, 'directory', NULL, NULL FROM (SELECT source AS path FROM f UNION SELECT source || '/' || lang FROM f))"""
VERSIONS = f"""{FILES},
ob AS (SELECT * FROM f WHERE doc_id % 23 <> 4),
nb AS (SELECT doc_id, CASE WHEN doc_id % 13 = 1 THEN 'moved/' || path ELSE path END AS path, kind, bytes, executable, target, CASE WHEN doc_id % 17 = 2 THEN sha256('edit' || content_sha256) ELSE content_sha256 END AS content_sha256,
  CASE WHEN doc_id % 19 = 3 THEN {OBJ9} ELSE object_id END AS object_id, CASE WHEN doc_id % 17 = 2 OR doc_id % 19 = 3 THEN {VER9} ELSE object_version_id END AS object_version_id FROM f WHERE doc_id % 11 <> 0),
ot AS (SELECT 'old/' || path AS path, {OBJF} AS object_id, 'regular_file' AS deleted_kind, {VERF} AS last_object_version_id FROM f WHERE doc_id % 29 = 5),
nt AS (SELECT * FROM ot WHERE right(object_id, 1) <> '5' UNION ALL SELECT path, object_id, kind, object_version_id FROM ob WHERE object_id NOT IN (SELECT object_id FROM nb)),
x AS (SELECT doc_id, 'ext/' || source || '/x' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'nested_root' ELSE 'hard_link' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'nested-boundary' ELSE 'unsupported' END AS reason FROM documents),
ox AS (SELECT path, kind, reason FROM x WHERE doc_id % 31 = 6),
nx AS (SELECT path, kind, reason FROM x WHERE doc_id % 31 = 6 AND path NOT LIKE '%7' UNION ALL SELECT path, kind, reason FROM x WHERE doc_id % 31 = 9)"""
EDITED = "((o.kind, o.object_version_id, o.content_sha256, o.bytes, o.executable) IS DISTINCT FROM (n.kind, n.object_version_id, n.content_sha256, n.bytes, n.executable))"
DIFF = f"""WITH {VERSIONS},
d AS (
  SELECT 'moved' AS change_type, NULL AS path, o.path AS from_path, n.path AS to_path, o.object_id, NULL AS previous_object_id, NULL AS previous_object_version_id, NULL AS object_version_id, NULL::BOOLEAN AS tombstone_present FROM ob o JOIN nb n ON o.object_id = n.object_id AND o.path <> n.path
  UNION ALL SELECT 'updated', n.path, NULL, NULL, n.object_id, NULL, o.object_version_id, n.object_version_id, NULL FROM ob o JOIN nb n ON o.object_id = n.object_id AND {EDITED}
  UNION ALL SELECT 'recreated', n.path, NULL, NULL, n.object_id, o.object_id, NULL, NULL, NULL FROM ob o JOIN nb n ON o.path = n.path AND o.object_id <> n.object_id
  UNION ALL SELECT 'added', path, NULL, NULL, object_id, NULL, NULL, NULL, NULL FROM nb WHERE path NOT IN (SELECT path FROM ob) AND object_id NOT IN (SELECT object_id FROM ob)
  UNION ALL SELECT 'deleted', path, NULL, NULL, object_id, NULL, NULL, NULL, (path, object_id) IN (SELECT (path, object_id) FROM nt) FROM ob WHERE path NOT IN (SELECT path FROM nb) AND object_id NOT IN (SELECT object_id FROM nb)
  UNION ALL SELECT 'tombstone_added', path, NULL, NULL, object_id, NULL, NULL, NULL, NULL FROM (SELECT * FROM nt EXCEPT SELECT * FROM ot)
  UNION ALL SELECT 'tombstone_removed', path, NULL, NULL, object_id, NULL, NULL, NULL, NULL FROM (SELECT * FROM ot EXCEPT SELECT * FROM nt)
  UNION ALL SELECT 'exclusion_added', path, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT * FROM nx EXCEPT SELECT * FROM ox)
  UNION ALL SELECT 'exclusion_removed', path, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT * FROM ox EXCEPT SELECT * FROM nx))
SELECT *, coalesce(path, from_path) AS sort_path, list_position(['manifest_updated', 'moved', 'recreated', 'added', 'updated', 'deleted', 'tombstone_added', 'tombstone_removed', 'exclusion_added', 'exclusion_removed'], change_type)::INT - 1 AS rank FROM d"""
_LIVE = "path, kind, 'live' AS lifecycle, bytes, executable, NULL::VARCHAR AS symlink_target"
_NOIDS = "NULL::VARCHAR AS object_id, NULL::VARCHAR AS object_version_id, NULL::VARCHAR AS version_id, 'capture_plan' AS source, NULL::VARCHAR AS boundary_reason"
_PREFIX = "(path = 'src1' OR starts_with(path, 'src1/') OR path = 'src7/en' OR starts_with(path, 'src7/en/'))"
_HIST = """h AS (SELECT path, kind, 'live' AS lifecycle, bytes, executable, target AS symlink_target, object_id, object_version_id, 'v2' AS version_id, 'version' AS source, NULL::VARCHAR AS boundary_reason FROM nb
 UNION ALL SELECT path, deleted_kind, 'deleted', NULL, NULL, NULL, object_id, last_object_version_id, 'v2', 'version', NULL FROM nt
 UNION ALL SELECT path, 'nested_root', 'live', NULL, NULL, NULL, NULL, NULL, 'v2', 'version', 'nested-boundary' FROM nx WHERE kind = 'nested_root')"""
_STATE = "struct_pack(path := {a}.path, kind := {a}.kind, content_sha256 := {a}.content_sha256, bytes := {a}.bytes, executable := {a}.executable, target := {a}.target)"
_CHK = """bs AS (SELECT * FROM f), cu AS (SELECT CASE WHEN doc_id % 13 = 1 THEN 'renamed/' || doc_id ELSE path END AS path, kind, CASE WHEN doc_id % 17 = 2 THEN sha256('e' || content_sha256) ELSE content_sha256 END AS content_sha256, bytes, executable, target, doc_id FROM f WHERE doc_id % 11 <> 0)"""
_MATCH = f"""{_CHK},
m1 AS (SELECT b.path AS base_path, c.path AS current_path FROM bs b JOIN cu c USING (path, kind)),
b1 AS (SELECT * FROM bs WHERE path NOT IN (SELECT base_path FROM m1)), c1 AS (SELECT * FROM cu WHERE path NOT IN (SELECT current_path FROM m1)),
m2 AS (SELECT bb.base_path, cc.current_path FROM (SELECT kind, content_sha256, bytes, executable, min(path) AS base_path FROM b1 GROUP BY ALL HAVING count(*) = 1) bb
  JOIN (SELECT kind, content_sha256, bytes, executable, min(path) AS current_path FROM c1 GROUP BY ALL) cc USING (kind, content_sha256, bytes, executable)),
b2 AS (SELECT * FROM b1 WHERE path NOT IN (SELECT base_path FROM m2)), c2 AS (SELECT * FROM c1 WHERE path NOT IN (SELECT current_path FROM m2)),
m3 AS (SELECT bb.p AS base_path, cc.p AS current_path FROM (SELECT kind, min(path) AS p FROM b2 GROUP BY kind HAVING count(*) = 1) bb JOIN (SELECT kind, min(path) AS p FROM c2 GROUP BY kind HAVING count(*) = 1) cc USING (kind)),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _any(names) -> str:
    return "|".join(names)


_CLASSIFY = f"""name AS (SELECT *, split_part(path, '/', -1) AS n, lower(split_part(path, '/', -1)) AS l, lower(regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1)) AS x,
  lower(CASE WHEN regexp_matches(split_part(path, '/', -1), '^.+\\.[^.]*$') THEN regexp_extract(split_part(path, '/', -1), '^(.+)\\.[^.]*$', 1) ELSE split_part(path, '/', -1) END) AS s FROM p),
c AS (SELECT *, list_has_any(string_split(path, '/'), {_list(C.RECONSTRUCTABLE)}) OR list_contains({_list(C.GENERATED_EXTENSIONS)}, x) OR n = '.DS_Store' AS generated,
  NOT (suffix(l, '.example') OR suffix(l, '.sample') OR suffix(l, '.template') OR contains(l, 'example.')) AND (list_contains({_list(C.SECRET_NAMES)}, l) OR starts_with(l, '.env.') OR regexp_matches(l, '{_any(C.SECRET_PARTS)}') OR list_contains({_list(C.SECRET_EXTENSIONS)}, x)) AS secret,
  list_has_any(string_split(lower(path), '/'), {_list(C.TEMPORARY_DIRECTORIES)}) OR starts_with(n, '~$') OR suffix(n, '~') OR list_contains({_list(C.TEMPORARY_EXTENSIONS)}, x) AS temporary,
  len(list_filter(regexp_split_to_array(s, '[^a-z0-9]+'), lambda w: regexp_matches(w, '^({_any(C.VERSION_WORDS)}|v[0-9]+|copy[0-9]+)$'))) > 0 OR regexp_matches(s, '\\([0-9]*\\)$') AS versioned FROM name)"""
NAMES = ["node_modules/a.js", "app.PYC", ".DS_Store", "secret-notes.txt", ".env.example", ".env", "key.pem", "tmp/x.txt", "~$doc.docx", "notes.txt~", "plan v2.docx", "report (3).pdf", "final draft.md", "copy12.txt", "README.md", "finalist.txt", "x().txt", "clients/list.csv", "id_rsa"]
_PATHS = "p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE source || '/' || ([" + ", ".join(f"'{n}'" for n in NAMES) + f"])[1 + doc_id % {len(NAMES)}] END AS path, bytes * (1 + doc_id % 3 * 20000) AS bytes, doc_id FROM f)"
_EVENTS = "ev AS (SELECT event_id, 'user/' || user_id AS path, event_id % 997 AS sequence, event_id + (event_id % 7) * 100 AS arrival FROM events)"
_CHUNKS = "ch AS (SELECT 'o' || l_orderkey AS object_id, row_number() OVER w - 1 AS index, CASE WHEN l_orderkey % 9 = 4 THEN 1 ELSE 0 END + coalesce(sum(l_quantity::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset, l_quantity::BIGINT AS bytes, sha256(l_partkey || '/' || l_quantity::BIGINT) AS sha256 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))"
_GRANTS = """gr AS (SELECT 'g' || lpad(c_custkey::VARCHAR, 9, '0') AS grant_id, 'root' || c_nationkey % 5 AS root_id, 'm' || c_custkey % 40 AS member_id, (['root', 'folder', 'object', 'view'])[1 + c_custkey % 4] AS scope_type, 'src' || c_custkey % 20 AS scope_path, c_custkey % 3 AS perm, c_custkey % 7 AS exp, c_custkey % 11 AS rev FROM customer),
rq AS (SELECT o_orderkey AS request_id, 'root' || o_custkey % 5 AS root_id, 'm' || o_orderkey % 45 AS member_id, 'src' || o_orderkey % 20 || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/en' END AS path, (['read', 'edit', 'share'])[1 + o_orderkey % 3] AS permission, o_orderkey % 8 AS at FROM orders)"""



def _framed(text: str) -> str:
    return f"printf('%08x', octet_length(encode({text}))) || lower(hex(encode({text})))"


_DIGEST = f"""lv AS (SELECT right(object_id, 12)::BIGINT // 1000 AS v, path, object_id AS o, {_framed('path')} || {_framed('object_id')} || {_framed("'live'")} || '01' || {_framed('object_version_id')} || content_sha256 || printf('%016x', bytes) || printf('%02x', executable::INT) AS h FROM nb WHERE path IS NOT NULL AND content_sha256 IS NOT NULL),
dd AS (SELECT right(object_id, 12)::BIGINT // 1000 AS v, path, object_id AS o, {_framed('path')} || {_framed('object_id')} || {_framed("'deleted'")} || '0101' || {_framed('last_object_version_id')} AS h FROM nt WHERE path IS NOT NULL),
xx AS (SELECT regexp_extract(path, '([0-9]+)$', 1)::BIGINT // 1000 AS v, path, '' AS o, {_framed('path')} || CASE WHEN kind = 'nested_root' THEN '00' ELSE '01' END || {_framed('reason')} AS h FROM nx WHERE path IS NOT NULL),
hd AS (SELECT DISTINCT doc_id // 1000 AS v FROM documents),
tops AS (SELECT v, lower(hex(encode('treeline-version-v1'))) || '00' || {_framed("'1.0'")} || {_framed("'root'")} || {_framed("'v' || v")} || '01' || {_framed("'v'")} || {_framed("'2026-01-01T00:00:00Z'")} AS top FROM hd)"""
_PART = "coalesce((SELECT printf('%08x', count(*)) || string_agg(h, '' ORDER BY path, o) FROM {t} WHERE {t}.v = tops.v), '00000000')"

SQL = {
    "query_page": f"WITH {ENTRIES} SELECT {_LIVE}, {_NOIDS} FROM e WHERE {_PREFIX} AND kind = 'regular_file' AND bytes >= 1000 ORDER BY path LIMIT 101",
    "query_filter_prefix": f"WITH {ENTRIES} SELECT {_LIVE}, {_NOIDS} FROM e WHERE {_PREFIX}",
    "query_filter_families": f"WITH {ENTRIES} SELECT {_LIVE}, {_NOIDS} FROM e WHERE kind IN ('directory', 'regular_file') AND bytes BETWEEN 500 AND 2000 AND starts_with(path, 'src2/')",
    "query_live_identity": f"WITH {VERSIONS}, dirs AS (SELECT source AS path FROM f UNION SELECT source || '/' || lang FROM f), e AS (SELECT path, kind, bytes, executable FROM f UNION ALL SELECT path, 'directory', NULL, NULL FROM dirs) SELECT e.path, e.kind, 'live' AS lifecycle, e.bytes, e.executable, NULL::VARCHAR AS symlink_target, nb.object_id, nb.object_version_id, CASE WHEN nb.path IS NOT NULL THEN 'v2' END AS version_id, 'capture_plan' AS source, NULL::VARCHAR AS boundary_reason FROM e LEFT JOIN nb ON e.path = nb.path AND e.kind = nb.kind",
    "query_historical": f"WITH {VERSIONS}, {_HIST} SELECT * FROM h",
    "query_keyset_second_page": f"WITH {VERSIONS}, {_HIST}, k AS (SELECT *, row_number() OVER (ORDER BY path, lifecycle = 'deleted', list_position(['directory', 'regular_file', 'symlink', 'nested_root'], kind), object_id NULLS FIRST, object_version_id NULLS FIRST) AS n FROM h) SELECT * EXCLUDE n FROM k WHERE n BETWEEN 51 AND 101",
    "query_matched": f"WITH {ENTRIES} SELECT count(*) AS matched FROM e WHERE {_PREFIX}",
    "query_exclusions": f"WITH {VERSIONS}, d AS (SELECT path FROM f WHERE doc_id % 41 = 1) SELECT path, reason, kind FROM nx UNION ALL SELECT path, 'capture-ignore-policy', NULL FROM d",
    "exclusions_capped": f"WITH {VERSIONS} SELECT path, kind, reason FROM nx ORDER BY path LIMIT 11",
    "version_diff": DIFF,
    "diff_counts": f"SELECT change_type, count(*) AS n FROM ({DIFF}) GROUP BY change_type",
    "version_findings": f"WITH {VERSIONS}, ee AS (SELECT path FROM nb UNION ALL SELECT path FROM nt UNION ALL SELECT path FROM nx) SELECT 'error' AS severity, 'path_collision' AS code, lower(path) AS path FROM ee GROUP BY lower(path) HAVING count(DISTINCT path) > 1 UNION ALL SELECT 'error', 'version_owner_collision', v FROM (SELECT object_version_id AS v, object_id AS o FROM nb UNION ALL SELECT last_object_version_id, object_id FROM nt) GROUP BY v HAVING count(DISTINCT o) > 1",
    "path_functions": "WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages) SELECT page_id, path, len(string_split(path, '/')) AS depth, split_part(path, '/', -1) AS name, path <> '' AND NOT suffix(path, '/') AND NOT starts_with(path, '/') AND NOT contains(path, '//') AND NOT regexp_matches(path, '[. ](/|$)') AS valid, list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')) AS ancestors FROM u",
    "id_and_digest_checks": f"WITH {FILES} SELECT doc_id, true AS id_ok, doc_id % 3 <> 0 AS sha_ok, doc_id % 4 <> 1 AS time_ok FROM f",
    "boundary_containment": f"WITH {FILES} SELECT path FROM f WHERE lang = 'de' OR source = 'src3'",
    "boundary_overlaps": f"WITH {FILES}, b AS (SELECT DISTINCT source AS path FROM f WHERE doc_id % 3 = 0 UNION SELECT source || '/' || lang FROM f) SELECT b.path FROM b WHERE EXISTS (SELECT 1 FROM b c WHERE starts_with(b.path, c.path || '/'))",
    "collisions": "SELECT lower(path) AS key, count(DISTINCT path) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END || '/' || doc_id % 50 AS path FROM documents) GROUP BY ALL HAVING count(DISTINCT path) > 1",
    "duplicate_contents": f"WITH {FILES} SELECT content_sha256, count(*) AS n, min(path) AS path FROM f GROUP BY content_sha256 HAVING count(*) > 1",
    "rename_matches": f"WITH {FILES}, {_MATCH} SELECT * FROM m",
    "change_set_deltas": f"WITH {FILES}, {_MATCH}, j AS (SELECT coalesce(b.object_id, 'obj_new_' || sha256(c.path)) AS object_id, b.path AS before_path, c.path AS after_path, b.content_sha256 AS before_sha256, c.content_sha256 AS after_sha256 FROM bs b LEFT JOIN m ON b.path = m.base_path FULL JOIN cu c ON m.current_path = c.path) SELECT * FROM j WHERE before_path IS DISTINCT FROM after_path OR before_sha256 IS DISTINCT FROM after_sha256",
    "scoped_projection": f"WITH {FILES} SELECT path, object_id FROM f WHERE {_PREFIX}",
    "tombstones_carried": f"WITH {VERSIONS}, a AS (SELECT *, 0 AS n FROM ot UNION ALL SELECT path, object_id, kind, object_version_id, 1 FROM ob WHERE object_id NOT IN (SELECT object_id FROM nb)) SELECT path, object_id, deleted_kind, last_object_version_id FROM a QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, object_id) = 1",
    "seal_identities": f"WITH {VERSIONS}, l AS (SELECT path, kind, content_sha256 AS physical_identity FROM nb), a AS (SELECT l.*, o.object_id AS o FROM l LEFT JOIN ob o USING (path, kind)), fr AS (SELECT * FROM ob WHERE object_id NOT IN (SELECT o FROM a WHERE o IS NOT NULL)), b AS (SELECT a.path, a.kind, count(*) AS n, min(fr.object_id) AS b FROM a JOIN fr ON a.kind = fr.kind AND a.physical_identity = fr.content_sha256 WHERE a.o IS NULL GROUP BY ALL) SELECT a.path, a.kind, a.physical_identity, coalesce(a.o, CASE WHEN b.n = 1 THEN b.b END) AS object_id, coalesce(b.n > 1, false) AS ambiguous FROM a LEFT JOIN b USING (path, kind)",
    "seal_unchanged": f"WITH {VERSIONS} SELECT NOT EXISTS (SELECT path, object_id FROM ob EXCEPT SELECT path, object_id FROM nb) AND NOT EXISTS (SELECT path, object_id FROM nb EXCEPT SELECT path, object_id FROM ob) AS unchanged",
    "hidden_priors": f"WITH {VERSIONS} SELECT path FROM ob WHERE path NOT IN (SELECT path FROM nb) AND source = 'src3'",
    "version_ancestry": "WITH RECURSIVE ed AS (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders), r AS (SELECT o_orderkey AS start, o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT r.start, ed.parent, r.depth + 1 FROM r JOIN ed ON r.node = ed.child WHERE ed.parent IS NOT NULL) SELECT start, node, min(depth)::BIGINT AS depth FROM r GROUP BY start, node",
    "replica_reconciliation": f"WITH {FILES}, l AS (SELECT path, CASE WHEN doc_id % 7 = 1 THEN sha256('l' || content_sha256) ELSE content_sha256 END AS d, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'binary' END AS k, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE content_sha256 END AS b FROM f WHERE doc_id % 6 <> 0), r AS (SELECT path, CASE WHEN doc_id % 4 = 3 THEN sha256('r' || content_sha256) ELSE content_sha256 END AS d, CASE WHEN doc_id % 10 = 3 THEN 'binary' ELSE 'text' END AS k FROM f WHERE doc_id % 8 <> 1), a AS (SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'upload' WHEN l.path IS NULL THEN 'download' WHEN l.d = r.d THEN 'unchanged' WHEN l.b = r.d THEN 'upload' WHEN l.b = l.d THEN 'download' ELSE 'conflict' END AS action, l.k AS lk, r.k AS rk FROM l FULL JOIN r USING (path)) SELECT path, action, CASE WHEN action = 'conflict' THEN CASE WHEN lk = 'text' AND rk = 'text' THEN 'text_needs_merge' ELSE 'preserve_both_binary' END END AS classification FROM a",
    "applied_events": f"WITH {_EVENTS} SELECT *, coalesce(sequence > max(sequence) OVER (PARTITION BY path ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS applied FROM ev",
    "grant_decisions": f"WITH {_GRANTS}, j AS (SELECT rq.*, gr.grant_id, gr.perm, CASE WHEN gr.grant_id IS NULL THEN NULL WHEN gr.rev <= 2 AND gr.rev <= rq.at THEN 'revoked' WHEN gr.exp <= rq.at THEN 'expired' WHEN NOT (scope_type = 'root' OR scope_type IN ('folder', 'view') AND (rq.path = scope_path OR starts_with(rq.path, scope_path || '/')) OR scope_type = 'object' AND rq.path = scope_path) THEN 'outside' WHEN NOT (permission = 'read' OR permission = 'edit' AND perm >= 1) THEN 'permission_missing' ELSE 'allow' END AS o FROM rq LEFT JOIN gr ON rq.root_id = gr.root_id AND rq.member_id = gr.member_id), a AS (SELECT request_id, any_value(member_id) = 'm' || substr(any_value(root_id), 5) AS owner, min(grant_id) FILTER (o = 'allow') AS g, max_by(o, grant_id) FILTER (o IN ('revoked', 'expired', 'permission_missing')) AS denial, count(grant_id) AS n FROM j GROUP BY request_id) SELECT request_id, owner OR g IS NOT NULL AS allowed, CASE WHEN owner THEN 'owner' WHEN g IS NOT NULL THEN 'explicit_grant' WHEN n = 0 THEN 'no_grant' ELSE coalesce(denial, 'outside_scope') END AS reason, CASE WHEN NOT owner THEN g END AS grant_id FROM a",
    "readiness": f"WITH {FILES}, o AS (SELECT source AS root_id, bytes, (['verified', 'verified', 'present_unverified', 'missing'])[1 + CASE WHEN length(source) = 4 THEN 0 ELSE doc_id % 4 END] AS local, CASE WHEN source >= 'src15' AND doc_id % 9 = 0 THEN 'missing' ELSE 'verified' END AS remote, doc_id % 3 = 0 AS required, doc_id % 6 = 0 OR source < 'src13' AS pinned FROM f) SELECT root_id, CASE WHEN root_id = 'src2' THEN 'archived' WHEN ss THEN 'session_ready' WHEN pol IN ('keep_local', 'managed') AND lc THEN 'local_complete' WHEN pol <> 'keep_local' AND rr THEN 'remote_ready' ELSE 'incomplete' END AS state, root_id <> 'src2' AND lc AS local_complete, root_id <> 'src2' AND ss AS session_ready, root_id <> 'src2' AND rr AS remote_ready, bytes_required, missing_local, unverified_local, missing_remote, unpinned, session_missing FROM (SELECT *, missing_local + unverified_local = 0 AND (pol <> 'keep_local' OR root_id > 'src5') AS lc, root_id < 'src4' AND session_missing = 0 AND unpinned = 0 AS ss, missing_remote = 0 AND root_id <> 'src11' AS rr FROM (SELECT root_id, (['keep_local', 'managed', 'cloud_only'])[1 + length(root_id || substr(root_id, 5)) % 3] AS pol, coalesce(sum(bytes) FILTER (local <> 'verified'), 0)::BIGINT AS bytes_required, count(*) FILTER (local = 'missing') AS missing_local, count(*) FILTER (local = 'present_unverified') AS unverified_local, count(*) FILTER (remote <> 'verified') AS missing_remote, count(*) FILTER (required AND NOT pinned) AS unpinned, count(*) FILTER (required AND local <> 'verified') AS session_missing FROM o GROUP BY root_id))",
    "inventory_summary": f"WITH {FILES}, {_PATHS}, {_CLASSIFY} SELECT count(*) AS file_count, sum(bytes)::BIGINT AS total_bytes, count(*) FILTER (generated) AS generated_count, count(*) FILTER (secret) AS secret_shaped_count, count(*) FILTER (temporary) AS temporary_count, count(*) FILTER (bytes >= 104857600) AS large_count, count(*) FILTER (versioned) AS versioned_count FROM c",
    "classified_paths": f"WITH {FILES}, {_PATHS}, {_CLASSIFY} SELECT DISTINCT path, class, rank FROM (SELECT path, unnest([CASE WHEN generated THEN 0 END, CASE WHEN secret THEN 1 END, CASE WHEN temporary THEN 2 END, CASE WHEN bytes >= 104857600 THEN 3 END, CASE WHEN versioned THEN 4 END]) AS rank, unnest(['generated', 'secret_shaped', 'temporary', 'large', 'versioned']) AS class FROM c) WHERE rank IS NOT NULL",
    "manifest_findings": f"WITH {_CHUNKS}, t AS (SELECT object_id, sum(bytes) + CASE WHEN object_id LIKE '%7' THEN 1 ELSE 0 END AS object_bytes FROM ch GROUP BY object_id), k AS (SELECT ch.*, t.object_bytes, row_number() OVER w - 1 AS place, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS e, lead(index) OVER w IS NULL AS fin FROM ch JOIN t USING (object_id) WINDOW w AS (PARTITION BY object_id ORDER BY index)) SELECT object_id, count(*) FILTER (index <> place OR \"offset\" <> e - bytes OR bytes < 1 OR bytes > 45 OR (NOT fin AND bytes < 5) OR (fin AND e <> object_bytes)) AS n_bad FROM k GROUP BY object_id",
    "transfer_progress": f"WITH {_CHUNKS}, h AS (SELECT DISTINCT sha256 FROM ch WHERE bytes % 3 <> 0) SELECT object_id, count(*) AS n_chunks, count(*) FILTER (h.sha256 IS NULL) AS n_missing, coalesce(sum(bytes) FILTER (h.sha256 IS NOT NULL), 0)::BIGINT AS received_bytes, sum(bytes)::BIGINT AS object_bytes FROM ch LEFT JOIN h USING (sha256) GROUP BY object_id",
    "missing_chunk_page": f"WITH {_CHUNKS}, h AS (SELECT DISTINCT sha256 FROM ch WHERE bytes % 3 <> 0) SELECT object_id, index, bytes FROM ch WHERE index >= 2 AND index < 4 AND sha256 NOT IN (SELECT sha256 FROM h)",
    "storage_totals": f"WITH {_CHUNKS} SELECT count(DISTINCT sha256) AS distinct_chunks, count(*) AS n_chunks, sum(bytes)::BIGINT AS object_bytes FROM ch",
    "closure_problems": f"WITH {FILES}, e AS (SELECT object_id, content_sha256 FROM f WHERE doc_id % 10 <> 1), s AS (SELECT object_id, CASE WHEN doc_id % 15 = 4 THEN 'x' ELSE content_sha256 END AS c FROM f WHERE doc_id % 7 <> 2 UNION ALL SELECT object_id, content_sha256 FROM f WHERE doc_id % 21 = 5 AND doc_id % 7 <> 2), g AS (SELECT object_id, count(*) AS n, min(c) AS c FROM s GROUP BY object_id) SELECT coalesce(e.object_id, g.object_id) AS object_id, CASE WHEN g.object_id IS NULL THEN 'missing' WHEN e.object_id IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' ELSE 'mismatch' END AS problem FROM e FULL JOIN g USING (object_id) WHERE g.object_id IS NULL OR e.object_id IS NULL OR n > 1 OR c <> content_sha256",
    "unresolved_targets": "SELECT doc_id, source FROM (SELECT doc_id, doc_id * 3 % 1500 AS t, source FROM documents) WHERE t NOT IN (SELECT doc_id FROM labels)",
    "lineage_summary": "WITH r AS (SELECT conv_id, turn AS k, nullif(CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn - 1 END, -1) AS p FROM (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS turn FROM conversations)), u AS (SELECT conv_id, p, count(*) AS n FROM r WHERE p IS NOT NULL GROUP BY ALL) SELECT r.conv_id, count(*) AS records, count(*) FILTER (r.p IS NULL) AS roots, count(*) FILTER (u.n IS NULL) AS terminals, count(*) FILTER (u.n > 1) AS forks, count(*) FILTER (r.p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r q WHERE q.conv_id = r.conv_id AND q.k = r.p)) AS lost FROM r LEFT JOIN u ON r.conv_id = u.conv_id AND r.k = u.p GROUP BY r.conv_id",
    "workspace_listing": f"WITH {ENTRIES} SELECT path, kind, CASE WHEN kind = 'regular_file' THEN bytes ELSE 0 END AS bytes, coalesce(kind = 'regular_file' AND bytes <= 2097152, false) AS editable, false AS reconstructable FROM e",
    "text_digests": "SELECT conv_id, turn, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM conversations",
    "version_digests": f"WITH {VERSIONS}, {_DIGEST} SELECT 'v' || v AS version_id, sha256(unhex(top || " + " || ".join(_PART.format(t=t) for t in ("lv", "dd", "xx")) + ")) AS version_sha256 FROM tops",
}
