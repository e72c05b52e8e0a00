"""Registered queries of scalar functions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as M
from ..functions import ignore, paths as P, unicode, values as V
from ..operators import checks, closure, inventory, transfer
from ..sources import relations as R
from . import oracle as O
from .validation import _pick


def _docs(spark, d):
    return R.table(spark, d, "documents")


def hex_values(spark, d):
    n, text = F.col("conv_id") * 100 + F.col("turn"), F.substring("text", 1, 40)
    h = V.hexed(text)
    spoilt = F.when(n % 3 == 0, F.upper(h)).when(n % 3 == 1, F.concat(h, F.lit("0"))).otherwise(h)
    return R.table(spark, d, "conversations").select("conv_id", "turn", h.alias("hex"), F.decode(V.unhexed(spoilt), "UTF-8").alias("back"))


def composed_and_folded(spark, d):
    text = F.concat(_pick(F.col("doc_id") % 5, "Éa", "ÉA", "ọ̈", "Å", "ẛ̣"), F.substring_index("source", "/", 1))
    return _docs(spark, d).select("doc_id", unicode.composed(text).alias("nfc"), F.when(F.col("doc_id") % 5 < 4, unicode.folded(text)).alias("fold"))


def exact_numbers(spark, d):
    n = F.col("doc_id")
    text = F.concat(n.cast("string"), _pick(n % 12, "", ".0", "e3", ".5", "E+2", "000e-3", "e-1", ".", " ", "e30", ".50e1", ".00"))
    text = F.when(n % 13 == 5, F.concat(F.lit("0"), text)).when(n % 13 == 6, F.concat(F.lit("-"), text)).otherwise(text)
    return _docs(spark, d).select("doc_id", V.integral(text).alias("value"))


def protocol_versions(spark, d):
    n = F.col("doc_id")
    v = F.concat(_pick(n % 5, "0.1.", "0.5.", "0.2.", "1.0.", "0.0."), (n % 7).cast("string"), _pick(n % 6, "", "-rc.1", "+b", "-", ".1", "-a_b"))
    return _docs(spark, d).select("doc_id", V.compatibility(v).alias("state"))


def derived_ids(spark, d):
    return R.files(spark, d).select("doc_id", V.id_of_digest("obj", F.col("content_sha256")).alias("id"), P.id_valid(V.id_of_digest("obj", F.col("content_sha256")), "obj").alias("valid"))


def random_ids(spark, d):
    ids = _docs(spark, d).select(V.new_id("obj").alias("id"))
    return ids.agg((F.count_distinct("id") == F.count("*")).alias("distinct"), F.bool_and(P.id_valid(F.col("id"), "obj")).alias("valid"))


def readable_sizes(spark, d):
    size = F.pow(F.lit(7.0), F.col("doc_id") % 16).cast("long") * 2 + F.col("doc_id")
    return _docs(spark, d).select("doc_id", V.human_bytes(size).alias("size"))


def saturated_totals(spark, d):
    n = F.when(F.col("doc_id") % 2 == 0, F.lit((1 << 62) + 1)).otherwise(F.col("doc_id"))
    return _docs(spark, d).select("source", n.alias("n")).groupBy("source").agg(V.saturating_sum("n").alias("total"))


#: Rules of the engine's own in the digests below.
RULES = ["*.tmp", "build/"]


def ignore_policy_digests(spark, d):
    own = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("source"))
    return _docs(spark, d).select("doc_id", V.policy_digest(RULES, own).alias("sha256"))


def row_digests(spark, d):
    return R.files(spark, d).select("doc_id", V.row_digest("path", "bytes", "executable", "target").alias("sha256"))


def json_fields(spark, d):
    v = F.try_parse_json("props")
    kinds = [V.json_kind(v, p).alias(n) for p, n in (("$.k", "k"), ("$.none", "none"), ("$", "whole"))]
    return R.table(spark, d, "events").select("event_id", *kinds, V.json_text(v, "$.k").alias("text"), F.try_variant_get(v, "$.k", "long").alias("number"))


def managed_blocks(spark, d):
    n = F.col("doc_id")
    text = F.concat(F.col("source"), F.when(n % 4 != 1, " <!-- begin -->").otherwise(""), F.lit("old $1"), F.when(n % 4 != 2, "<!-- end --> tail").otherwise(""), F.when(n % 8 == 3, "<!-- end -->").otherwise(""))
    return _docs(spark, d).select("doc_id", V.spliced(text, "<!-- begin -->", "<!-- end -->", F.concat(F.lit("new $0 "), F.col("lang"))).alias("text"))


def version_steps(spark, d):
    p, n = R.table(spark, d, "part"), F.col("p_partkey")
    text = lambda *xs: F.concat_ws(".", *(x.cast("string") for x in xs))
    a, b = text(n % 3, n % 11, F.col("p_size") % 4), text((n + 1) % 3, F.col("p_size") % 12, n % 4)
    b = F.when(n % 29 == 1, "01.2.3").when(n % 29 == 2, "1.2").otherwise(b)
    step = F.when(P.semver(b).isNull(), "invalid").when(P.semver(a) < P.semver(b), "upgrade").when(P.semver(a) == P.semver(b), "same").otherwise("downgrade")
    return p.select(n.alias("id"), step.alias("step"))


def transfer_profiles(spark, d):
    size = F.lit(1 << 30) + (F.col("p_partkey") % 3 - 1)
    return R.table(spark, d, "part").select(F.col("p_partkey").alias("id"), transfer.profile(size).alias("profile"))


def ignore_matches(spark, d):
    rules = ["*.txt", "!src1/**", "src1/en/doc-[1-4]*", "/src2/", "**/fr/doc-?.txt", "!doc-77.txt"]
    e = R.files(spark, d)
    return e.select("path", ignore.ignored(F.col("path"), F.lit(False), rules).alias("ignored"))


def kind_names(spark, d):
    return R.new_version(spark, d)["exclusions"].select("path", inventory.kind_label("kind").alias("label"), inventory.reason_of("kind").alias("reason"))


def reserved_components(spark, d):
    name = _pick(F.col("doc_id") % 8, ".treeline", ".Treeline", ".git", ".GIT", "node_modules", "Node_modules", "target", "src")
    path = F.concat("source", F.lit("/"), name, F.lit("/x"))
    return _docs(spark, d).select("doc_id", *inventory.reserved(path))


def hint_suppression(spark, d):
    n = F.col("event_id")
    paths = F.array(F.concat(F.lit(".treeline/state/private/index/"), n.cast("string")), F.when(n % 3 == 0, ".treeline/state/private/index").otherwise(F.concat(F.lit("src/"), n.cast("string"))))
    e = R.table(spark, d, "events").select("event_id", F.when(n % 5 == 4, F.slice(paths, 1, 1)).otherwise(paths).alias("paths"))
    return inventory.visible_hints(e).select("event_id")


def symlink_objects(spark, d):
    f = R.files(spark, d).where("doc_id % 3 = 1").withColumn("target", F.concat(F.lit("../é"), F.col("doc_id").cast("string")))
    return inventory.symlink_objects(f.withColumn("kind", F.lit(M.SYMLINK))).select("path", "bytes", "content_sha256")


def file_tombstones(spark, d):
    t = R.new_version(spark, d)["tombstones"]
    odd = F.substring("object_id", -1, 1).isin("1", "3")
    t = t.withColumn("deleted_kind", F.when(odd, M.DIRECTORY).otherwise(F.col("deleted_kind"))).withColumn("last_object_version_id", F.when(~odd & (F.substring("object_id", -1, 1) != "7"), F.col("last_object_version_id")))
    return closure.file_tombstones(t)


def collision_kinds(spark, d):
    n = F.floor(F.col("doc_id") / 20)
    name = F.when(n % 3 == 0, _pick(n % 2, "E\u0301", "\u00c9")).otherwise(_pick(n % 2, "A", "a"))
    path = F.concat("source", F.lit("/"), F.when(n % 3 == 0, "e").otherwise("l"), (n % 7).cast("string"), name)
    return checks.collision_kinds(_docs(spark, d).select(path.alias("path")))


def assignment_groups(spark, d):
    return inventory.assignment_groups(R.files(spark, d).select("path"), 32)


QUERIES = {
    f.__name__: f
    for f in (
        hex_values, composed_and_folded, exact_numbers, protocol_versions, derived_ids, random_ids, readable_sizes, saturated_totals, ignore_policy_digests, row_digests, json_fields, managed_blocks, version_steps, transfer_profiles, ignore_matches,
        kind_names, reserved_components, hint_suppression, symlink_objects, file_tombstones, assignment_groups, collision_kinds,
    )
}

_DOC_NUMBER = "doc_id || (['', '.0', 'e3', '.5', 'E+2', '000e-3', 'e-1', '.', ' ', 'e30', '.50e1', '.00'])[1 + doc_id % 12]"
SQL = {
    "hex_values": "WITH c AS (SELECT conv_id, turn, substr(text, 1, 40) AS t FROM conversations) SELECT conv_id, turn, lower(hex(encode(t))) AS hex, CASE WHEN t = '' AND (conv_id * 100 + turn) % 3 <> 1 THEN '' WHEN (conv_id * 100 + turn) % 3 = 2 OR ((conv_id * 100 + turn) % 3 = 0 AND NOT regexp_matches(lower(hex(encode(t))), '[a-f]')) THEN t END AS back FROM c",
    "composed_and_folded": "WITH t AS (SELECT doc_id, nfc_normalize((['E' || chr(769) || 'a', chr(201) || 'A', 'o' || chr(776) || chr(803), 'A' || chr(778), chr(7835) || chr(803)])[1 + doc_id % 5] || source) AS n FROM documents) SELECT doc_id, n AS nfc, CASE WHEN doc_id % 5 < 4 THEN lower(n) END AS fold FROM t",
    "exact_numbers": f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 13 = 5 THEN '0' || {_DOC_NUMBER} WHEN doc_id % 13 = 6 THEN '-' || {_DOC_NUMBER} ELSE {_DOC_NUMBER} END AS x FROM documents), n AS (SELECT doc_id, CASE WHEN regexp_full_match(x, '-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN x::DOUBLE END AS v FROM t) SELECT doc_id, CASE WHEN abs(v) < 9e18 AND v = floor(v) THEN v::BIGINT END AS value FROM n",
    "protocol_versions": "SELECT doc_id, CASE WHEN doc_id % 6 > 2 THEN 'unsupported' ELSE (['supported', 'supported', 'future_minor', 'unsupported', 'unsupported'])[1 + doc_id % 5] END AS state FROM documents",
    "derived_ids": f"WITH {O.FILES}, h AS (SELECT doc_id, content_sha256 AS h, '0123456789abcdef' AS x FROM f) SELECT doc_id, 'obj_' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-7' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos(x, substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id, true AS valid FROM h",
    "random_ids": 'SELECT true AS "distinct", true AS valid',
    "readable_sizes": "WITH s AS (SELECT doc_id, pow(7, doc_id % 16)::BIGINT * 2 + doc_id AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1099511627776 THEN printf('%.1f TiB', n / 1099511627776.0) WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE n || ' B' END AS size FROM s",
    "saturated_totals": "SELECT source, least(sum(CASE WHEN doc_id % 2 = 0 THEN 4611686018427387905 ELSE doc_id END::HUGEINT), 9223372036854775807)::BIGINT AS total FROM documents GROUP BY source",
    "ignore_policy_digests": "SELECT doc_id, sha256(unhex(lower(hex(encode('*.tmp' || chr(10) || 'build/'))) || '00' || CASE doc_id % 3 WHEN 0 THEN '00' WHEN 1 THEN '01' ELSE '01' || hex(encode(source)) END)) AS sha256 FROM documents",
    "row_digests": f"WITH {O.FILES} SELECT doc_id, sha256('{{\"bytes\":' || bytes || ',\"executable\":' || executable || ',\"path\":\"' || path || '\",\"target\":null}}') AS sha256 FROM f",
    "json_fields": "SELECT event_id, 'number' AS k, NULL::VARCHAR AS \"none\", 'object' AS whole, NULL::VARCHAR AS text, json_extract_string(props, '$.k')::BIGINT AS number FROM events",
    "managed_blocks": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 8 = 7 THEN source || ' <!-- begin -->new $0 ' || lang || '<!-- end --> tail' END AS text FROM documents",
    "version_steps": "WITH v AS (SELECT p_partkey AS id, [p_partkey % 3, p_partkey % 11, p_size % 4] AS a, [(p_partkey + 1) % 3, p_size % 12, p_partkey % 4] AS b FROM part) SELECT id, CASE WHEN id % 29 IN (1, 2) THEN 'invalid' WHEN a < b THEN 'upgrade' WHEN a = b THEN 'same' ELSE 'downgrade' END AS step FROM v",
    "transfer_profiles": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'standard-v1' ELSE 'large-v1' END AS profile FROM part",
    "ignore_matches": f"WITH {O.FILES} SELECT path, CASE WHEN regexp_matches(path, '(^|/)doc-77[.]txt$') THEN false WHEN regexp_matches(path, '^(.*/)?fr/doc-[^/][.]txt$') THEN true WHEN regexp_matches(path, '^src1/en/doc-[1-4][^/]*$') THEN true WHEN starts_with(path, 'src1/') THEN false ELSE true END AS ignored FROM f",
    "kind_names": f"WITH {O.VERSIONS} SELECT path, CASE kind WHEN 'nested_root' THEN 'nested root' ELSE 'hard link' END AS label, reason FROM nx",
    "reserved_components": "SELECT doc_id, doc_id % 8 IN (0, 1) AS state, doc_id % 8 IN (2, 3) AS version_control, doc_id % 8 IN (4, 6) AS reconstructable FROM documents",
    "hint_suppression": "SELECT event_id FROM events WHERE event_id % 5 <> 4 AND event_id % 3 <> 0",
    "symlink_objects": f"WITH {O.FILES}, t AS (SELECT path, '../' || chr(233) || doc_id AS t FROM f WHERE doc_id % 3 = 1) SELECT path, octet_length(encode(t))::BIGINT AS bytes, sha256(t) AS content_sha256 FROM t",
    "file_tombstones": f"WITH {O.VERSIONS} SELECT path, object_id, deleted_kind, last_object_version_id FROM nt WHERE right(object_id, 1) NOT IN ('1', '3', '7')",
    "collision_kinds": "WITH p AS (SELECT source || '/' || CASE WHEN doc_id // 20 % 3 = 0 THEN 'e' ELSE 'l' END || (doc_id // 20 % 7) || CASE WHEN doc_id // 20 % 3 = 0 THEN (['E' || chr(769), chr(201)])[1 + doc_id // 20 % 2] ELSE (['A', 'a'])[1 + doc_id // 20 % 2] END AS path FROM documents), k AS (SELECT lower(nfc_normalize(path)) AS key, count(DISTINCT path) AS n, count(DISTINCT nfc_normalize(path)) AS c FROM p GROUP BY 1) SELECT key, CASE WHEN c < n THEN 'composed' ELSE 'folded' END AS kind FROM k WHERE n > 1",
    "assignment_groups": f"WITH {O.FILES} SELECT source AS root, 'txt' AS kind, count(*) AS n, min(path) AS first, max(path) AS last FROM f GROUP BY source",
}
