"""Validators of JSON records: manifests, object records, content, and states. Records are rows (path, json) in; findings (path, code, detail) out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import values as V

# What enumerated fields may hold.
ROOT_KINDS = ["person", "organization", "engagement", "project", "customer", "temporary", "custom"]
ROOT_STATUSES = ["active", "paused", "archived"]
POLICIES = {"availability": ["keep_local", "managed", "cloud_only"], "structural_changes": ["suggest", "approve", "autonomous"], "archive": ["manual", "approve", "automatic"], "cloud_sync": ["disabled", "enabled"]}
LIFECYCLES = ["draft", "canonical", "superseded", "archived", "deleted"]
MIGRATION_FIELDS = ["protocol_version", "id", "state", "source_inventory", "base_root_version", "questions", "proposed_roots", "operations", "exclusions", "storage_impact", "rollback"]
MIGRATION_STATES = ["analyzing", "questions", "proposed", "approved", "applying", "verified", "rejected", "rolled_back"]
CHANGE_SET_FIELDS = ["id", "checkout_id", "base_version", "operations", "status"]
CHANGE_SET_STATES = ["proposed", "approved", "applying", "applied", "conflicted", "rejected"]
_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
_TOKEN = r"\A[a-z][a-z0-9_]*\z"


def _variant(records: DataFrame) -> DataFrame:
    return records.select("path", F.try_parse_json("json").alias("v"))


def _text(pointer: str):
    return V.json_text(F.col("v"), pointer)


def _kind(pointer: str):
    return F.coalesce(V.json_kind(F.col("v"), pointer), F.lit("none"))


def _blank(text):
    return F.coalesce(F.trim(text) == "", F.lit(True))


def _none_of(text, allowed: list[str]):
    return ~F.coalesce(text.isin(allowed), F.lit(False))


def _timestamp(text):
    return F.coalesce(text.rlike(_TIME) & F.try_to_timestamp(F.upper(text)).isNotNull(), F.lit(False))


def _id(text, prefix: str):
    return F.coalesce(P.id_valid(text, prefix), F.lit(False))


def _findings(rows: DataFrame, tests: list[tuple]) -> DataFrame:
    """Findings of all tests (code, detail, condition) that hold, in one pass over the rows."""
    found = F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(detail).cast("string").alias("detail"))) for code, detail, test in tests))
    each = F.explode(F.filter(found, lambda x: x.isNotNull()))
    return rows.select("path", each.alias("f")).select("path", "f.code", "f.detail")


def manifest_findings(records: DataFrame) -> DataFrame:
    """Findings of root manifests: protocol version, identity, enumerated fields, adapters, policies. A later minor version is a finding too, though only a warning."""
    rows = _variant(records)
    whole, root, policies = _kind("$") == "object", _kind("$.root") == "object", _kind("$.policies") == "object"
    version = V.compatibility(_text("$.protocol_version"))
    inside = whole & root
    tests = [
        ("manifest_not_object", None, ~whole),
        ("missing_protocol_version", None, whole & version.isNull()),
        ("unsupported_protocol_version", None, whole & (version == "unsupported")),
        ("future_protocol_minor", None, whole & (version == "future_minor")),
        ("missing_root_record", None, whole & ~root),
        ("invalid_root_id", None, inside & ~_id(_text("$.root.id"), "root")),
        ("missing_root_name", None, inside & _blank(_text("$.root.name"))),
        ("invalid_root_kind", None, inside & _none_of(_text("$.root.kind"), ROOT_KINDS)),
        ("invalid_root_status", None, inside & _none_of(_text("$.root.status"), ROOT_STATUSES)),
        ("invalid_created_at", None, inside & ~_timestamp(_text("$.root.created_at"))),
        ("invalid_adapters", None, inside & ~_kind("$.adapters").isin("none", "array")),
        ("missing_policies", None, inside & _kind("$.adapters").isin("none", "array") & ~policies),
        *((f"invalid_{name}_policy", None, inside & policies & _none_of(_text(f"$.policies.{name}"), allowed)) for name, allowed in POLICIES.items()),
    ]
    listed = rows.where(inside & (_kind("$.adapters") == "array")).select("path", F.posexplode(F.try_variant_get("v", "$.adapters", "array<variant>")).alias("i", "v"))
    place = F.col("i").cast("string")
    each = [("invalid_adapter_agent", _blank(_text("$.agent"))), ("missing_adapter_path", _text("$.path").isNull()), ("adapter_path_not_portable", ~P.path_valid(_text("$.path")))]
    adapters = [listed.where(F.coalesce(test, F.lit(False))).select("path", F.lit(code).alias("code"), place.alias("detail")) for code, test in each]
    return reduce(DataFrame.unionByName, adapters, _findings(rows, tests))


def object_findings(records: DataFrame) -> DataFrame:
    """Findings of object records: id, type, lifecycle, provenance, path, relationships, ids used twice, and targets that no record has."""
    rows = _variant(records)
    whole, status, path = _kind("$") == "object", _text("$.lifecycle.status"), _text("$.path")
    origin = _kind("$.provenance") == "object"
    number = lambda p: F.try_variant_get("v", p, "long").isNotNull() & (_kind(p) == "number")
    tests = [
        ("object_json_invalid", None, F.col("v").isNull()),
        ("object_not_object", None, F.col("v").isNotNull() & ~whole),
        ("invalid_object_id", None, whole & ~_id(_text("$.id"), "obj")),
        ("invalid_object_type", None, whole & ~F.coalesce(_text("$.type").rlike(_TOKEN), F.lit(False))),
        ("invalid_object_lifecycle", None, whole & _none_of(status, LIFECYCLES)),
        ("invalid_superseded_by", None, whole & _text("$.lifecycle.superseded_by").isNotNull() & ~_id(_text("$.lifecycle.superseded_by"), "obj")),
        ("missing_superseded_by", None, whole & (status == "superseded") & (_kind("$.lifecycle.superseded_by") == "none")),
        *(("missing_archive_size", name, whole & (status == "archived") & ~number(f"$.lifecycle.{name}")) for name in ("remote_size", "expected_restore_size")),
        ("missing_object_provenance", None, whole & ~origin),
        ("invalid_object_created_at", None, whole & origin & ~_timestamp(_text("$.provenance.created_at"))),
        ("invalid_object_source", None, whole & origin & _blank(_text("$.provenance.source"))),
        ("source_path_not_portable", None, whole & origin & ~P.path_valid(_text("$.provenance.source_path"))),
        ("missing_object_path", None, whole & path.isNull()),
        ("path_not_portable", None, whole & ~P.path_valid(path)),
        ("invalid_relationships", None, whole & ~_kind("$.relationships").isin("none", "array")),
    ]
    ids = rows.where(whole & _id(_text("$.id"), "obj")).select("path", _text("$.id").alias("id"))
    first = ids.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")
    twice = ids.join(first, "id").where("path <> first").select("path", F.lit("duplicate_object_id").alias("code"), F.col("id").alias("detail"))
    links = rows.where(whole & (_kind("$.relationships") == "array")).select("path", F.posexplode(F.try_variant_get("v", "$.relationships", "array<variant>")).alias("i", "v"))
    target, outside = _text("$.target"), _kind("$.external") == "object"
    named = ~_blank(_text("$.external.kind")) & ~_blank(_text("$.external.id"))
    fault = F.when(target.isNull() == ~outside, "ambiguous_relationship_target").when(target.isNotNull() & ~_id(target, "obj"), "invalid_relationship_target").when(outside & ~named, "invalid_external_relationship")
    place = F.col("i").cast("string").alias("detail")
    wrong = links.select("path", fault.alias("code"), place).where("code is not null")
    typed = links.where(~F.coalesce(_text("$.type").rlike(_TOKEN), F.lit(False))).select("path", F.lit("invalid_relationship_type").alias("code"), place)
    wanted = links.where(~outside & _id(target, "obj")).select("path", target.alias("detail"))
    lost = wanted.join(ids.select(F.col("id").alias("detail")).distinct(), "detail", "left_anti").select("path", F.lit("unresolved_relationship_target").alias("code"), "detail")
    return reduce(DataFrame.unionByName, [twice, wrong, typed, lost], _findings(rows, tests))


def content_findings(records: DataFrame, contents: DataFrame) -> DataFrame:
    """Findings of object records whose content is there (path, sha256): no digest, another algorithm, another content. Digests compare in any case; sizes aren't compared."""
    rows = _variant(records).withColumn("file", _text("$.path")).join(contents.select(F.col("path").alias("file"), F.col("sha256").alias("actual")), "file")
    algorithm, digest = _text("$.content.algorithm"), _text("$.content.digest")
    code = F.when((algorithm == "sha256") & digest.isNotNull(), F.when(F.lower(digest) != F.lower("actual"), "content_digest_mismatch")).when(algorithm.isNotNull() & (algorithm != "sha256"), "unsupported_digest_algorithm").otherwise("missing_content_digest")
    place = F.when(code == "content_digest_mismatch", F.col("file")).otherwise(F.col("path"))
    return rows.select(place.alias("path"), code.alias("code"), F.lit(None).cast("string").alias("detail")).where("code is not null")


def state_findings(records: DataFrame, fields: list[str], state: str, allowed: list[str]) -> DataFrame:
    """Findings of migration or change-set records: required members, operations as a list, and a known state."""
    rows = _variant(records)
    whole = _kind("$") == "object"
    tests = [
        ("state_record_json_invalid", None, F.col("v").isNull()),
        ("state_record_not_object", None, F.col("v").isNotNull() & ~whole),
        *(("missing_record_field", f, whole & (_kind(f"$.{f}") == "none")) for f in fields),
        ("invalid_record_operations", None, whole & ~_kind("$.operations").isin("none", "array")),
        ("invalid_record_state", None, whole & _none_of(_text(f"$.{state}"), allowed)),
    ]
    return _findings(rows, tests)


def records_at(records: DataFrame, path: str) -> DataFrame:
    """Object records (path, json) that describe the file `path`, with `repeated`: several records of one file are an error to their reader."""
    hit = _variant(records).where(_text("$.path") == path).select("path", _text("$.id").alias("object_id"))
    return hit.withColumn("repeated", F.lit(hit.count() > 1))
