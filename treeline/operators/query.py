"""Bounded metadata queries: a fixed filter algebra, a total row order, and keyset pages.

Values within a filter family are alternatives, families must all hold, an empty family does not restrict. Exclusions are
never filtered. The driver holds only the request, digests and one page's cursor.
"""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions import paths as P

#: Prefixes up to this many become one comparison each; more are looked up among a path's ancestors.
PREFIX_LIMIT = 16


class QueryError(ValueError):
    """code: what a caller can act on."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


@dataclass(frozen=True)
class Request:
    paths: tuple[str, ...] = ()
    path_prefixes: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    lifecycles: tuple[str, ...] = ()
    object_ids: tuple[str, ...] = ()
    object_version_ids: tuple[str, ...] = ()
    minimum_bytes: int | None = None
    maximum_bytes: int | None = None
    limit: int = 100
    cursor: str | None = None
    scope: dict = field(default_factory=lambda: {"kind": "live"})


def _normal_paths(values) -> tuple[str, ...]:
    values = tuple(sorted(set(values), key=lambda x: x.encode()))
    if len(values) > M.MAX_VALUES or not all(map(P.portable, values)):
        raise QueryError("invalid_query_request", "a path is not portable, or there are too many")
    for key in (lambda x: unicodedata.normalize("NFC", x), lambda x: unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold())):
        if len({key(v) for v in values}) < len(values):
            raise QueryError("invalid_query_request", "paths collide")
    return values


def normalized(request: Request) -> Request:
    """The request with sorted distinct values; QueryError if a bound is broken."""
    if not 1 <= request.limit <= M.MAX_PAGE:
        raise QueryError("invalid_query_request", "limit")
    kinds, lifecycles = tuple(sorted(set(request.kinds))), tuple(sorted(set(request.lifecycles)))
    if set(kinds) - set(M.KIND_RANK) or set(lifecycles) - set(M.LIFECYCLE_RANK):
        raise QueryError("invalid_query_request", "unknown kind or lifecycle")
    for low in (request.minimum_bytes, request.maximum_bytes):
        if low is not None and not 0 <= low <= M.MAX_OBJECT_BYTES:
            raise QueryError("invalid_query_request", "byte bound")
    if request.maximum_bytes is not None and (request.minimum_bytes or 0) > request.maximum_bytes:
        raise QueryError("invalid_query_request", "byte bounds are reversed")
    ids = [tuple(sorted(set(v))) for v in (request.object_ids, request.object_version_ids)]
    for values, prefix in zip(ids, ("obj", "version"), strict=True):
        if len(values) > M.MAX_VALUES or not all(P.identifier(v, prefix) for v in values):
            raise QueryError("invalid_query_request", "an id is malformed, or there are too many")
    return replace(request, paths=_normal_paths(request.paths), path_prefixes=_normal_paths(request.path_prefixes), kinds=kinds, lifecycles=lifecycles, object_ids=ids[0], object_version_ids=ids[1])


def request_digest(request: Request, domain: str, form: str, scope: dict | None = None) -> str:
    """SHA-256 of a domain, a zero byte and the normalised request as compact JSON in declared order."""
    r = normalized(request)
    filters = {"paths": r.paths, "path_prefixes": r.path_prefixes, "kinds": r.kinds, "lifecycles": r.lifecycles, "object_ids": r.object_ids, "object_version_ids": r.object_version_ids}
    filters |= {k: v for k, v in (("minimum_bytes", r.minimum_bytes), ("maximum_bytes", r.maximum_bytes)) if v is not None}
    value = {"format": form, "scope": scope or r.scope, "filters": filters, "page": {"limit": r.limit}}
    return hashlib.sha256(domain.encode() + b"\0" + json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def live_rows(entries: DataFrame, boundaries: DataFrame | None = None, bindings: DataFrame | None = None) -> DataFrame:
    """Query rows of live entries (path, kind, bytes, executable, symlink_target), with the identity of the head's binding of the same path and kind; nested roots become rows of their own."""
    rows = entries
    if bindings is not None:
        b = bindings.select(F.col("path").alias("_p"), F.col("kind").alias("_k"), "object_id", "object_version_id", "version_id")
        rows = entries.join(b, (entries.path == F.col("_p")) & (entries.kind == F.col("_k")), "left")
    else:
        rows = entries.withColumns({c: F.lit(None).cast("string") for c in ("object_id", "object_version_id", "version_id")})
    out = rows.select("path", "kind", F.lit(M.LIVE).alias("lifecycle"), "bytes", "executable", "symlink_target", "object_id", "object_version_id", "version_id", F.lit("capture_plan").alias("source"), F.lit(None).cast("string").alias("boundary_reason"))
    if boundaries is not None:
        nested = boundaries.where(F.col("kind") == M.NESTED)
        out = out.unionByName(_boundary_rows(nested, F.lit(None).cast("string"), "capture_plan"))
    return out


def _boundary_rows(nested: DataFrame, version_id, source: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return nested.select("path", F.lit(M.NESTED).alias("kind"), F.lit(M.LIVE).alias("lifecycle"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("boolean").alias("executable"), none.alias("symlink_target"), none.alias("object_id"), none.alias("object_version_id"), version_id.alias("version_id"), F.lit(source).alias("source"), F.lit(M.NESTED_REASON).alias("boundary_reason"))


def historical_rows(bindings: DataFrame, tombstones: DataFrame, exclusions: DataFrame, version_id: str) -> DataFrame:
    """Query rows of one version: live bindings, retained deletions without facts, and nested roots."""
    none, at = F.lit(None).cast("string"), F.lit(version_id)
    live = bindings.where(F.col("version_id") == version_id).select("path", "kind", F.lit(M.LIVE).alias("lifecycle"), "bytes", "executable", F.col("target").alias("symlink_target"), "object_id", "object_version_id", at.alias("version_id"), F.lit("version").alias("source"), none.alias("boundary_reason"))
    dead = tombstones.where(F.col("version_id") == version_id).select("path", F.col("deleted_kind").alias("kind"), F.lit(M.DELETED).alias("lifecycle"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("boolean").alias("executable"), none.alias("symlink_target"), "object_id", F.col("last_object_version_id").alias("object_version_id"), at.alias("version_id"), F.lit("version").alias("source"), none.alias("boundary_reason"))
    nested = exclusions.where((F.col("version_id") == version_id) & (F.col("kind") == M.NESTED))
    return live.unionByName(dead).unionByName(_boundary_rows(nested, at, "version"))


def filtered(rows: DataFrame, request: Request) -> DataFrame:
    r = normalized(request)
    for column, values in (("path", r.paths), ("kind", r.kinds), ("lifecycle", r.lifecycles), ("object_id", r.object_ids), ("object_version_id", r.object_version_ids)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    if r.path_prefixes:
        if len(r.path_prefixes) <= PREFIX_LIMIT:
            rows = rows.where(reduce(lambda a, b: a | b, [(F.col("path") == p) | F.col("path").startswith(p + "/") for p in r.path_prefixes]))
        else:  # at most MAX_VALUES prefixes
            rows = rows.where(F.arrays_overlap(P.ancestors(F.col("path"), itself=True), F.array(*map(F.lit, r.path_prefixes))))
    if r.minimum_bytes is not None:
        rows = rows.where(F.col("bytes") >= r.minimum_bytes)
    if r.maximum_bytes is not None:
        rows = rows.where(F.col("bytes") <= r.maximum_bytes)
    return rows


def _rank(column: str, ranks: dict[str, int]):
    out = F.lit(None).cast("int")
    for name, rank in ranks.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def row_key():
    """The total order as one comparable struct; nulls come first."""
    ranks = [_rank("lifecycle", M.LIFECYCLE_RANK).alias("l"), _rank("kind", M.KIND_RANK).alias("k")]
    return F.struct("path", *ranks, "object_id", "object_version_id", "version_id", _rank("source", M.SOURCE_RANK).alias("s"), "boundary_reason")


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(row_key())


def page(rows: DataFrame, request: Request, last: tuple | None = None) -> DataFrame:
    """The page after the row key `last`, one row longer than the limit if there are more rows."""
    rows = filtered(rows, request).withColumn("_key", row_key())
    if last is not None:
        types = ("string", "int", "int", "string", "string", "string", "int", "string")
        names = ("path", "l", "k", "object_id", "object_version_id", "version_id", "s", "boundary_reason")
        rows = rows.where(F.col("_key") > F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(last, types, names, strict=True))))
    return rows.orderBy("_key").limit(request.limit + 1)


def run(rows: DataFrame, exclusions: DataFrame, request: Request, generation: str, digest: str) -> dict:
    """One page: rows, has_more, next_cursor, and the first exclusions with whether there are more. A cursor of another request is invalid; one of another generation means that the snapshot changed."""
    last = None
    if request.cursor:
        try:
            held = json.loads(base64.urlsafe_b64decode(request.cursor))
            last = tuple(held["last"])
        except (ValueError, KeyError, TypeError) as error:
            raise QueryError("invalid_query_cursor") from error
        if held["request"] != digest:
            raise QueryError("invalid_query_cursor")
        if held["generation"] != generation:
            raise QueryError("query_snapshot_changed")
    got = page(rows, request, last).collect()
    more, got = len(got) > request.limit, got[: request.limit]
    cursor = None
    if more:
        cursor = base64.urlsafe_b64encode(json.dumps({"request": digest, "generation": generation, "last": list(got[-1]["_key"])}).encode()).decode()
    left_out = capped_exclusions(exclusions).collect()
    return {"entries": [{c: r[c] for c in M.QUERY_COLUMNS} for r in got], "has_more": more, "next_cursor": cursor, "exclusions": [r.asDict() for r in left_out[: M.MAX_EXCLUSIONS]], "exclusions_truncated": len(left_out) > M.MAX_EXCLUSIONS}


def capped_exclusions(exclusions: DataFrame, most: int = M.MAX_EXCLUSIONS) -> DataFrame:
    """The first exclusions by path, one more than reported so that a caller sees truncation."""
    return exclusions.orderBy("path").limit(most + 1)


def explain(rows: DataFrame, request: Request, strategy: str = "bounded_scan") -> dict:
    """The normalised request, order, algebra, access path and the count before any cursor."""
    return {"request": normalized(replace(request, cursor=None)), "ordering": "row_key_v1", "algebra": "families_and_values_or", "strategy": strategy, "matched": filtered(rows, request).count()}


def exclusion_rows(excluded: DataFrame, ignored: DataFrame) -> DataFrame:
    """Typed exclusions and ignored paths (without kind) in one relation (path, reason, kind)."""
    return excluded.select("path", "reason", "kind").unionByName(ignored.select("path", F.lit(M.IGNORED_REASON).alias("reason"), F.lit(None).cast("string").alias("kind")))


def generation(entries: DataFrame, exclusions: DataFrame, *parts: str) -> str:
    """A digest that changes if anything observed does: an order-free sum over rows' digests, so that no task sees all rows."""
    digests = []
    for tag, df in (("E", entries), ("X", exclusions)):
        row = F.sha2(F.concat(F.lit(tag), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})), 256)
        pieces = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
        digests.append(str(list(df.agg(F.count("*").alias("n"), *pieces).first())))
    return hashlib.sha256("\0".join([*digests, *parts]).encode()).hexdigest()


def ordered_digest(entries: DataFrame, exclusions: DataFrame, domain: str = "live-observation-v1") -> DataFrame:
    """One row: SHA-256 over all rows in path order, each with its tag, its length in eight bytes and its JSON; null beyond MAX_ENTRIES rows, which is the most that one task is given."""
    parts = []
    for tag, df in (("E", entries), ("X", exclusions)):
        body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        framed = F.concat(F.hex(F.lit(tag)), F.lpad(F.hex(F.octet_length(body).cast("long")), 16, "0"), F.hex(F.encode(body, "UTF-8")))
        parts.append(df.select(F.struct(F.lit(tag).alias("t"), "path", framed.alias("h")).alias("r")))
    every = parts[0].unionByName(parts[1])
    held = every if every.limit(M.MAX_ENTRIES + 1).count() <= M.MAX_ENTRIES else every.limit(0)
    fits = F.lit(held is every)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), "")
    return held.agg(F.when(fits, F.sha2(F.unhex(F.concat(F.hex(F.lit(domain)), F.lit("00"), text)), 256)).alias("sha256"))


def domain_digest(domain: str, value) -> str:
    """SHA-256 of a domain, a zero byte and a value as compact JSON with sorted members: cursors, plans, projections and the like each have a domain of their own."""
    return hashlib.sha256(domain.encode() + b"\0" + json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
