"""Change sets: matching a checkout with its base, deltas, conflicts with the source, and the merged result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, at_or_below, portable
from ..functions.unicode import folded
from ..model import DIRECTORY, FILE, SYMLINK
from ..plans.staging import staged

_CONTENT = ("kind", "content_sha256", "bytes", "executable", "target")
_STATE = ("path", *_CONTENT)


def _content_key():
    return F.sha2(F.to_json(F.struct(*_CONTENT), {"ignoreNullFields": "false"}), 256)


def projection(rows: DataFrame, prefixes: list[str] | None, state: str | None = None) -> DataFrame:
    """Rows at or below an authorised prefix (None: the whole root) and outside the protocol's directory."""
    out = rows
    if prefixes is not None:
        wanted = F.array(*map(F.lit, prefixes)) if prefixes else F.array().cast("array<string>")
        out = out.where(F.arrays_overlap(ancestors(F.col("path"), itself=True), wanted))
    return out if state is None else out.where(~at_or_below(F.col("path"), F.lit(state)))


def below_boundary(rows: DataFrame, boundaries: DataFrame, keep: bool = False) -> DataFrame:
    """`rows` without (or with `keep` only) those at or below a boundary path, by an equi-join on exploded ancestors."""
    paths = rows.select("path").distinct().select("path", F.explode(ancestors(F.col("path"), itself=True)).alias("_up"))
    hidden = paths.join(boundaries.select(F.col("path").alias("_up")).distinct(), "_up", "left_semi").select("path").distinct()
    return rows.join(hidden, "path", "left_semi" if keep else "left_anti")


def matches(base: DataFrame, current: DataFrame) -> DataFrame:
    """(base_path, current_path) of base rows and the current rows that continue them.

    By path and kind; then a current row takes the base row of equal content if that is the only one left, the first
    such current row by path; then the last base and current row of a kind (files, links) if there is one of each.
    """
    b, c = (df.select("path", "kind", _content_key().alias("key")) for df in (base, current))
    first = b.join(c.select("path", "kind"), ["path", "kind"]).select(F.col("path").alias("base_path"), F.col("path").alias("current_path"))
    b = b.join(first.select(F.col("base_path").alias("path")), "path", "left_anti").where(F.col("kind") != DIRECTORY)
    c = c.join(first.select(F.col("current_path").alias("path")), "path", "left_anti").where(F.col("kind") != DIRECTORY)
    lone = b.groupBy("key").agg(F.count("*").alias("n"), F.min("path").alias("base_path")).where("n = 1")
    second = c.groupBy("key").agg(F.min("path").alias("current_path")).join(lone, "key").select("base_path", "current_path")
    b = b.join(second.select(F.col("base_path").alias("path")), "path", "left_anti").where(F.col("kind").isin(FILE, SYMLINK))
    c = c.join(second.select(F.col("current_path").alias("path")), "path", "left_anti").where(F.col("kind").isin(FILE, SYMLINK))
    one = lambda df, name: df.groupBy("kind").agg(F.count("*").alias("n"), F.min("path").alias(name)).where("n = 1").drop("n")
    third = one(b, "base_path").join(one(c, "current_path"), "kind").select("base_path", "current_path")
    return first.unionByName(second).unionByName(third)


def deltas(base: DataFrame, current: DataFrame, mint=None) -> DataFrame:
    """(object_id, before, after) of each changed object: a change or move of a match, a deletion, or a creation.

    mint: column for the id of a created object, by default a digest of its path.
    """
    mint = F.concat(F.lit("obj_new_"), F.sha2("a.path", 256)) if mint is None else mint
    m = matches(base, current)
    state = lambda side: F.when(F.col(f"{side}.path").isNotNull(), F.struct(*(F.col(f"{side}.{x}") for x in _STATE)))
    pairs = base.alias("b").join(m, F.col("b.path") == F.col("base_path"), "left").join(current.alias("a"), F.col("current_path") == F.col("a.path"), "full_outer")
    out = pairs.select(F.coalesce(F.col("b.object_id"), mint).alias("object_id"), state("b").alias("before"), state("a").alias("after"))
    return out.where(~F.col("before").eqNullSafe(F.col("after")))


def conflicts(changes: DataFrame, current: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(code, path, other_path, object_id): at most one conflict of each delta (object_id, before, after) with the source's current rows, in the order of precedence.

    boundaries (path): nested roots. Paths that collide only in case are aliases; of several the first by path is named.
    """
    changes = staged(changes)
    d = changes.select("object_id", "before", "after", F.col("before.path").alias("bp"), F.col("after.path").alias("ap"))
    touched = d.select("object_id", F.explode(F.array("bp", "ap")).alias("path"), F.expr("0").alias("_")).where("path is not null")
    nested = below_boundary(touched, boundaries, keep=True).groupBy("object_id").agg(F.collect_set("path").alias("nested"))
    now = current.select(F.col("path").alias("_p"), F.struct(*_CONTENT).alias("_c"))
    d = d.join(nested, "object_id", "left")
    d = d.join(now.select(F.col("_p").alias("bp"), F.col("_c").alias("at_before")), "bp", "left")
    d = d.join(now.select(F.col("_p").alias("ap"), F.col("_c").alias("at_after")), "ap", "left")
    keyed = current.select(folded(F.col("path")).alias("fold"), F.col("path").alias("other"))
    alias = d.where("ap is not null").select("object_id", "ap", "bp", folded(F.col("ap")).alias("fold")).join(keyed, "fold")
    alias = alias.where("other <> ap and not (other <=> bp)").groupBy("object_id").agg(F.min("other").alias("alias"))
    d = d.join(alias, "object_id", "left")
    edited = ~F.struct(*(F.col(f"before.{c}") for c in _CONTENT)).eqNullSafe(F.col("at_before"))
    create, here = F.col("before").isNull(), F.col("at_before").isNotNull()
    moves = F.col("after").isNotNull() & ~create & (F.col("ap") != F.col("bp"))
    none = F.lit(None).cast("string")
    row = lambda code, path, other=none: F.struct(F.lit(code).alias("code"), path.alias("path"), other.alias("other_path"))
    bp, ap = F.col("bp"), F.col("ap")
    found = F.when(F.col("nested").isNotNull(), row("nested_boundary", F.when(F.array_contains("nested", bp), bp).otherwise(ap)))
    found = found.when(create & F.col("at_after").isNotNull(), row("create_create", ap))
    found = found.when(create & F.col("alias").isNotNull(), row("path_alias", ap, F.col("alias")))
    found = found.when(~create & here & edited & F.col("after").isNull(), row("delete_edit", bp))
    found = found.when(~create & here & edited & moves, row("move_edit", bp)).when(~create & here & edited, row("edit_edit", bp))
    found = found.when(here & moves & F.col("at_after").isNotNull(), row("path_occupied", ap, bp))
    found = found.when(here & moves & F.col("alias").isNotNull(), row("path_alias", ap, F.col("alias")))
    found = found.when(~create & ~here & F.col("after").isNotNull(), row("edit_delete", bp))
    return d.select("object_id", found.alias("f")).where("f is not null").select("f.code", "f.path", "f.other_path", "object_id")


def applied(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Current rows (path, object_id, state) after the deltas: what was before goes, what is after comes."""
    kept = current.join(changes.where("before is not null").select("object_id"), "object_id", "left_anti")
    new = changes.where("after is not null").select("object_id", *(F.col(f"after.{c}").alias(c) for c in _STATE))
    return kept.select("object_id", *_STATE).unionByName(new)


def replay_safe(applied_digests: DataFrame, digest: str) -> bool:
    """Whether a change set of this digest has been applied, so that a replay is answered and not run again."""
    return not applied_digests.where(F.col("change_set_sha256") == digest).isEmpty()


def envelope_findings(changes: DataFrame, most: int | None = 16_384) -> DataFrame:
    """(code, object_id): no deltas or more than `most` (None: they aren't counted), deltas without both sides, without change, with repeated objects, or ending on one path."""
    empty = changes.where("before is null and after is null").select(F.lit("empty_delta").alias("code"), "object_id")
    same = changes.where("before is not null and before <=> after").select(F.lit("unchanged_delta").alias("code"), "object_id")
    twice = changes.groupBy("object_id").count().where("count > 1").select(F.lit("repeated_object").alias("code"), "object_id")
    ends = changes.where("after is not null").select("object_id", folded(F.col("after.path")).alias("k"))
    many = ends.groupBy("k").agg(F.count("*").alias("n"), F.min("object_id").alias("object_id")).where("n > 1").select(F.lit("final_path_collision").alias("code"), "object_id")
    found = empty.unionByName(same).unionByName(twice).unionByName(many)
    if most is None:
        return found
    n = changes.agg(F.count("*").alias("n")).where(~F.col("n").between(1, most)).select(F.lit("delta_count").alias("code"), F.lit(None).cast("string").alias("object_id"))
    return n.unionByName(found)


def checkout_findings(prefixes: list[str]) -> list[str]:
    """What is wrong with the authorised prefixes of a checkout: `not_portable`, `not_sorted` (strictly, by bytes), `overlapping`."""
    out = [] if all(map(portable, prefixes)) else ["not_portable"]
    keys = [p.encode() for p in prefixes]
    if any(a >= b for a, b in zip(keys, keys[1:], strict=False)):
        out.append("not_sorted")
    held = set(prefixes)
    if any("/".join(p.split("/")[:i]) in held for p in prefixes for i in range(1, p.count("/") + 1)):
        out.append("overlapping")
    return out


def checkout(bindings: DataFrame, boundaries: DataFrame, prefixes: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The rows that a checkout of a version writes (path, object_id, state), none of them below a nested root, and its receipt: one row with the count and a digest of what was handed out, for the later change set to be compared with."""
    if prefixes is not None and (found := checkout_findings(prefixes)):
        raise ValueError(", ".join(found))
    rows = below_boundary(projection(bindings, prefixes), boundaries).select("object_id", *_STATE)
    digest = F.sha2(F.to_json(F.struct("object_id", *_STATE), {"ignoreNullFields": "false"}), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(8)]
    return rows, rows.agg(F.count("*").alias("entries"), F.sha2(F.concat_ws("/", *sums), 256).alias("receipt_sha256"))


def applied_once(current: DataFrame, changes: DataFrame, conflicts_found: DataFrame, digests: DataFrame, digest: str) -> tuple[str, DataFrame]:
    """(outcome, rows): `already_applied` for a change set whose digest is known, `conflicted` where there are conflicts (both leave rows as they were), else `applied` with the merged rows."""
    if replay_safe(digests, digest):
        return "already_applied", current
    if not conflicts_found.isEmpty():
        return "conflicted", current
    return "applied", applied(current, changes)
