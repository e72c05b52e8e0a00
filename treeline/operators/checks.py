"""Validators: rows in, findings out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import unicode
from ..model import EXCLUSION_REASONS, MAX_ENTRIES, MAX_OBJECT_BYTES, NESTED
from ..plans.staging import ranged, staged
from .change_set import below_boundary


def finding(df: DataFrame, code: str, path="path", severity: str = "error") -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(path).cast("string").alias("path"))


def collisions(rows: DataFrame) -> DataFrame:
    """(key, n): collision keys that several distinct paths share."""
    return rows.where("path is not null").groupBy(unicode.folded(F.col("path")).alias("key")).agg(F.count_distinct("path").alias("n")).where("n > 1")


def collision_kinds(rows: DataFrame) -> DataFrame:
    """(key, kind) of collisions: `composed` if paths are equal once composed (NFC), `folded` if only case folding makes them equal."""
    p = rows.where("path is not null").select("path", unicode.composed(F.col("path")).alias("_c")).withColumn("key", unicode.folded(F.col("path")))
    n = p.groupBy("key").agg(F.count_distinct("path").alias("n"), F.count_distinct("_c").alias("c")).where("n > 1")
    return n.select("key", F.when(F.col("c") < F.col("n"), "composed").otherwise("folded").alias("kind"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, path): keys of several rows and the first path."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")


def owners(bindings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(object_version_id, n): object versions that several objects claim."""
    both = bindings.select("object_version_id", "object_id").unionByName(tombstones.select(F.col("last_object_version_id").alias("object_version_id"), "object_id"))
    return both.where("object_version_id is not null").groupBy("object_version_id").agg(F.count_distinct("object_id").alias("n")).where("n > 1")


def out_of_order(rows: DataFrame, key: str, position: str, partition: str | None = None) -> DataFrame:
    """Rows whose key doesn't exceed that of the row before, by position; with `partition`, of each of many relations.

    One long relation is dealt out in ranges of positions; each range is compared within, and its first row with the last
    one of the ranges before, a row for each range.
    """
    if partition:
        w = Window.partitionBy(partition).orderBy(position)
        return rows.withColumn("_p", F.lag(key).over(w)).where(F.col(key) <= F.col("_p")).drop("_p")
    parts = ranged(rows.where(F.col(key).isNotNull()), position)
    ends = parts.groupBy("_part").agg(F.max_by(key, "_at").alias("_end"))
    border = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_border"))
    w = Window.partitionBy("_part").orderBy("_at")
    near = parts.join(F.broadcast(border), "_part").withColumn("_p", F.coalesce(F.lag(key).over(w), "_border"))
    return near.where(F.col(key) <= F.col("_p")).select(*rows.columns)


def overlaps(boundaries: DataFrame) -> DataFrame:
    """Boundaries that lie strictly below another one."""
    up = boundaries.select("path", F.explode(P.ancestors(F.col("path"))).alias("_up"))
    return up.join(boundaries.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()


def symlinks_into(links: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Links (path, target) that lead to or below a nested root (path), by folded paths."""
    to = links.where(P.symlink_valid(F.col("path"), F.col("target"))).select(F.col("path").alias("_link"), unicode.folded(P.symlink_resolved(F.col("path"), F.col("target"))).alias("path"))
    hit = below_boundary(to.where("path <> ''"), boundaries.select(unicode.folded(F.col("path")).alias("path")), keep=True)
    return links.join(hit.select(F.col("_link").alias("path")).distinct(), "path", "left_semi")


def version_findings(bindings: DataFrame, tombstones: DataFrame, exclusions: DataFrame, most: int | None = MAX_ENTRIES) -> DataFrame:
    """All findings (severity, code, path) of one version: paths, ids, digests, sizes, uniqueness, pairing, containment, links, and count if there are more than `most` rows (None: no bound).

    The three relations are read once, in one relation of paths with flags for what a row shows by itself; the rest are
    joins and groups over it.
    """
    facts = ["kind", "object_id", "object_version_id", "content_sha256", "bytes", "target", "reason"]
    none = lambda names: [F.lit(None).cast("long" if n == "bytes" else "string").alias(n) for n in names]
    b = bindings.select(F.lit("b").alias("of"), "path", *facts[:6], *none(["reason"]))
    t = tombstones.select(F.lit("t").alias("of"), "path", F.col("deleted_kind").alias("kind"), "object_id", F.col("last_object_version_id").alias("object_version_id"), *none(facts[3:]))
    x = exclusions.select(F.lit("x").alias("of"), "path", "kind", *none(facts[1:6]), "reason")
    every = staged(b.unionByName(t).unionByName(x))
    of = lambda side: every.where(F.col("of") == side)
    path, kind, file = F.col("path"), F.col("kind"), F.col("kind") == "regular_file"
    bound, gone, version = F.col("of") == "b", F.col("of") == "t", F.col("object_version_id")
    paired = F.lit(False)
    for name, reason in EXCLUSION_REASONS.items():
        paired = paired | ((kind == name) & (F.col("reason") == reason))
    alone = [
        ("path_not_portable", ~P.path_valid(path)),
        ("object_id_invalid", (bound | gone) & ~P.id_valid(F.col("object_id"), "obj")),
        ("object_version_id_invalid", ((bound & (kind != "directory")) | (gone & version.isNotNull())) & ~F.coalesce(P.id_valid(version, "version"), F.lit(False))),
        ("digest_invalid", bound & file & ~F.coalesce(P.sha256_valid(F.col("content_sha256")), F.lit(False))),
        ("object_too_large", bound & file & (F.col("bytes") > MAX_OBJECT_BYTES)),
        ("tombstone_version_pairing", gone & ((kind == "directory") != version.isNull())),
        ("exclusion_pairing", (F.col("of") == "x") & ~F.coalesce(paired, F.lit(False))),
        ("symlink_unsafe", bound & (kind == "symlink") & ~P.symlink_valid(path, F.col("target"))),
    ]
    codes = F.filter(F.array(*(F.when(test, F.lit(code)) for code, test in alone)), lambda c: c.isNotNull())
    out = [every.select(F.lit("error").alias("severity"), F.explode(codes).alias("code"), "path").distinct()]
    nested = of("x").where(kind == NESTED).select("path")
    inside = below_boundary(every.where(~((F.col("of") == "x") & (kind == NESTED))).select("path").distinct(), nested, keep=True)
    dead, alive = of("t").select("path", "object_id"), of("b").select(F.col("path").alias("_path"), F.col("object_id").alias("_object"))
    out += [
        finding(collisions(every), "path_collision", "key"),
        finding(repeated(of("b"), "object_id"), "object_bound_twice"),
        finding(owners(of("b"), of("t").withColumn("last_object_version_id", version)), "version_owner_collision", "object_version_id"),
        finding(dead.join(alive, path.eqNullSafe(F.col("_path")) & (F.col("object_id") == F.col("_object")), "left_semi"), "same_object_recreated"),
        finding(dead.join(of("x").select("path"), "path", "left_semi"), "tombstone_on_exclusion"),
        finding(inside, "below_nested_boundary"),
        finding(overlaps(nested), "boundary_overlap"),
        finding(symlinks_into(of("b").where(kind == "symlink").select("path", "target"), nested), "symlink_into_nested_root"),
    ]
    if most is not None:
        n = every.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit("").alias("path"))
        out.append(finding(n, "too_many_entries"))
    return reduce(DataFrame.unionByName, out)


def valid(findings: DataFrame) -> DataFrame:
    """One row: whether no finding is an error."""
    return findings.agg((F.count_if(F.col("severity") == "error") == 0).alias("valid"))


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "code", "severity")
