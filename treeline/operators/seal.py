"""Sealing a live observation into a version: identity, tombstones, ancestry, restoration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from .change_set import below_boundary


def identities(live: DataFrame, prior: DataFrame) -> DataFrame:
    """`live` (path, kind, physical_identity) with the object_id that the prior version's row continues: same path and kind, or else the same physical identity and kind if that is the only candidate; `ambiguous` marks several."""
    by_path = prior.select("path", "kind", F.col("object_id").alias("_o"))
    out = live.join(by_path, ["path", "kind"], "left")
    rest = out.where("_o is null and physical_identity is not null").select("path", "kind", "physical_identity")
    free = prior.join(out.where("_o is not null").select(F.col("_o").alias("object_id")), "object_id", "left_anti")
    by_body = rest.join(free.select("kind", "physical_identity", "object_id"), ["kind", "physical_identity"])
    by_body = by_body.groupBy("path", "kind").agg(F.count("*").alias("_n"), F.min("object_id").alias("_b"))
    out = out.join(by_body, ["path", "kind"], "left")
    return out.select(*live.columns, F.coalesce("_o", F.when(F.col("_n") == 1, F.col("_b"))).alias("object_id"), F.coalesce(F.col("_n") > 1, F.lit(False)).alias("ambiguous"))


def tombstones_carried(prior_tombstones: DataFrame, prior_bindings: DataFrame, reused: DataFrame) -> DataFrame:
    """Tombstones of the new version: those before, and the prior bindings whose object no live row reuses; of one path the newest."""
    old = prior_tombstones.select("path", "object_id", "deleted_kind", "last_object_version_id", F.lit(0).alias("_new"))
    gone = prior_bindings.join(reused.select("object_id").distinct(), "object_id", "left_anti")
    new = gone.select("path", "object_id", F.col("kind").alias("deleted_kind"), F.col("object_version_id").alias("last_object_version_id"), F.lit(1).alias("_new"))
    newest = Window.partitionBy("path").orderBy(F.desc("_new"), "object_id")
    return old.unionByName(new).withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at", "_new")


def hidden_priors(prior_bindings: DataFrame, live: DataFrame, covered: DataFrame) -> DataFrame:
    """Prior bindings that are missing from the live rows because an ignored or excluded path covers them: an error to seal."""
    missing = prior_bindings.join(live.select("path"), "path", "left_anti")
    return below_boundary(missing, covered, keep=True)


def unchanged(live: DataFrame, prior: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether both relations hold the same rows, as sealing then does nothing."""
    a, b = live.select(columns), prior.select(columns)
    differ = a.exceptAll(b).select(F.lit(1).alias("x")).unionByName(b.exceptAll(a).select(F.lit(1).alias("x")))
    return differ.agg((F.count("*") == 0).alias("unchanged"))


def ancestry(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth): least distance from each start to its ancestors by edges (child, parent).

    The frontier only takes new nodes, so shared ancestors and cycles are visited once.
    """
    edges = staged(edges.select("child", "parent").distinct())
    seen = staged(starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).cast("long").alias("depth")).distinct())
    frontier, at = seen, 0
    while True:
        at += 1
        step = frontier.join(edges, F.col("node") == F.col("child")).select("start", F.col("parent").alias("node")).distinct()
        new = staged(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(at).cast("long")))
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new), new
        if at % 8 == 0:
            seen = staged(seen)


def nearest(candidates: DataFrame, reach: DataFrame) -> DataFrame:
    """Of candidates (start, node, ...), those at the least depth for each start; `agreed` tells whether all of them hold the same object and version."""
    depth = Window.partitionBy("start").orderBy("depth")
    near = candidates.join(reach, ["start", "node"]).withColumn("_r", F.rank().over(depth)).where("_r = 1").drop("_r")
    agreed = near.groupBy("start").agg((F.count_distinct("object_id", "object_version_id") == 1).alias("agreed"))
    return near.join(agreed, "start")


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes that never lose all their parents: those on or below a cycle; empty if the graph is acyclic."""
    left = staged(edges.select("child", "parent").distinct())
    size = left.count()
    while True:
        left = staged(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"))
        now = left.count()
        if now == size:
            return left.select(F.col("child").alias("node")).distinct()
        size = now


def restored(bindings: DataFrame, tombstones: DataFrame, path: str, object_id: str) -> tuple[DataFrame, DataFrame]:
    """Bindings with the tombstone's object live again, and tombstones without it. The path must be free: an occupied one leaves both as they were."""
    mine = (F.col("path") == path) & (F.col("object_id") == object_id)
    free = tombstones.where(mine).join(bindings.select("path"), "path", "left_anti")
    back = free.select("path", "object_id", F.col("deleted_kind").alias("kind"), F.col("last_object_version_id").alias("object_version_id"))
    left = tombstones.join(free.select("path", "object_id"), ["path", "object_id"], "left_anti")
    return bindings.unionByName(back, allowMissingColumns=True), left


class SealError(RuntimeError):
    """code: why a live observation can't become a version."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def fenced(observe, tokens):
    """observe() between two looks at tokens() (ignore rules, current version, manifest, root); `planning_state_changed` if they differ."""
    before = tokens()
    seen = observe()
    if tokens() != before:
        raise SealError("planning_state_changed")
    return seen


def sealed(live: DataFrame, exclusions: DataFrame, ignored: DataFrame, prior: dict[str, DataFrame], mint) -> dict[str, DataFrame] | None:
    """The version that a live observation makes of the prior one: bindings, tombstones and exclusions; None if nothing changed.

    live: path, kind, bytes, executable, target, content_sha256, physical_identity; prior bindings have physical_identity
    too. A row keeps its object by path or by the same body elsewhere, and its object version if its content is the same;
    others get ids by mint(prefix, text). Objects that are gone leave tombstones. Errors: `ambiguous_identity` if a body may
    be that of several objects, `hidden_prior` if an ignored or excluded path covers a prior object.
    """
    named = staged(identities(live, prior["bindings"]))
    if not named.where("ambiguous").isEmpty():
        raise SealError("ambiguous_identity")
    covered = exclusions.select("path").unionByName(ignored.select("path"))
    if not hidden_priors(prior["bindings"], live, covered).isEmpty():
        raise SealError("hidden_prior")
    old = prior["bindings"].select("object_id", F.col("object_version_id").alias("_v"), F.col("content_sha256").alias("_s"), F.col("target").alias("_t"))
    owner = F.coalesce("object_id", mint("obj", F.col("path")))
    rows = named.drop("ambiguous").join(old, "object_id", "left")
    same = F.col("_v").isNotNull() & F.col("_s").eqNullSafe(F.col("content_sha256")) & F.col("_t").eqNullSafe(F.col("target"))
    content = F.coalesce("content_sha256", "target", F.lit(""))
    version = F.when(F.col("kind") == "directory", None).when(same, F.col("_v")).otherwise(mint("version", F.concat(owner, F.lit("/"), content)))
    bindings = staged(rows.select("path", "kind", "bytes", "executable", "target", "content_sha256", owner.alias("object_id"), version.alias("object_version_id"), "physical_identity"))
    columns = ["path", "kind", "bytes", "executable", "target", "content_sha256", "object_id", "object_version_id"]
    if unchanged(bindings, prior["bindings"], columns).first()["unchanged"] and unchanged(exclusions, prior["exclusions"], ["path", "kind", "reason"]).first()["unchanged"]:
        return None
    stones = tombstones_carried(prior["tombstones"], prior["bindings"], bindings)
    return {"bindings": bindings, "tombstones": stones, "exclusions": exclusions.select("path", "kind", "reason")}
