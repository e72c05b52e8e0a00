"""Replica reconciliation and idempotent events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import numbered


def reconciled(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, action, classification): local (path, digest, kind, base_digest) against canonical (path, digest, kind).

    upload, download, unchanged, or conflict: both sides left the base; text on both sides needs a merge, else both are kept.
    """
    l, r = (df.select("path", *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c != "path")) for s, df in (("l", local), ("r", remote)))
    both = l.join(r, "path", "full_outer")
    action = F.when(F.col("r_digest").isNull(), "upload").when(F.col("l_digest").isNull(), "download")
    action = action.when(F.col("l_digest") == F.col("r_digest"), "unchanged")
    action = action.when(F.col("l_base_digest").eqNullSafe(F.col("r_digest")), "upload").when(F.col("l_base_digest").eqNullSafe(F.col("l_digest")), "download").otherwise("conflict")
    kind = F.when((F.col("l_kind") == "text") & (F.col("r_kind") == "text"), "text_needs_merge").otherwise("preserve_both_binary")
    return both.select("path", action.alias("action"), F.when(action == "conflict", kind).alias("classification"))


def applied_events(events: DataFrame) -> DataFrame:
    """`events` (event_id, path, sequence, arrival) with `applied`: on clean replicas a first delivery applies if its sequence exceeds all earlier ones of its path."""
    first = Window.partitionBy("event_id").orderBy("arrival")
    before = Window.partitionBy("path").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("_first", F.row_number().over(first) == 1)
    high = F.max(F.when(F.col("_first"), F.col("sequence"))).over(before)
    return seen.withColumn("applied", F.col("_first") & F.coalesce(F.col("sequence") > high, F.lit(True))).drop("_first")


def published(changes: DataFrame, start: int = 0) -> DataFrame:
    """`changes` (arrival, ...) with `publication`: one sequence over all paths, in arrival order, from `start` + 1. Rows of equal arrival have no order of their own."""
    return numbered(changes, "arrival", "publication", start)


def distinct_conflicts(conflicts: DataFrame) -> DataFrame:
    """One row of conflicts (path, local_digest, remote_digest, arrival) that repeat the same path and digests: the first."""
    key = ["path", "local_digest", "remote_digest"]
    first = F.min(F.struct("arrival", *[c for c in conflicts.columns if c not in (*key, "arrival")])).alias("_f")
    return conflicts.groupBy(*key).agg(first).select(*key, "_f.*").select(*conflicts.columns)


def report_order(conflicts: DataFrame) -> DataFrame:
    return conflicts.orderBy("path", "local_digest")
