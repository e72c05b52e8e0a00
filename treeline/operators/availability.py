"""Readiness and archival of roots as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERIFIED, UNVERIFIED, MISSING = "verified", "present_unverified", "missing"


def readiness(objects: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of each root of `roots` (root_id, lifecycle, policy, keep_guaranteed, session_requested, history_verified): state, completeness, bytes still needed, and counts of what blocks it, from objects (root_id, object_id, bytes, local, remote, required, pinned)."""
    local, remote = F.col("local") == VERIFIED, F.col("remote") == VERIFIED
    facts = objects.groupBy("root_id").agg(
        F.coalesce(F.sum(F.when(~local, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_required"),
        F.count_if(F.col("local") == MISSING).alias("missing_local"),
        F.count_if(F.col("local") == UNVERIFIED).alias("unverified_local"),
        F.count_if(~remote).alias("missing_remote"),
        F.count_if(F.col("required") & ~F.col("pinned")).alias("unpinned"),
        F.count_if(F.col("required") & ~local).alias("session_missing"),
    )
    names = [c for c in facts.columns if c != "root_id"]
    j = roots.join(facts, "root_id", "left").fillna(0, names)
    archived = F.col("lifecycle") == "archived"
    complete = (F.col("missing_local") + F.col("unverified_local") == 0) & ((F.col("policy") != "keep_local") | F.col("keep_guaranteed"))
    session = F.col("session_requested") & (F.col("session_missing") == 0) & (F.col("unpinned") == 0)
    ready = (F.col("missing_remote") == 0) & F.col("history_verified")
    state = F.when(archived, "archived").when(session, "session_ready").when(F.col("policy").isin("keep_local", "managed") & complete, "local_complete")
    state = state.when((F.col("policy") != "keep_local") & ready, "remote_ready").otherwise("incomplete")
    return j.select("root_id", state.alias("state"), (~archived & complete).alias("local_complete"), (~archived & session).alias("session_ready"), (~archived & ready).alias("remote_ready"), *names)


def object_lists(objects: DataFrame) -> DataFrame:
    """(root_id, list, object_id): members of the lists that readiness counts, as rows, so that no list is gathered."""
    tests = [("missing_local", F.col("local") == MISSING), ("unverified_local", F.col("local") == UNVERIFIED), ("missing_remote", F.col("remote") != VERIFIED), ("unpinned_session", F.col("required") & ~F.col("pinned"))]
    lists = F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests)), lambda x: x.isNotNull())
    return objects.select("root_id", F.explode(lists).alias("list"), "object_id")


def archival(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """One row of each of `requests` (root_id, lifecycle, history_verified, manual, approved, automatic, idle, threshold): disposition, whether local bytes may go, and byte sums."""
    remote = F.col("remote") == VERIFIED
    facts = objects.groupBy("root_id").agg(F.count_if(~remote).alias("remote_unverified"), F.coalesce(F.sum(F.when(remote, F.col("bytes"))), F.lit(0)).cast("long").alias("verified_bytes"), F.sum("bytes").cast("long").alias("restore_bytes"))
    j = requests.join(facts, "root_id", "left").fillna(0, ["remote_unverified", "verified_bytes", "restore_bytes"])
    due = F.col("manual") | (F.col("idle") >= F.col("threshold"))
    approved = F.col("approved") | (~F.col("manual") & F.col("automatic"))
    safe = (F.col("lifecycle") != "archived") & (F.col("remote_unverified") == 0) & F.col("history_verified") & due
    state = F.when(safe & approved, "eligible").when(safe, "proposal_eligible").otherwise("blocked")
    return j.select("root_id", state.alias("disposition"), (safe & approved).alias("may_remove_local"), "remote_unverified", "verified_bytes", "restore_bytes")
