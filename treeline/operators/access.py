"""Grants, authority and budgets as decision rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import ancestors, at_or_below


def in_scope(path):
    """Whether a grant's scope (type, path, paths) contains `path`."""
    return (
        F.when(F.col("scope_type") == "root", True)
        .when(F.col("scope_type") == "folder", at_or_below(path, F.col("scope_path")))
        .when(F.col("scope_type") == "object", path == F.col("scope_path"))
        .otherwise(F.exists("scope_paths", lambda p: at_or_below(path, p)))
    )


def _stairs(rows: DataFrame, keys: list[str], best, latest_first: bool) -> DataFrame:
    """(keys, end, best): of rows by `end`, from the latest or earliest on, those where the best so far changes. A null end is never."""
    ends = rows.groupBy(*keys, "end").agg(best(F.col("grant")).alias("best"))
    order = F.col("end").desc_nulls_first() if latest_first else F.col("end").asc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(order)
    upto = ends.withColumn("best", best(F.col("best")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return upto.withColumn("_last", F.lag("best").over(w)).where(~F.col("best").eqNullSafe(F.col("_last"))).drop("_last")


def authorized(requests: DataFrame, grants: DataFrame, roots: DataFrame) -> DataFrame:
    """(request_id, allowed, reason, grant_id) of requests (request_id, root_id, member_id, path, permission, at).

    The owner may; else the first grant by id that is current, in scope and has the permission; else the last specific
    denial by grant id (a grant outside the scope tells nothing more), `outside_scope` or, without grants, `no_grant`.
    Revocation and expiry hold from their moment on, whatever the scope.

    Requests meet grants by what a grant covers (the root, a folder, an object), not by member alone, and of the grants
    that cover the same, only those that change the answer as time goes on. Without a grant that allows, all current ones
    in scope lack the permission, so their last id is enough.
    """
    member = ["root_id", "member_id"]
    folder = lambda p: F.concat(F.lit("d"), p)
    covers = F.when(F.col("scope_type") == "root", F.array(F.lit(""))).when(F.col("scope_type") == "folder", F.array(folder(F.col("scope_path"))))
    covers = covers.when(F.col("scope_type") == "object", F.array(F.concat(F.lit("o"), F.col("scope_path")))).otherwise(F.transform("scope_paths", folder))
    given = grants.select(*member, F.col("grant_id").alias("grant"), "permissions", "revoked_at", F.least("revoked_at", "expires_at").alias("end"), covers.alias("covers"))
    placed = given.select(*member, "grant", "permissions", "end", F.explode(F.array_distinct("covers")).alias("cover"))
    allow = _stairs(placed.withColumn("permission", F.explode(F.array_distinct("permissions"))), [*member, "cover", "permission"], F.min, True)
    lack = _stairs(placed, [*member, "cover"], F.max, True)
    ended = _stairs(given.where("end is not null").withColumn("grant", F.struct("grant", "revoked_at")), member, F.max, False)
    asked = requests.select("request_id", *member, "path", "permission", "at")
    met = F.concat(F.array(F.lit(""), F.concat(F.lit("o"), F.col("path"))), F.transform(ancestors(F.col("path"), itself=True), folder))
    at_cover = asked.withColumn("cover", F.explode(met))
    current = F.col("end").isNull() | (F.col("end") > F.col("at"))
    none = F.lit(None).cast(grants.schema["grant_id"].dataType)
    row = lambda *, allow=none, lack=none, over=none, why=F.lit(None).cast("string"), some=False: ["request_id", allow.alias("allow"), lack.alias("lack"), F.struct(over.alias("grant"), why.alias("why")).alias("over"), F.lit(some).alias("some")]
    why = F.when(F.col("best.revoked_at") <= F.col("at"), "revoked").otherwise("expired")
    hits = [
        at_cover.join(allow, [*member, "cover", "permission"]).where(current).select(*row(allow=F.col("best"))),
        at_cover.join(lack, [*member, "cover"]).where(current).select(*row(lack=F.col("best"))),
        asked.join(ended, member).where(F.col("end") <= F.col("at")).select(*row(over=F.col("best.grant"), why=why)),
        asked.join(given.select(*member).distinct(), member).select(*row(some=True)),
        asked.select(*row()),
    ]
    found = reduce(DataFrame.unionByName, hits).groupBy("request_id").agg(F.min("allow").alias("grant"), F.max("lack").alias("lack"), F.max("over").alias("over"), F.max("some").alias("some"))
    out = found.join(asked.select("request_id", *member), "request_id").join(roots.select("root_id", "owner_id"), "root_id", "left")
    owner = F.coalesce(F.col("member_id") == F.col("owner_id"), F.lit(False))
    later = F.col("over.grant").isNull() | (F.col("lack") > F.col("over.grant"))
    denial = F.when(F.col("lack").isNotNull() & later, "permission_missing").otherwise(F.coalesce("over.why", F.lit("outside_scope")))
    reason = F.when(owner, "owner").when(F.col("grant").isNotNull(), "explicit_grant").when(~F.col("some"), "no_grant").otherwise(denial)
    return out.select("request_id", (owner | F.col("grant").isNotNull()).alias("allowed"), reason.alias("reason"), F.when(~owner, F.col("grant")).alias("grant_id"))


def authority(actions: DataFrame) -> DataFrame:
    """`actions` (action, approved, broadens, lifecycle, canonical, active, scope_change) with `decision` and `reason`."""
    a = F.col("action")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    row = lambda d, r=None: F.struct(F.lit(d).alias("decision"), F.lit(r).cast("string").alias("reason"))
    canonical = F.col("lifecycle").eqNullSafe(F.lit("canonical"))
    out = F.when(a.isin("analyze_inventory", "ask_questions", "propose_structure", "propose_relationship", "refresh_summary", "refresh_signals"), row("allowed"))
    out = out.when((a == "change_scope") & (F.col("scope_change") == "expand"), row("denied", "scope_expansion")).when(a == "change_scope", row("allowed"))
    out = out.when((a == "write_plan") & yes("approved"), row("allowed")).when(a == "write_plan", row("requires_approval", "plan_not_approved"))
    out = out.when((a == "change_permissions") & yes("broadens"), row("denied", "permission_broadening")).when(a == "change_permissions", row("requires_approval", "permission_change"))
    out = out.when((a == "delete_object") & canonical, row("denied", "canonical_deletion")).when((a == "move_object") & canonical, row("denied", "canonical_move"))
    out = out.when((a == "merge_objects") & yes("canonical"), row("denied", "canonical_merge"))
    out = out.when((a == "archive_object") & yes("active"), row("denied", "active_archive")).when(a == "archive_object", row("requires_approval", "archive"))
    out = out.when(a.isin("delete_object", "move_object", "merge_objects"), row("requires_approval", "structural_change"))
    return actions.withColumn("_d", out).select(*actions.columns, "_d.decision", "_d.reason")


def budget_charges(charges: DataFrame, limits: dict[str, int]) -> DataFrame:
    """`charges` (ledger, at, and a whole column for each limit) with `accepted`.

    A charge is accepted, in order of `at`, if it keeps the ledger's accepted sums within all limits; a refused one leaves
    the ledger as it was. Whether one counts depends on all before it, so a ledger is followed from batch to batch in one
    task, with its sums as the only state.
    """
    names = list(limits)

    schema = T.StructType(charges.schema.fields).add("accepted", "boolean")
    ledgers = charges.repartition("ledger").sortWithinPartitions("ledger", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, held = None, None
        for batch in batches:
            keys = batch.column("ledger").to_pylist()
            begin = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[begin]:
                    if held is None or keys[begin] != ledger:
                        ledger, held = keys[begin], [0] * len(names)
                    part, accepted = batch.slice(begin, i - begin), []
                    for row in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                        new = [a + (b or 0) for a, b in zip(held, row, strict=True)]
                        accepted.append(all(n <= limits[k] for n, k in zip(new, names, strict=True)))
                        held = new if accepted[-1] else held
                    yield part.append_column("accepted", pa.array(accepted, pa.bool_()))
                    begin = i

    return ledgers.mapInArrow(run, schema)


def preflight(inputs: DataFrame) -> DataFrame:
    """`inputs` (changes, heartbeat_enabled, accepted) with `decision`: nothing changed, a disabled heartbeat, then the budget."""
    off = F.coalesce(~F.col("heartbeat_enabled"), F.lit(False))
    return inputs.withColumn("decision", F.when(F.col("changes") == 0, "no_meaningful_change").when(off, "heartbeat_disabled").when(F.col("accepted"), "invoke").otherwise("blocked_by_budget"))
