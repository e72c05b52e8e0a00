"""Differences between two versions of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DIFF_RANK
from ..plans.staging import staged

#: A binding's state without its path and identity.
STATE = ("kind", "object_version_id", "content_sha256", "bytes", "executable", "target")
_CHANGE = "change_type string, path string, from_path string, to_path string, object_id string, previous_object_id string, previous_object_version_id string, object_version_id string, tombstone_present boolean, sort_path string"
_COLUMNS = [c.split() for c in _CHANGE.split(", ")]


def _change(df: DataFrame, kind: str, **values) -> DataFrame:
    values = {"change_type": F.lit(kind), "sort_path": values.get("path", values.get("from_path"))} | values
    return df.select(*(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _COLUMNS))


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in ("path", "object_id", *(c for c in STATE if c in df.columns))))


def _differs(df: DataFrame, columns) -> F.Column:
    return ~F.struct(*(f"o_{c}" for c in columns)).eqNullSafe(F.struct(*(f"n_{c}" for c in columns)))


def binding_changes(old: DataFrame, new: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Changes between bindings (path, object_id, state columns) of two versions; tombstones: of the newer one.

    Two passes that don't exclude one another: by object (moved; updated if its state differs as well) and by path
    (added and deleted for objects of one side only, recreated, updated in place). A path that is only reached by a
    move gives nothing in the second pass.
    """
    state = [c for c in STATE if c in old.columns]
    o, n = _sided(old, "o"), _sided(new, "n")
    moved = o.join(n, F.col("o_object_id") == F.col("n_object_id")).where("o_path <> n_path")
    out = [
        _change(moved, "moved", from_path=F.col("o_path"), to_path=F.col("n_path"), object_id=F.col("o_object_id")),
        _change(moved.where(_differs(moved, state)), "updated", path=F.col("n_path"), object_id=F.col("n_object_id"), previous_object_version_id=F.col("o_object_version_id"), object_version_id=F.col("n_object_version_id")),
    ]
    both = o.join(n, F.col("o_path") == F.col("n_path"), "full_outer")
    same = both.where("o_path is not null and n_path is not null")
    out.append(_change(same.where("o_object_id <> n_object_id"), "recreated", path=F.col("n_path"), previous_object_id=F.col("o_object_id"), object_id=F.col("n_object_id")))
    here = same.where("o_object_id = n_object_id")
    out.append(_change(here.where(_differs(here, state)), "updated", path=F.col("n_path"), object_id=F.col("n_object_id"), previous_object_version_id=F.col("o_object_version_id"), object_version_id=F.col("n_object_version_id")))
    fresh = both.where("o_path is null").join(old.select(F.col("object_id").alias("n_object_id")), "n_object_id", "left_anti")
    out.append(_change(fresh, "added", path=F.col("n_path"), object_id=F.col("n_object_id")))
    gone = both.where("n_path is null").join(new.select(F.col("object_id").alias("o_object_id")), "o_object_id", "left_anti")
    if tombstones is not None:
        t = tombstones.select(F.col("path").alias("_p"), F.col("object_id").alias("_o"), F.lit(True).alias("_t")).distinct()
        gone = gone.join(t, (F.col("o_path") == F.col("_p")) & (F.col("o_object_id") == F.col("_o")), "left").withColumn("_t", F.coalesce("_t", F.lit(False)))
    else:
        gone = gone.withColumn("_t", F.lit(False))
    out.append(_change(gone, "deleted", path=F.col("o_path"), object_id=F.col("o_object_id"), tombstone_present=F.col("_t")))
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def record_changes(old: DataFrame, new: DataFrame, keys: tuple[str, ...], facts: tuple[str, ...], name: str) -> DataFrame:
    """Tombstones or exclusions by key: a record whose facts differ is removed and added."""
    o = old.select(*(F.col(c).alias(f"o_{c}") for c in (*keys, *facts)))
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in (*keys, *facts)))
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    both = o.join(n, on, "full_outer").where(F.col(f"o_{keys[0]}").isNull() | F.col(f"n_{keys[0]}").isNull() | _differs(o, facts))
    parts = []
    for side, verb in (("o", "removed"), ("n", "added")):
        rows = both.where(F.col(f"{side}_{keys[0]}").isNotNull())
        object_id = F.col(f"{side}_object_id") if "object_id" in keys else F.lit(None)
        parts.append(_change(rows, f"{name}_{verb}", path=F.col(f"{side}_path"), object_id=object_id))
    return _union(parts)


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """`manifest_updated` if the one row of each side (object_version_id, content_sha256, bytes) differs, with both version ids; its path is empty."""
    facts = ("object_version_id", "content_sha256", "bytes")
    both = old.select(F.lit("").alias("_k"), *(F.col(c).alias(f"o_{c}") for c in facts)).join(new.select(F.lit("").alias("_k"), *(F.col(c).alias(f"n_{c}") for c in facts)), "_k")
    return _change(both.where(_differs(both, facts)), "manifest_updated", path=F.col("_k"), previous_object_version_id=F.col("o_object_version_id"), object_version_id=F.col("n_object_version_id"))


def diff(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """All changes between two versions, each a dict of `bindings`, `tombstones`, `exclusions`, `manifest` and `root_id`, as far as there are any, with `rank`, the place of each type in the order.

    Versions of different roots have no difference: an error.
    """
    if old.get("root_id") != new.get("root_id"):
        raise ValueError("the versions are of different roots")
    old, new = ({k: staged(x) if isinstance(x, DataFrame) else x for k, x in v.items()} for v in (old, new))
    parts = [binding_changes(old["bindings"], new["bindings"], new.get("tombstones"))]
    if "manifest" in old:
        parts.append(manifest_changes(old["manifest"], new["manifest"]))
    if "tombstones" in old:
        parts.append(record_changes(old["tombstones"], new["tombstones"], ("path", "object_id"), ("deleted_kind", "last_object_version_id"), "tombstone"))
    if "exclusions" in old:
        parts.append(record_changes(old["exclusions"], new["exclusions"], ("path",), ("kind", "reason"), "exclusion"))
    rank = F.lit(None).cast("int")
    for name, r in DIFF_RANK.items():
        rank = F.when(F.col("change_type") == name, r).otherwise(rank)
    return _union(parts).withColumn("rank", rank)


def in_order(changes: DataFrame) -> DataFrame:
    """By path (of a move, where it came from), type, object."""
    return changes.orderBy("sort_path", "rank", "object_id")
