"""Path, id and digest functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..model import MAX_COMPONENT_BYTES, MAX_DEPTH, MAX_PATH_BYTES

#: Name of the protocol's own directory.
STATE_DIRECTORY = ".treeline"
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
# Device names, characters and endings that the portable form refuses.
_DEVICE = r"(?i)\A(con|prn|aux|nul|com[1-9¹²³]|lpt[1-9¹²³])(\.|\z)"
_REFUSED = r'[\x00-\x1f<>:"|?*]'
_ENDINGS = r"[. ]\z"
_DRIVE = r"\A[A-Za-z]:"


_BAD_COMPONENT = re.compile("|".join((_REFUSED, _ENDINGS, _DEVICE.removeprefix("(?i)"))).replace(r"\z", r"\Z"), re.IGNORECASE)


def portable(path: str) -> bool:
    """path_valid() of one path, on the driver."""
    parts = path.split("/")
    whole = path and len(path.encode()) <= MAX_PATH_BYTES and len(parts) <= MAX_DEPTH and "\\" not in path and not re.search(_DRIVE, path)
    plain = lambda c: c not in ("", ".", "..") and len(c.encode()) <= MAX_COMPONENT_BYTES and c.lower() != STATE_DIRECTORY
    return bool(whole) and all(plain(c) and not _BAD_COMPONENT.search(c) for c in parts)


def identifier(value: str, prefix: str) -> bool:
    """id_valid() of one value, on the driver."""
    return re.fullmatch(f"{prefix}_{_UUID}", value) is not None


def at_or_below(path, root):
    """path is root or lies below it, by whole components."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def ancestors(path, itself: bool = False):
    """Array of the paths above `path`, from the top, and `path` with `itself`."""
    parts = F.split(path, "/")
    n = F.size(parts) if itself else F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def depth(path):
    return F.size(F.split(path, "/"))


def file_name(path):
    return F.substring_index(path, "/", -1)


def component_valid(c):
    """A portable path component: no reserved names, characters or endings."""
    return (
        (c != "") & (c != ".") & (c != "..") & (F.octet_length(c) <= MAX_COMPONENT_BYTES)
        & ~c.rlike(_ENDINGS) & ~c.rlike(_REFUSED) & (F.lower(c) != STATE_DIRECTORY) & ~c.rlike(_DEVICE)
    )


def path_valid(path):
    """A portable relative path."""
    whole = (path != "") & (F.octet_length(path) <= MAX_PATH_BYTES) & ~path.startswith("/") & ~path.endswith("/") & ~path.contains("\\") & ~path.contains("\0") & ~path.rlike(_DRIVE)
    parts = F.split(path, "/")
    return whole & (F.size(parts) <= MAX_DEPTH) & F.forall(parts, component_valid)


def symlink_resolved(link, target):
    """Where a relative target leads from the link's directory; null if it climbs above the root."""
    parts = F.split(link, "/")
    start = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))

    def step(at, c):
        up = F.when(F.size(at) > 0, F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
        return F.when(at.isNull(), at).when(c == ".", at).when(c == "..", up).otherwise(F.concat(at, F.array(c)))

    return F.array_join(F.aggregate(F.split(target, "/"), start, step), "/")


def symlink_valid(link, target):
    """A portable target that stays inside the root and outside the protocol's directory; nested roots are looked up by checks.symlinks_into()."""
    shape = (target != "") & (F.octet_length(target) <= MAX_PATH_BYTES) & ~target.startswith("/") & ~target.endswith("/") & ~target.contains("\\") & ~target.contains("\0") & ~target.contains("//") & ~target.rlike(_DRIVE)
    parts = F.forall(F.split(target, "/"), lambda c: c.isin(".", "..") | component_valid(c))
    to = symlink_resolved(link, target)
    return F.coalesce(shape & parts & ((to == "") | path_valid(to)), F.lit(False))


def id_valid(value, prefix: str):
    return value.rlike(rf"\A{prefix}_{_UUID}\z")


def sha256_valid(value):
    return value.rlike(r"\A[0-9a-f]{64}\z")


def timestamp_valid(value):
    """A canonical UTC time in whole seconds."""
    shape = value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z")
    parsed = F.try_to_timestamp(F.when(shape, value), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'") == value, F.lit(False))


def semver(value):
    """Struct (major, minor, patch) of a plain semantic version, comparable; null if it has another shape."""
    part = lambda i: F.regexp_extract(value, r"\A(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\z", i)
    return F.when(part(1) != "", F.struct(*(part(i).cast("long").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch")))))
