"""Canonical digests of whole versions, framed by lengths so that no two versions share their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M

DOMAIN = "treeline-version-v1"
#: The tags of kinds in the canonical form.
BINDING_TAGS = {M.DIRECTORY: 0, M.FILE: 1, M.SYMLINK: 2}
EXCLUSION_TAGS = {M.NESTED: 0, "hard_link": 1, "fifo": 2, "socket": 3, "block_device": 4, "character_device": 5, "special": 6}


def _number(value, width: int):
    """Lower-case hex of a big-endian unsigned number of `width` bytes."""
    return F.lower(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def _framed(text):
    """Hex of a text's UTF-8 after its length in four bytes; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(_number(F.octet_length(text), 4), F.lower(F.hex(F.encode(text, "UTF-8"))))


def _tag(kind, tags: dict[str, int]):
    out = F.lit(None).cast("int")
    for name, tag in tags.items():
        out = F.when(kind == name, tag).otherwise(out)
    return _number(out, 1)


def _listed(rows: DataFrame, hexed, name: str) -> DataFrame:
    """(version_id, name): the count and the rows' hex, by path and then object."""
    second = F.col("object_id") if "object_id" in rows.columns else F.lit("")
    item = rows.select("version_id", F.struct("path", second.alias("o"), hexed.alias("h")).alias("r"))
    sorted_ = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"])
    return item.groupBy("version_id").agg(F.concat(_number(F.count("*"), 4), F.array_join(sorted_, "")).alias(name))


def version_digests(headers: DataFrame, bindings: DataFrame, tombstones: DataFrame, exclusions: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """(version_id, version_sha256) of each version in `headers` (version_id, protocol, root_id, parents, created_at).

    Rows of a version are put in path order within one group; a valid version has at most 16,384 of them, and a larger
    one, a row of an unknown kind or a header without an id gives a null digest instead of a group of any size: only
    versions within the bound are gathered.
    """
    every = [df.select("version_id") for df in (bindings, tombstones, exclusions)]
    sizes = every[0].unionByName(every[1]).unionByName(every[2]).groupBy("version_id").agg(F.count("*").alias("n"))
    small = headers.select("version_id").join(sizes, "version_id", "left").where(F.coalesce("n", F.lit(0)) <= M.MAX_ENTRIES).select("version_id")
    kind = F.col("kind")
    file = F.concat(_framed(F.col("object_version_id")), F.lower(F.col("content_sha256")), _number(F.col("bytes"), 8), _number(F.col("executable").cast("int"), 1))
    link = F.concat(_framed(F.col("object_version_id")), _framed(F.col("target")), _framed(F.lit("relative")))
    facts = F.when(kind == M.FILE, file).when(kind == M.SYMLINK, link).otherwise("")
    live = F.concat(_framed(F.col("path")), _framed(F.col("object_id")), _framed(F.lit(M.LIVE)), _tag(kind, BINDING_TAGS), facts)
    last = F.when(F.col("last_object_version_id").isNull(), "00").otherwise(F.concat(F.lit("01"), _framed(F.col("last_object_version_id"))))
    dead = F.concat(_framed(F.col("path")), _framed(F.col("object_id")), _framed(F.lit(M.DELETED)), _tag(F.col("deleted_kind"), BINDING_TAGS), last)
    out_ = F.concat(_framed(F.col("path")), _tag(kind, EXCLUSION_TAGS), _framed(F.col("reason")))
    parts = [(bindings, live, "b"), (tombstones, dead, "t"), (exclusions, out_, "x")]
    # A row without hex would vanish from the joined text, so it must void the whole.
    bad = [df.where(h.isNull()).select("version_id") for df, h, _ in parts]
    bad = bad[0].unionByName(bad[1]).unionByName(bad[2]).distinct()
    parents = F.coalesce("parents", F.array().cast("array<string>"))
    top = F.concat(F.lower(F.hex(F.encode(F.lit(domain), "UTF-8"))), F.lit("00"), *(_framed(F.col(c)) for c in ("protocol", "root_id", "version_id")), _number(F.size(parents), 1), F.array_join(F.transform(parents, _framed), ""), _framed(F.col("created_at")))
    whole = headers.join(small, "version_id", "left_semi").join(bad, "version_id", "left_anti")
    for df, hexed, name in parts:
        whole = whole.join(_listed(df.join(small, "version_id", "left_semi"), hexed, name), "version_id", "left")
    none = F.lit("00000000")
    digest = whole.select("version_id", F.sha2(F.unhex(F.concat(top, *(F.coalesce(n, none) for n in ("b", "t", "x")))), 256).alias("version_sha256"))
    return headers.select("version_id").join(digest, "version_id", "left")
