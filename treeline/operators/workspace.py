"""Texts and single files of a working tree: bounded reads, guarded saves, captured versions, moves and restores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest text that is read or saved.
MAX_TEXT = 2 << 20


def read_texts(files: DataFrame, most: int = MAX_TEXT) -> DataFrame:
    """(path, text, sha256, problem) of files (path, content): `too_large`, `binary` (a zero byte) or `not_utf8` instead of text."""
    c = F.col("content")
    problem = F.when(F.octet_length(c) > most, "too_large").when(F.decode(c, "ISO-8859-1").contains("\0"), "binary").when(~F.is_valid_utf8(c.cast("string")), "not_utf8")
    good = problem.isNull()
    return files.select("path", F.when(good, F.decode(c, "UTF-8")).alias("text"), F.when(good, F.sha2(c, 256)).alias("sha256"), problem.alias("problem"))


def saved_texts(files: DataFrame, edits: DataFrame, most: int = MAX_TEXT) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) after edits (path, expected_sha256, text), and (path, outcome) of each edit.

    saved, unchanged, or why not: `missing`, `too_large`, and `conflict` if the file isn't what the editor saw. One edit a path.
    """
    e = edits.select("path", "expected_sha256", F.encode("text", "UTF-8").alias("new"))
    j = e.join(files.select("path", "content"), "path", "left")
    now = F.sha2("content", 256)
    outcome = F.when(F.col("content").isNull(), "missing").when(F.octet_length("new") > most, "too_large").when(~now.eqNullSafe(F.col("expected_sha256")), "conflict").when(F.col("new") == F.col("content"), "unchanged").otherwise("saved")
    done = j.select("path", "new", outcome.alias("outcome"))
    after = files.join(done.where("outcome = 'saved'").select("path", "new"), "path", "left").withColumn("content", F.coalesce("new", "content")).drop("new")
    return after, done.select("path", "outcome")


def captured(objects: DataFrame, files: DataFrame, mint) -> DataFrame:
    """(object_id, path, object_version_id, sha256, bytes) of the versions that capturing files (path, sha256, bytes) adds: of those whose digest isn't that of the object's current version (objects: object_id, path, sha256).

    mint: column of the new version's id, from object_id and sha256. A file of no object gets a new object, by `mint` of its path.
    """
    j = files.join(objects.select("path", "object_id", F.col("sha256").alias("_now")), "path", "left")
    new = j.where(~F.col("sha256").eqNullSafe(F.col("_now")))
    owner = F.coalesce("object_id", mint("obj", F.col("path")))
    return new.select(owner.alias("object_id"), "path", mint("version", F.concat(owner, F.lit("/"), F.col("sha256"))).alias("object_version_id"), "sha256", "bytes")


def relocated(objects: DataFrame, moves: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, to_path, outcome) of moves (from_path, to_path, identity): an object's path changes if the file at the new path has the same physical identity and the digest of its current version, and nothing is left at the old path.

    objects: object_id, path, sha256, identity; files: path, sha256, identity. Outcomes: moved, unknown_object, source_remains, target_missing, identity_differs, content_differs, target_taken.
    """
    o = objects.select(F.col("path").alias("from_path"), "object_id", F.col("sha256").alias("_osha"), F.col("identity").alias("_oid"))
    f = files.select(F.col("path").alias("to_path"), F.col("sha256").alias("_fsha"), F.col("identity").alias("_fid"))
    left = files.select(F.col("path").alias("from_path"), F.lit(True).alias("_left"))
    taken = objects.select(F.col("path").alias("to_path"), F.lit(True).alias("_taken"))
    j = moves.join(o, "from_path", "left").join(f, "to_path", "left").join(left, "from_path", "left").join(taken, "to_path", "left")
    outcome = F.when(F.col("object_id").isNull(), "unknown_object").when(F.col("_taken"), "target_taken").when(F.col("_left"), "source_remains").when(F.col("_fid").isNull(), "target_missing")
    outcome = outcome.when(F.col("_fid") != F.col("_oid"), "identity_differs").when(F.col("_fsha") != F.col("_osha"), "content_differs").otherwise("moved")
    return j.select("from_path", "to_path", outcome.alias("outcome"))


def restored_files(files: DataFrame, versions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, sha256) with versions (object_version_id, sha256) put back at the paths of requests (object_version_id, path), and (path, outcome): restored, unknown_version, or occupied, as nothing is overwritten. Of requests for one path, the first by version counts."""
    first = requests.groupBy("path").agg(F.min("object_version_id").alias("object_version_id"))
    j = first.join(versions.select("object_version_id", "sha256"), "object_version_id", "left").join(files.select("path", F.lit(True).alias("_here")), "path", "left")
    outcome = F.when(F.col("_here"), "occupied").when(F.col("sha256").isNull(), "unknown_version").otherwise("restored")
    done = j.select("path", "sha256", outcome.alias("outcome"))
    return files.select("path", "sha256").unionByName(done.where("outcome = 'restored'").select("path", "sha256")), done.select("path", "outcome")


def transferred(history: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History rows (object_id, object_version_id, sha256) that a nested root takes over, and collisions: objects of which it already holds a version with another digest. Versions that it holds already aren't added again, and an object with a collision stays as a whole."""
    h = existing.select("object_id", "object_version_id", F.col("sha256").alias("_held"))
    j = history.join(h, ["object_id", "object_version_id"], "left")
    bad = j.where(F.col("_held").isNotNull() & (F.col("_held") != F.col("sha256"))).select("object_id").distinct()
    new = j.where(F.col("_held").isNull()).select("object_id", "object_version_id", "sha256").join(bad, "object_id", "left_anti")
    return new, bad
