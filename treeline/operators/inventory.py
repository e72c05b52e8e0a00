"""Classification and totals of a tree's entries, and its flat listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import paths as P
from ..model import DIRECTORY, EXCLUSION_REASONS, FILE, SYMLINK


def summary(files: DataFrame) -> DataFrame:
    """One row of totals of files (path, bytes)."""
    path, size = F.col("path"), F.col("bytes")
    counts = [("generated", C.is_generated(path)), ("secret_shaped", C.is_secret_shaped(path)), ("temporary", C.is_temporary(path)), ("large", C.is_large(size)), ("versioned", C.is_versioned(path))]
    return files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"), *(F.count_if(t).alias(f"{n}_count") for n, t in counts))


def classified(files: DataFrame) -> DataFrame:
    """(path, class, rank) of each class of each file."""
    mask = C.class_mask(F.col("path"), F.col("bytes"))
    names = F.filter(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.struct(F.lit(c).alias("class"), F.lit(i).alias("rank"))) for i, c in enumerate(C.CLASSES))), lambda x: x.isNotNull())
    return files.select("path", F.explode(names).alias("c")).select("path", "c.class", "c.rank").distinct()


def boundary_hints(directories: DataFrame) -> DataFrame:
    return directories.select("path", C.boundary_hint(F.col("path")).alias("hint")).where("hint is not null").distinct()


def context_files(files: DataFrame) -> DataFrame:
    return files.where(C.is_context_file(F.col("path"))).select("path").distinct()


def directories(files: DataFrame) -> DataFrame:
    """(path): every directory above the files."""
    return files.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()


def listing(entries: DataFrame) -> DataFrame:
    """(path, kind, bytes, editable, reconstructable) of entries (path, kind, bytes): the protocol's and version control's directories are hidden, a reconstructable directory is one row, and what isn't a file has no bytes."""
    parts, name = F.split(F.col("path"), "/"), P.file_name(F.col("path"))
    hidden = F.exists(parts, lambda c: F.lower(c).isin(P.STATE_DIRECTORY, ".git"))
    made = F.array(*map(F.lit, C.RECONSTRUCTABLE))
    inside = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), made)
    file = F.col("kind") == FILE
    rebuilt = (F.col("kind") == DIRECTORY) & name.isin(C.RECONSTRUCTABLE)
    editable = file & C.extension(F.col("path")).isin("md", "txt", "csv", "json", "yaml", "yml", "toml") & (F.col("bytes") <= 2 << 20)
    return entries.where(~hidden & ~inside).select("path", "kind", F.when(file, F.col("bytes")).otherwise(0).cast("long").alias("bytes"), editable.alias("editable"), rebuilt.alias("reconstructable"))


def plan_order(entries: DataFrame, manifest: str) -> DataFrame:
    """Directories by depth, then files by path with the manifest last."""
    return entries.orderBy(F.col("kind") != DIRECTORY, F.when(F.col("kind") == DIRECTORY, P.depth(F.col("path"))), F.col("path") == manifest, "path")


def kind_label(column: str):
    """A kind in words."""
    return F.replace(F.col(column), F.lit("_"), F.lit(" "))


def reason_of(column: str):
    """The reason that an exclusion of a kind has; null for kinds that aren't excluded."""
    out = F.lit(None).cast("string")
    for kind, reason in EXCLUSION_REASONS.items():
        out = F.when(F.col(column) == kind, reason).otherwise(out)
    return out


def reserved(path) -> list:
    """Flags of a path: in the protocol's directory, in version control's (both in any case), in one that can be made again."""
    parts = F.split(path, "/")
    named = lambda name: F.exists(parts, lambda c: F.lower(c) == name)
    return [named(P.STATE_DIRECTORY).alias("state"), named(".git").alias("version_control"), F.arrays_overlap(parts, F.array(*map(F.lit, C.RECONSTRUCTABLE))).alias("reconstructable")]


def visible_hints(hints: DataFrame, private: str = f"{P.STATE_DIRECTORY}/state/private/index") -> DataFrame:
    """Change hints (paths) without those all of whose paths lie in the engine's own index."""
    return hints.where(~F.forall("paths", lambda p: P.at_or_below(p, F.lit(private))))


def symlink_objects(bindings: DataFrame) -> DataFrame:
    """Links as objects: their content is the target's text."""
    return bindings.where(F.col("kind") == SYMLINK).withColumns({"content_sha256": F.sha2(F.col("target"), 256), "bytes": F.octet_length("target").cast("long")})


def assignment_groups(scopes: DataFrame, most: int = 32) -> DataFrame:
    """(root, kind, n, first, last): scopes (path) by first component and content kind (extension) where there are more than `most`; each for itself otherwise, with its path as root."""
    root = F.substring_index("path", "/", 1) if scopes.count() > most else F.col("path")
    return scopes.groupBy(root.alias("root"), C.extension(F.col("path")).alias("kind")).agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


def in_order(classes: DataFrame) -> DataFrame:
    return classes.orderBy("path", "rank")


def report(files: DataFrame) -> DataFrame:
    """(section, path, detail) of an inspection of files (path, bytes): classes of files, hints of directories, and context files."""
    classes = classified(files).select(F.lit("class").alias("section"), "path", F.col("class").alias("detail"))
    hints = boundary_hints(directories(files)).select(F.lit("boundary").alias("section"), "path", F.col("hint").alias("detail"))
    context = context_files(files).select(F.lit("context").alias("section"), "path", F.lit(None).cast("string").alias("detail"))
    return classes.unionByName(hints).unionByName(context)


def budget_findings(entries: DataFrame, most_entries: int = 50_000, most_depth: int = 64, most_bytes: int = 16 << 20) -> DataFrame:
    """(code, measured) of the bounds that an inventory breaks: entries, depth, and the bytes of its paths when written down."""
    facts = entries.agg(F.count("*").alias("n"), F.coalesce(F.max(P.depth(F.col("path"))), F.lit(0)).cast("long").alias("d"), F.coalesce(F.sum(F.octet_length("path").cast("long") + 1), F.lit(0)).alias("b"))
    tests = [("too_many_entries", "n", most_entries), ("too_deep", "d", most_depth), ("too_large", "b", most_bytes)]
    found = F.filter(F.array(*(F.when(F.col(c) > most, F.struct(F.lit(code).alias("code"), F.col(c).alias("measured"))) for code, c, most in tests)), lambda x: x.isNotNull())
    return facts.select(F.explode(found).alias("f")).select("f.code", "f.measured")
