"""Chunk manifests: planning, validation, missing chunks, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (minimum, average, maximum) chunk bytes by profile; the larger one starts at 1 GiB.
PROFILES = {"standard-v1": (256 << 10, 1 << 20, 4 << 20), "large-v1": (4 << 20, 16 << 20, 64 << 20)}


def profile(size):
    return F.when(size >= 1 << 30, "large-v1").otherwise("standard-v1")


def manifest_findings(chunks: DataFrame, objects: DataFrame, minimum: int, maximum: int) -> DataFrame:
    """(object_id, n_bad): per object, how many chunks (object_id, position, index, offset, bytes) break contiguity or bounds, or miss the total of objects (object_id, object_bytes)."""
    w = Window.partitionBy("object_id").orderBy("position")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = chunks.withColumns({"_at": F.row_number().over(w) - 1, "_end": F.sum("bytes").over(upto), "_last": F.lead("position").over(w).isNull()}).join(objects, "object_id", "left")
    bad = (F.col("index") != F.col("_at")) | (F.col("offset") != F.col("_end") - F.col("bytes")) | (F.col("bytes") < 1) | (F.col("bytes") > maximum)
    bad = bad | (~F.col("_last") & (F.col("bytes") < minimum)) | (F.col("_last") & ~F.col("_end").eqNullSafe(F.col("object_bytes")))
    return j.groupBy("object_id").agg(F.count_if(bad).alias("n_bad"))


def missing_chunks(chunks: DataFrame, received: DataFrame) -> DataFrame:
    """Chunks whose digest has not been received."""
    return chunks.join(received.select("sha256").distinct(), "sha256", "left_anti")


def missing_page(chunks: DataFrame, received: DataFrame, cursor: int, limit: int) -> DataFrame:
    """Of the descriptors cursor <= index < cursor + limit, those that are missing; a page may be empty and still not be the last."""
    if not 1 <= limit <= 4096:
        raise ValueError("limit")
    return missing_chunks(chunks.where((F.col("index") >= cursor) & (F.col("index") < cursor + limit)), received)


def progress(chunks: DataFrame, received: DataFrame) -> DataFrame:
    """(object_id, n_chunks, n_missing, received_bytes, object_bytes)."""
    have = received.select("sha256", F.lit(True).alias("_h")).distinct()
    here = F.coalesce("_h", F.lit(False))
    j = chunks.join(have, "sha256", "left")
    return j.groupBy("object_id").agg(F.count("*").alias("n_chunks"), F.count_if(~here).alias("n_missing"), F.coalesce(F.sum(F.when(here, F.col("bytes"))), F.lit(0)).alias("received_bytes"), F.sum("bytes").alias("object_bytes"))


def storage_totals(chunks: DataFrame) -> DataFrame:
    """One row: distinct chunks, all chunks, bytes of all objects."""
    return chunks.agg(F.count_distinct("sha256").alias("distinct_chunks"), F.count("*").alias("n_chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("object_bytes"))


def accepted_chunks(manifest: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Arrivals (object_id, index, bytes, sha256, arrival) of a transfer that can be resumed, with `outcome`.

    unknown: no such chunk in the manifest (object_id, index, bytes, sha256); wrong_length, then wrong_digest; accepted: the
    first good arrival of a chunk; present: any later one, which changes nothing.
    """
    m = manifest.select("object_id", "index", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    j = arrivals.join(m, ["object_id", "index"], "left")
    fault = F.when(F.col("_b").isNull(), "unknown").when(F.col("bytes") != F.col("_b"), "wrong_length").when(F.col("sha256") != F.col("_s"), "wrong_digest")
    j = j.withColumn("_f", fault).drop("_b", "_s")
    first = j.where("_f is null").groupBy("object_id", "index").agg(F.min("arrival").alias("_first"))
    done = j.join(first, ["object_id", "index"], "left")
    return done.withColumn("outcome", F.coalesce("_f", F.when(F.col("arrival") == F.col("_first"), "accepted").otherwise("present"))).drop("_f", "_first")
