"""Tree relations derived from the driver's tables: an inventory of `documents`, two versions of it, replicas, events and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import paths as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made_id(prefix: str, number, block: str = "7000"):
    return F.concat(F.lit(f"{prefix}_019f0000-0000-{block}-8000-"), F.lpad(number.cast("string"), 12, "0"))


def files(spark, sf_dir) -> DataFrame:
    """doc_id, path, kind, bytes, executable, target, content_sha256, object_id, object_version_id of each document."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        "doc_id", path.alias("path"), F.lit(M.FILE).alias("kind"), F.octet_length("text").cast("long").alias("bytes"), (F.col("doc_id") % 5 == 0).alias("executable"),
        F.lit(None).cast("string").alias("target"), F.sha2(F.col("text"), 256).alias("content_sha256"), made_id("obj", F.col("doc_id")).alias("object_id"), made_id("version", F.col("doc_id")).alias("object_version_id"),
    )


def entries(spark, sf_dir) -> DataFrame:
    """Live entries: files and all directories above them."""
    f = files(spark, sf_dir).select("path", "kind", "bytes", "executable")
    up = f.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    d = up.select("path", F.lit(M.DIRECTORY).alias("kind"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("boolean").alias("executable"))
    return f.unionByName(d).withColumn("symlink_target", F.lit(None).cast("string"))


def exclusions(spark, sf_dir, residue: int) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 31 == residue)
    path = F.concat(F.lit("ext/"), "source", F.lit("/x"), F.col("doc_id").cast("string"))
    nested = F.col("doc_id") % 2 == 0
    return d.select(path.alias("path"), F.when(nested, M.NESTED).otherwise("hard_link").alias("kind"), F.when(nested, M.NESTED_REASON).otherwise(M.UNSUPPORTED_REASON).alias("reason"))


def old_version(spark, sf_dir) -> dict[str, DataFrame]:
    f = files(spark, sf_dir).where("doc_id % 23 <> 4")
    t = files(spark, sf_dir).where("doc_id % 29 = 5").select(F.concat(F.lit("old/"), "path").alias("path"), made_id("obj", F.col("doc_id"), "7fff").alias("object_id"), F.lit(M.FILE).alias("deleted_kind"), made_id("version", F.col("doc_id"), "7fff").alias("last_object_version_id"))
    return {"bindings": f.drop("doc_id"), "tombstones": t, "exclusions": exclusions(spark, sf_dir, 6)}


def new_version(spark, sf_dir) -> dict[str, DataFrame]:
    f = files(spark, sf_dir).where("doc_id % 11 <> 0")
    n, edit, again = F.col("doc_id"), F.col("doc_id") % 17 == 2, F.col("doc_id") % 19 == 3
    f = f.select(
        F.when(n % 13 == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "kind", "bytes", "executable", "target",
        F.when(edit, F.sha2(F.concat(F.lit("edit"), "content_sha256"), 256)).otherwise(F.col("content_sha256")).alias("content_sha256"),
        F.when(again, made_id("obj", n, "7999")).otherwise(F.col("object_id")).alias("object_id"),
        F.when(edit | again, made_id("version", n, "7999")).otherwise(F.col("object_version_id")).alias("object_version_id"),
    )
    old = old_version(spark, sf_dir)
    gone = old["bindings"].join(f.select("object_id"), "object_id", "left_anti").select("path", "object_id", F.col("kind").alias("deleted_kind"), F.col("object_version_id").alias("last_object_version_id"))
    kept = old["tombstones"].where(F.substring("object_id", -1, 1) != "5")
    return {"bindings": f, "tombstones": kept.unionByName(gone), "exclusions": exclusions(spark, sf_dir, 6).where("path not like '%7'").unionByName(exclusions(spark, sf_dir, 9))}
