"""Packages that make a root again: an index of objects, their chunk manifests, and chunks by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import chunked
from ..operators import closure
from ..operators.transfer import PROFILES
from ..plans.staging import staged
from .store import once_each

_PARTS = ("index", "manifests")


def _pieces(objects: DataFrame, cuts: DataFrame) -> DataFrame:
    """(sha256, data) of the chunks of objects (object_id, content)."""
    whole = cuts.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("index", "offset", "bytes", "sha256"))).alias("cuts"))
    each = objects.join(whole, "object_id").select("content", F.explode("cuts").alias("c"))
    return each.select("c.sha256", F.expr("substring(content, int(c.offset) + 1, int(c.bytes))").alias("data"))


def write_package(objects: DataFrame, folder: str, profile: tuple[int, int, int] = PROFILES["standard-v1"]) -> None:
    """Stage objects (object_id, path, content) as a package: index, manifests, and each distinct chunk once, in folders by the digest's first byte. An empty object has no chunks."""
    contents = objects.select("object_id", "content")
    cuts = staged(chunked(contents, profile))
    once_each(_pieces(contents, cuts)).write.partitionBy("prefix").mode("errorifexists").parquet(f"{folder}/chunks")
    cuts.select("object_id", "index", "sha256", "bytes").write.mode("errorifexists").parquet(f"{folder}/manifests")
    objects.select("object_id", "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes")).write.mode("errorifexists").parquet(f"{folder}/index")


def read_package(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in _PARTS} | {"chunks": spark.read.parquet(f"{folder}/chunks").select("sha256", "data")}


def package_problems(package: dict[str, DataFrame]) -> DataFrame:
    """(key, problem): objects whose manifest doesn't add up (`bytes`) or is missing, and chunks that manifests name and the package lacks."""
    total = package["manifests"].groupBy("object_id").agg(F.sum("bytes").alias("_b"))
    off = package["index"].join(total, "object_id", "left").where(F.coalesce("_b", F.lit(0)) != F.col("bytes")).select(F.col("object_id").alias("key"), F.lit("bytes").alias("problem"))
    lost = closure.unresolved(package["manifests"].select("sha256").distinct(), package["chunks"], "sha256", "sha256").select(F.col("sha256").alias("key"), F.lit("missing").alias("problem"))
    return off.unionByName(lost)


def rebuilt(package: dict[str, DataFrame]) -> DataFrame:
    """(path, content) of every object, put together from its chunks and checked against its digest; a wrong one is an error.

    An object's chunks meet in one task in order, as its content must; objects are spread over all tasks.
    """
    parts = package["manifests"].join(package["chunks"], "sha256").select("object_id", "index", "data")
    whole = package["index"].select("object_id", "path", F.col("sha256").alias("want"), F.lit(-1).cast("long").alias("index"), F.lit(None).cast("binary").alias("data"))
    rows = whole.unionByName(parts.select("object_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("want"), F.col("index").cast("long").alias("index"), "data"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = want = None
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            content = b"".join(held)
            if hashlib.sha256(content).hexdigest() != want:
                raise ValueError(f"{path}: the chunks don't make the object")
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], names=["path", "content"])

        for batch in batches:
            for new, sha, data in zip(*(batch.column(c).to_pylist() for c in ("path", "want", "data")), strict=True):
                if sha is not None:
                    if want is not None:
                        yield close()
                    path, want, held = new, sha, []
                else:
                    held.append(data)
        if want is not None:
            yield close()

    dealt = rows.repartition("object_id").sortWithinPartitions("object_id", "index")
    return dealt.select("path", "want", "data").mapInArrow(join, "path string, content binary")
