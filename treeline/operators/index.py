"""A rebuildable index of live rows: it changes speed only, so any doubt makes it stale."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import paths as P
from .checks import out_of_order
from .query import generation as digest
from .query import row_key

FORMAT = "live-index-v1"


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _header(spark: SparkSession, folder: str) -> dict | None:
    """The header of the index that is in use; None if there is none, an empty one if it can't be read."""
    files, at = _file(spark, f"{folder}/current.json")
    if not files.exists(at):
        return None
    try:
        stream = files.open(at)
        try:
            return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    except Exception:  # spoilt, or not whole
        return {}


def _ordered(rows: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.orderBy(row_key()), exclusions.orderBy("path")


def rebuild(rows: DataFrame, exclusions: DataFrame, folder: str, generation: str, most: int | None = M.MAX_ENTRIES) -> dict:
    """Replace the index in `folder` by query rows and exclusions of a generation; counts of both. An index beyond `most` records (None: no bound) isn't kept, and the old one stays.

    Data are written under a name of their own and read back before the header names them, so a lost writer leaves the old
    index in use.
    """
    spark, path = rows.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    for name, df in zip(("rows", "exclusions"), _ordered(rows, exclusions), strict=True):
        df.write.parquet(f"{path}/{name}")
    got = [spark.read.parquet(f"{path}/{n}") for n in ("rows", "exclusions")]
    counts = [df.count() for df in got]
    if most is not None and sum(counts) > most:
        raise ValueError(f"{sum(counts)} records are more than an index holds")
    header = {"format": FORMAT, "generation": generation, "data": path, "content": digest(*got), "records": counts[0], "exclusions": counts[1]}
    files, draft = _file(spark, f"{folder}/{uuid.uuid4().hex}.json")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(header).encode()))
    stream.close()
    _, current = _file(spark, f"{folder}/current.json")
    files.delete(current, False)
    files.rename(draft, current)
    return {"records": counts[0], "exclusions": counts[1]}


def status(spark: SparkSession, folder: str, generation: str, most: int | None = M.MAX_ENTRIES) -> dict:
    """state (absent, stale, fresh), generation and records of the index, given the generation observed now.

    Fresh: the header is whole and of this format and generation, the records are within the bound (None: there is none), in strict order and of
    portable paths, and their digest is the header's.
    """
    header = _header(spark, folder)
    if header is None:
        return {"state": "absent", "generation": None, "records": 0}
    records, held = header.get("records", 0), header.get("records", 0) + header.get("exclusions", 0)
    out = {"state": "stale", "generation": header.get("generation"), "records": records if most is None else min(records, most)}
    if header.get("format") != FORMAT or header.get("generation") != generation or (most is not None and held > most):
        return out
    try:
        rows, exclusions = (spark.read.parquet(f"{header['data']}/{n}") for n in ("rows", "exclusions"))
        whole = digest(rows, exclusions) == header["content"]
    except Exception:  # data that are missing or spoilt
        return out
    paths = rows.select("path").unionByName(exclusions.select("path"))
    keyed = rows.withColumn("_k", row_key())
    sound = whole and paths.where(~P.path_valid(F.col("path"))).isEmpty() and keyed.groupBy("_k").count().where("count > 1").isEmpty() and exclusions.groupBy("path").count().where("count > 1").isEmpty()
    return out | {"state": "fresh"} if sound else out


def read(spark: SparkSession, folder: str, generation: str, most: int | None = M.MAX_ENTRIES) -> tuple[DataFrame, DataFrame] | None:
    """Rows and exclusions of a fresh index; None if it is absent or stale, and the caller scans instead."""
    if status(spark, folder, generation, most)["state"] != "fresh":
        return None
    at = _header(spark, folder)["data"]
    return spark.read.parquet(f"{at}/rows"), spark.read.parquet(f"{at}/exclusions")


def in_order(rows: DataFrame) -> bool:
    """Whether rows with `place` strictly ascend by the row key."""
    return out_of_order(rows.withColumn("_k", row_key()), "_k", "place").isEmpty()
