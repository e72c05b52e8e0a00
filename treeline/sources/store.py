"""Writers: blobs by digest, versions, and the pointer to the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest as D

#: Application records that a history holds at most.
MAX_APPLICATIONS = 4096
_PARTS = ("headers", "bindings", "tombstones", "exclusions")


class Conflict(RuntimeError):
    """The stored state isn't the one that the caller saw."""


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def once_each(contents: DataFrame) -> DataFrame:
    """Rows (sha256, ...) of each digest once, with `prefix`, the folder it is kept in, dealt out by ranges of digests, so that a task writes to few folders. Digests are uniform, so no sample is needed to find the ranges."""
    n = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_ = F.floor(F.conv(F.substring("sha256", 1, 6), 16, 10).cast("double") * n / (1 << 24)).cast("int")
    placed = contents.withColumn("prefix", F.concat(F.lit("x"), F.substring("sha256", 1, 2))).withColumn("_range", range_)
    return placed.repartition(n, "_range").dropDuplicates(["_range", "sha256"]).drop("_range")


def install_blobs(objects: DataFrame, folder: str) -> None:
    """Add the contents (column content) that the store lacks, each once, in directories by the digest's first byte. Null contents are left out."""
    spark = objects.sparkSession
    new = once_each(objects.where("content is not null").select(F.sha2("content", 256).alias("sha256"), "content"))
    files, at = _file_system(spark, folder)
    if files.exists(at):
        # only the directories that the new digests fall into are read: at most 256
        prefixes = [r["prefix"] for r in new.select("prefix").distinct().collect()]
        held = spark.read.parquet(folder).where(F.col("prefix").isin(prefixes)).select("prefix", "sha256")
        new = new.join(held, ["prefix", "sha256"], "left_anti")
    new.select("sha256", "content", "prefix").write.partitionBy("prefix").mode("append").parquet(folder)


def install_version(parts: dict[str, DataFrame], folder: str, version_id: str) -> str:
    """Write the four relations of a version once, read them back, and return the digest; Conflict if it isn't that of what was given."""
    spark = parts["headers"].sparkSession
    want = D.version_digests(**parts).first()["version_sha256"]
    for name in _PARTS:
        parts[name].write.mode("errorifexists").parquet(f"{folder}/{version_id}/{name}")
    got = D.version_digests(**read_version(spark, folder, version_id)).first()["version_sha256"]
    if got != want:
        raise Conflict(f"{version_id}: stored with digest {got}, not {want}")
    return got


def read_version(spark: SparkSession, folder: str, version_id: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{version_id}/{name}") for name in _PARTS}


def head(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """(generation, version id) of the current version; (0, None) if there is none."""
    files, at = _file_system(spark, folder)
    found = sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []
    found = [name for name in found if name.isdigit()]
    if not found:
        return 0, None
    files, at = _file_system(spark, f"{folder}/{found[-1]}")
    stream = files.open(at)
    try:
        return int(found[-1]), spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def swap_head(spark: SparkSession, folder: str, expected: str | None, version_id: str) -> int:
    """Make `version_id` current if `expected` still is, and return the new generation.

    A generation is a file that is written under a name of its own and then renamed without overwriting, so of two writers
    one gets Conflict, and one that dies on the way blocks nobody. The rename is atomic where the file system's is.
    """
    number, now = head(spark, folder)
    if now != expected:
        raise Conflict(f"the current version is {now}")
    files, draft = _file_system(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(version_id.encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{folder}/{number + 1:012d}"), plain)
    except Exception as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"generation {number + 1} is taken") from error
        raise
    return number + 1


def applications(spark: SparkSession, folder: str) -> DataFrame:
    """A root's application records (number, record_id, predecessor, template, version), by number."""
    return spark.read.schema("number long, record_id string, predecessor string, template string, version string").json(f"{folder}/records").orderBy("number")


def append_application(spark: SparkSession, folder: str, record_id: str, predecessor: str | None, template: str, version: str) -> int:
    """Add a record after the current last one and return its number; Conflict if `predecessor` isn't the last one, the id is used, or the history is full.

    The last record is a pointer that is swapped like the current version's, so two writers can't both follow it.
    """
    number, last = head(spark, f"{folder}/last")
    if last != predecessor:
        raise Conflict(f"the last record is {last}")
    if number >= MAX_APPLICATIONS:
        raise Conflict("the history is full")
    if number and not applications(spark, folder).where(F.col("record_id") == record_id).isEmpty():
        raise Conflict(f"{record_id} is used")
    number = swap_head(spark, f"{folder}/last", predecessor, record_id)
    row = spark.createDataFrame([(number, record_id, predecessor, template, version)], "number long, record_id string, predecessor string, template string, version string")
    row.write.mode("append").json(f"{folder}/records")
    return number
