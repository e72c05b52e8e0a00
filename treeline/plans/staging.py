"""Lineage cuts of iterative operators, and numbers in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Where it names none, a local one on a single machine (tests), else an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/treeline-staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """`df` dealt out in ranges of `order` and sorted within, staged, with `_part`, the range's number, and `_at`, the row's place in it."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return staged(dealt).select(*df.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))


def numbered(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """`df` with `name`: places in the order of `order` from `start` + 1. Ranges are sorted apart; only their sizes meet in one task, a row for each range."""
    parts = ranged(df, order)
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    return parts.join(F.broadcast(offsets.select("_part", "_before")), "_part").select(*df.columns, (F.col("_at") + F.col("_before") + start + 1).alias(name))
