"""Intermediate tables, inputs and joins shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than one in HOT of all rows are joined by broadcast; there are fewer than HOT of them.
HOT = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local one on a single machine (tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="treeline-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/treeline-{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Blocks:
    """Rows staged in buckets of their column `block`: groups of blocks are read, and joined with others, without moving the rows.

    Files lie in the shared folder; the session's catalogue holds the table's name until close(). `rows` reads the files
    by path, so it outlives close().
    """

    def __init__(self, df: DataFrame, name: str):
        spark = self.spark = df.sparkSession
        self.name = f"treeline_{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/treeline-{name}-{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "block").sortBy("block").saveAsTable(self.name)
        self.rows = spark.read.schema(df.schema).parquet(path)

    def grouped(self, *columns):
        """Groups of blocks, of the given columns."""
        return self.spark.table(self.name).select("block", *columns).groupBy("block")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def block_ids(part: int):
    """A counter of block ids that no other task of the stage gives out: next(ids) closes a block."""
    number = part << 33
    while True:
        yield number
        number += 1


def with_facts(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with the one row of `facts` for their key. n: column of facts, how many of the `total` rows have that key.

    Keys with more than total / HOT rows are joined by broadcast: there are fewer than HOT. All others are shuffled, so no
    task gets more than its share of a frequent key. `facts` is read at once, and both sides are read twice where there
    are keys of both sorts, so they should be staged.
    """
    most = max(1000, total // HOT)
    frequent = F.col(n) > most
    some, rest = facts.agg(F.count_if(frequent), F.count_if(~frequent)).first()
    if not some:
        return rows.join(facts, key, how)
    hot = rows.join(F.broadcast(facts.where(frequent)), key)
    if not rest and how == "inner":
        return hot
    cold = rows.join(F.broadcast(facts.where(frequent).select(key)), key, "left_anti")
    return hot.unionByName(cold.join(facts.where(~frequent), key, how))


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/treeline-" in folder:
            path = hadoop(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
