"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import staged, unstage, with_facts


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with `m`, the least v of u, and the staged table of these; a hub's edges are not brought together."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    return with_facts(edges, least, "u", "n", total), least


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of `edges` (u, v); root is the least node reachable.

    Alternates large-star and small-star steps until nothing changes; each step's edges never exceed those before, a hub
    (a node of more than one in 500 edges) is aggregated to its least neighbour, which its edges then get by broadcast, and
    the driver sees one row (count and checksum) for each round. Null ends and self-links are no links; no links give no rows.
    """
    now = staged(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == seen or sign["n"] == 0:
            break
        seen = sign
        near, least = _with_least(_both(now), 2 * sign["n"])
        large = staged(near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        near, lower = _with_least(large, sign["n"])
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        new = staged(small.distinct(), "edges")
        for old in (now, large, least, lower):
            unstage(old)
        now = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
