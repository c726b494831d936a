"""Cutting the lineage of loops where every executor can read it again, and the loop that most need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor reach, as the session's spark.checkpoint.dir or its context names it.

    Where neither does, a local master (one machine, as in tests) gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        named = tempfile.mkdtemp(prefix="loam-")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df through a reliable checkpoint; lost executors recompute nothing above it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut(), for wide or long tables and for loops: compressed Parquet in the shared folder, planned and run once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/loam-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node on an edge to another.

    edges: two columns a and b of any one type that has an order and no nulls. Each round hooks every
    node to its smallest smaller neighbour, jumps pointers until trees are stars, and contracts;
    the nodes on edges shrink at least by half a round. Aggregates are
    mins, so a hub's edges combine before the shuffle. Every step is a written table, so plans stay small however many rounds there are.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    left = stored(edges.select(lo, hi).where("lo < hi").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        up = stored(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = stored(up.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(up)
        by = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        moved = left.join(by("lo"), "lo", "left").join(by("hi"), "hi", "left")
        moved = moved.select(F.coalesce("lo_root", "lo").alias("a"), F.coalesce("hi_root", "hi").alias("b"))
        left = stored(moved.select(lo, hi).where("lo < hi").distinct())
    if not rounds:
        return left.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    # From the last round back: where a round's roots went later.
    found = rounds.pop()
    while rounds:
        up = rounds.pop()
        later = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = stored(up.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(found))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
