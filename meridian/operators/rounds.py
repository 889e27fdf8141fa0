"""Iteration over DataFrames: lineage cuts in the shared folder and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster shares; where that is unset, a temporary one in local mode and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/round-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below spark.checkpoint.dir and read it back, so a round's plan and recovery start there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) with the smallest id reachable over edges (a, b); isolated ``nodes`` (id) are their own.

    Rounds of large and small stars: each is two aggregations, and the number of rounds grows with the logarithm of the size.
    """
    live = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        live = cut(small.filter("u <> v").distinct())
        now = live.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = live.select(F.col("u").alias("id"), F.col("v").alias("component"))
    if nodes is None:
        nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
