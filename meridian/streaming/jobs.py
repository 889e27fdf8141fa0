"""Structured Streaming: alerts without repeats, nightly counts and merged state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_alerts(alerts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One alert per candid; state is kept for the watermark's delay only."""
    return alerts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["candid"])


def nightly_counts(points: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts and the largest flux per night and band; rows later than the watermark are dropped."""
    return points.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "band").agg(F.count("*").alias("n"), F.max("flux").alias("best"))


def object_state(points: DataFrame) -> DataFrame:
    """Per object: count, first and last date and bands, in update mode or as a batch."""
    return points.groupBy("object_id").agg(F.count("*").alias("n"), F.min("mjd").alias("first_mjd"), F.max("mjd").alias("last_mjd"), F.array_sort(F.collect_set("band")).alias("bands"))


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """State tables of two batches as one; merging is associative, so batches may come in any order."""
    both = old.unionByName(new)
    return both.groupBy("object_id").agg(F.sum("n").alias("n"), F.min("first_mjd").alias("first_mjd"), F.max("last_mjd").alias("last_mjd"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bands")))).alias("bands"))


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("source_id").agg(F.max_by(F.struct("label", "reviewer", "seq"), F.struct("ts", "seq")).alias("v")).select("source_id", "v.*")


def run_to_table(stream: DataFrame, merge, path: str, checkpoint: str) -> None:
    """Run a file stream to its end. Each batch is merged into a new version below ``path``, written under its batch id,
    so a repeated batch after a failure overwrites its own version."""

    def step(batch: DataFrame, number: int) -> None:
        merge(batch, f"{path}/v{number - 1}" if number else None).write.mode("overwrite").parquet(f"{path}/v{number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
