"""Exact quantiles from ranks over a distributed sort: no task holds a group, whatever its size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .match import number_rows
from .rounds import cut


def group_quantiles(rows: DataFrame, by: list[str], column: str, shares: list[float]) -> DataFrame:
    """(by..., share, value, n): quantiles of each group by linear interpolation, missing values left out.

    All groups are ranked by one sort of (group, value); a group's rows follow one another, so a quantile is one or two ranks.
    """
    rows = rows.select(*by, F.col(column).cast("double").alias("v_")).filter(F.col("v_").isNotNull() & ~F.isnan("v_"))
    ranked = cut(number_rows(rows, *by, "v_"))
    groups = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.min("number").alias("first_"))
    at = groups.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("h_", F.col("share") * (F.col("n") - 1))
    ends = at.withColumn("number", F.explode(F.array(F.floor("h_"), F.ceil("h_")))).withColumn("number", F.col("number") + F.col("first_"))
    value = ranked.select("number", "v_")
    found = ends.join(value, "number").groupBy(*by, "share", "n", "h_").agg(F.min("v_").alias("low"), F.max("v_").alias("high"))
    return found.select(*by, "share", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("h_") - F.floor("h_"))).alias("value"), "n")


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Quantiles of a whole column, null where it has no value; only they reach the driver."""
    found = {r.share: r.value for r in group_quantiles(rows.withColumn("all_", F.lit(0)), ["all_"], column, sorted(set(shares))).collect()}
    return [found.get(float(s), math.nan) for s in shares]


def median_and_mad(rows: DataFrame, column: str) -> tuple[float, float]:
    """Median and 1.4826 times the median absolute deviation; NaN without values."""
    middle = quantiles(rows, column, [0.5])[0]
    if math.isnan(middle):
        return math.nan, math.nan
    return middle, 1.4826 * quantiles(rows.select(F.abs(F.col(column) - F.lit(middle)).alias("away_")), "away_", [0.5])[0]
