"""A field's growth curve: the share of a star's light inside a radius, from the field's bright stars, with what lies beyond the last radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import cut

#: Least and most stars, allowed fall of a curve, least annulus pixels, slope that has turned over, most light beyond, least deficit.
LEAST_STARS, MOST_STARS, FALL, LEAST_SKY, LEAST_SLOPE, MOST_BEYOND, LEAST_DEFICIT = 5, 12, 0.02, 20, 0.3, 0.08, 1e-4


def star_curves(stars: DataFrame, pixels: DataFrame, frame: str, far: float, steps: int = 40, annulus: tuple[float, float] = (2.0, 8.0), parts: int = 5, most: int = MOST_STARS) -> DataFrame:
    """(frame, star, snr, k, radius, share) of stars (frame, star, x, y, snr): light inside ``steps`` radii from 1 to ``far`` over that inside the last.

    Only a frame's ``most`` brightest stars are taken, since fainter wings are noise. Pixels and stars meet in cells as wide as the annulus reaches; a pixel counts by its parts x parts pieces, less the annulus' median.
    A curve is left out if its annulus has too few pixels, its total or first light is not positive, or it falls.
    """
    reach = far + annulus[1]
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    bright = F.row_number().over(Window.partitionBy(frame).orderBy(F.desc("snr"), "star"))
    stars = stars.withColumn("rank_", bright).filter(F.col("rank_") <= most)
    placed = stars.select(frame, "star", "snr", F.col("x").alias("sx"), F.col("y").alias("sy"), near.alias("d"))
    placed = placed.select("*", (F.floor(F.col("sx") / reach) + F.col("d.i")).alias("cx"), (F.floor(F.col("sy") / reach) + F.col("d.j")).alias("cy")).drop("d")
    cells = pixels.select(frame, "x", "y", "value", F.floor(F.col("x") / reach).alias("cx"), F.floor(F.col("y") / reach).alias("cy"))
    pairs = cells.join(placed, [frame, "cx", "cy"]).withColumn("r", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")))
    pairs = cut(pairs.filter((F.col("r") <= reach) & F.col("value").isNotNull() & ~F.isnan("value")).drop("cx", "cy"))
    sky = pairs.filter(F.col("r").between(far + annulus[0], reach)).groupBy(frame, "star").agg(F.median("value").alias("sky"), F.count("*").alias("n_sky"))
    inside = pairs.filter(F.col("r") <= far + 1).join(sky.filter(F.col("n_sky") >= LEAST_SKY), [frame, "star"])
    piece = F.explode(F.array(*[F.struct(F.lit((i + 0.5) / parts - 0.5).alias("u"), F.lit((j + 0.5) / parts - 0.5).alias("w")) for i in range(parts) for j in range(parts)]))
    inside = inside.withColumn("p", piece).withColumn("r", F.hypot(F.col("x") + F.col("p.u") - F.col("sx"), F.col("y") + F.col("p.w") - F.col("sy")))
    step = (far - 1) / (steps - 1)
    k = F.greatest(F.ceil((F.col("r") - 1) / step - 1e-9), F.lit(0)).cast("int")
    light = inside.withColumn("k", k).filter(F.col("k") < steps).groupBy(frame, "star", "snr", "k").agg(F.sum((F.col("value") - F.col("sky")) / parts**2).alias("light"))
    whole = light.select(frame, "star", "snr").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    order = Window.partitionBy(frame, "star").orderBy("k")
    curve = whole.join(light, [frame, "star", "snr", "k"], "left").withColumn("inside", F.sum(F.coalesce("light", F.lit(0.0))).over(order))
    curve = curve.withColumn("total", F.last("inside").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    curve = curve.filter("total > 0").withColumn("share", F.col("inside") / F.col("total"))
    curve = curve.withColumn("bad", (F.col("share") - F.lag("share").over(order) < -FALL) | ((F.col("k") == 0) & (F.col("share") <= 0)))
    curve = curve.withColumn("spoilt", F.max(F.coalesce("bad", F.lit(False))).over(Window.partitionBy(frame, "star")))
    return curve.filter("NOT spoilt").select(frame, "star", "snr", "k", (F.lit(1.0) + F.col("k") * step).alias("radius"), "share")


def growth_curve(curves: DataFrame, frame: str, least: int = LEAST_STARS, most: int = MOST_STARS) -> DataFrame:
    """(frame, radius, enclosed, scatter, n_stars, missing_beyond): median of the brightest stars' curves, never falling.

    Light beyond the last radius follows from the outer third, where the deficit of a power-law wing is a line in logarithms; a
    line that has not turned over says nothing, and no more than 0.08 is believed. Fields with fewer than ``least`` curves have none.
    """
    rank = F.dense_rank().over(Window.partitionBy(frame).orderBy(F.desc("snr"), "star"))
    rows = curves.withColumn("rank", rank).filter(F.col("rank") <= most)
    n = rows.groupBy(frame).agg(F.countDistinct("star").alias("n_stars"), F.max("k").alias("last")).filter(F.col("n_stars") >= least)
    rows = rows.join(n, frame)
    middle = rows.groupBy(frame, "k", "radius", "n_stars", "last").agg(F.median("share").alias("m"))
    spread = rows.join(middle.select(frame, "k", "m"), [frame, "k"]).groupBy(frame, "k").agg((1.4826 * F.median(F.abs(F.col("share") - F.col("m")))).alias("scatter"))
    order = Window.partitionBy(frame).orderBy("k")
    curve = middle.join(spread, [frame, "k"]).withColumn("enclosed", F.max(F.least(F.greatest("m", F.lit(0.0)), F.lit(1.0))).over(order))
    count = F.col("last") + 1
    outer = curve.filter((F.col("k") >= F.greatest(F.floor(2 * count / 3), F.lit(2))) & (1 - F.col("enclosed") > LEAST_DEFICIT) & (F.col("radius") > 0))
    line = outer.groupBy(frame).agg(F.count("*").alias("n"), F.regr_slope(F.log(1 - F.col("enclosed")), F.log("radius")).alias("slope"), F.regr_intercept(F.log(1 - F.col("enclosed")), F.log("radius")).alias("start"))
    far = curve.groupBy(frame).agg(F.max("radius").alias("far"))
    believed = (F.col("n") >= 4) & (-F.col("slope") >= LEAST_SLOPE)
    beyond = F.when(believed, F.least(F.greatest(F.exp(F.col("start") + F.col("slope") * F.log("far")), F.lit(0.0)), F.lit(MOST_BEYOND))).otherwise(0.0)
    missing = far.join(line, frame, "left").select(frame, F.coalesce(beyond, F.lit(0.0)).alias("missing_beyond"))
    out, left = curve.join(missing, frame), 1 - F.col("missing_beyond")
    return out.select(frame, "radius", (F.col("enclosed") * left).alias("enclosed"), (F.col("scatter") * left).alias("scatter"), "n_stars", "missing_beyond")
