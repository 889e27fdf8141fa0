"""Pixel tables (frame, y, x, value): clipping, stencils, stacks, profiles, components and photometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import components, cut


def valid(pixels: DataFrame) -> DataFrame:
    return pixels.filter(F.col("value").isNotNull() & ~F.isnan("value") & ~F.col("bad"))


def sigma_clip(rows: DataFrame, key: str, value: str = "value", sigma: float = 3.0, rounds: int = 5) -> DataFrame:
    """Rows within ``sigma`` scaled MADs of their group's median, round by round; rows of a settled group pass unchanged."""
    w = Window.partitionBy(key)
    for _ in range(rounds):
        middle = F.median(value).over(w)
        rows = rows.withColumn("m_", middle).withColumn("d_", F.abs(F.col(value) - F.col("m_")))
        rows = rows.withColumns({"s_": 1.4826 * F.median("d_").over(w), "sd_": F.stddev_pop(value).over(w)})
        spread = F.when(F.col("s_") > 0, F.col("s_")).otherwise(F.col("sd_"))
        rows = rows.filter((F.col("d_") <= sigma * spread) | (spread == 0)).drop("m_", "d_", "s_", "sd_")
    return rows


def clipped_statistics(rows: DataFrame, key: str) -> DataFrame:
    kept = sigma_clip(rows, key).groupBy(key).agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"), F.count("*").alias("kept"))
    skewed = F.abs(F.col("mean") - F.col("median")) > 0.3 * F.col("std")
    return kept.withColumn("mode", F.when(skewed, F.col("median")).otherwise(2.5 * F.col("median") - 1.5 * F.col("mean")))


def reflect(i: Column, n: int) -> Column:
    """Index folded back at the edges."""
    return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)


def stencil(pixels: DataFrame, frame: str, offsets: list[tuple[int, int, float]], ny: int, nx: int, how: str = "sum") -> DataFrame:
    """Weighted sum, median or max over a neighbourhood: each pixel goes to the places it serves, one grouped aggregation."""
    taps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(float(w)).alias("w")) for a, b, w in offsets]))
    at = pixels.select(frame, "y", "x").withColumn("t", taps)
    at = at.select(frame, "y", "x", reflect(F.col("y") + F.col("t.dy"), ny).alias("sy"), reflect(F.col("x") + F.col("t.dx"), nx).alias("sx"), "t.w")
    got = at.join(pixels.select(frame, F.col("y").alias("sy"), F.col("x").alias("sx"), "value"), [frame, "sy", "sx"])
    agg = {"sum": F.sum(F.col("w") * F.col("value")), "median": F.median("value"), "max": F.max("value")}[how]
    return got.groupBy(frame, "y", "x").agg(agg.alias("value"))


def stack(pixels: DataFrame, method: str = "median") -> DataFrame:
    """One value per pixel over the epochs."""
    if method == "trimmed":
        n = F.count("value")
        total = F.when(n >= 5, (F.sum("value") - F.max("value") - F.min("value")) / (n - 2)).otherwise(F.avg("value"))
        return pixels.groupBy("y", "x").agg(total.alias("value"))
    how = {"median": F.median, "mean": F.avg, "sum": F.sum}[method]
    return pixels.groupBy("y", "x").agg(how("value").alias("value"), F.bool_or("bad").alias("any_bad"), F.bool_and("bad").alias("all_bad"))


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Flux-weighted centroid, semi-axes, position angle, peak and area of each labelled region."""
    w = F.greatest("value", F.lit(0.0))
    s = rows.groupBy(*keys).agg(
        F.sum(w).alias("flux"), F.max("value").alias("peak"), F.count("*").alias("area"),
        (F.sum(w * F.col("x")) / F.nullif(F.sum(w), F.lit(0.0))).alias("cx"), (F.sum(w * F.col("y")) / F.nullif(F.sum(w), F.lit(0.0))).alias("cy"),
        (F.sum(w * F.col("x") * F.col("x")) / F.nullif(F.sum(w), F.lit(0.0))).alias("xx"), (F.sum(w * F.col("y") * F.col("y")) / F.nullif(F.sum(w), F.lit(0.0))).alias("yy"),
        (F.sum(w * F.col("x") * F.col("y")) / F.nullif(F.sum(w), F.lit(0.0))).alias("xy"),
    )
    a, b, c = F.col("xx") - F.col("cx") ** 2, F.col("yy") - F.col("cy") ** 2, F.col("xy") - F.col("cx") * F.col("cy")
    root = F.sqrt(((a - b) / 2) ** 2 + c**2)
    half = (a + b) / 2
    return s.select(*keys, "flux", "peak", "area", "cx", "cy", F.sqrt(F.greatest(half + root, F.lit(0.0))).alias("semi_major"), F.sqrt(F.greatest(half - root, F.lit(0.0))).alias("semi_minor"), (0.5 * F.atan2(2 * c, a - b)).alias("theta"))


#: Pixels in a row of the numbering of pixels; frame numbers go up to 2^23.
SIDE = 1 << 20


def label(pixels: DataFrame, frame: str, threshold: float, connectivity: int = 8, side: int = SIDE) -> DataFrame:
    """Connected regions above a threshold; a region's label is its smallest pixel number, in rows of ``side`` pixels, which no frame may exceed."""
    on = cut(pixels.filter(F.col("value") > threshold).withColumn("id", (F.col(frame).cast("long") * side + F.col("y")) * side + F.col("x")))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps]))
    a = on.select(F.col("id").alias("a"), frame, "y", "x").withColumn("d", near)
    a = a.select("a", frame, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    edges = a.join(on.select(F.col("id").alias("b"), frame, "y", "x"), [frame, "y", "x"]).select("a", "b")
    return on.join(components(edges, on), "id").withColumnRenamed("component", "label")


def gini(pixels: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key)
    v = F.abs("value")
    rank = F.row_number().over(w.orderBy(v, "y", "x"))
    rows = pixels.select(key, v.alias("v"), rank.alias("i"), F.count("*").over(w).alias("n"))
    return rows.groupBy(key).agg((F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("v")) / (F.sum("v") * (F.max("n") - 1))).alias("gini"))


def m20(pixels: DataFrame, key: str) -> DataFrame:
    """Log of the moment of the brightest fifth of the flux over the total moment, about the flux centroid."""
    w = Window.partitionBy(key)
    p = pixels.filter("value > 0")
    total = F.sum("value").over(w)
    cx, cy = F.sum(F.col("value") * F.col("x")).over(w) / total, F.sum(F.col("value") * F.col("y")).over(w) / total
    p = p.withColumns({"total": total, "cx": cx, "cy": cy})
    p = p.withColumn("mom", F.col("value") * ((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2))
    order = w.orderBy(F.desc("value"), "y", "x").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("before", F.coalesce(F.sum("value").over(order), F.lit(0.0)))
    bright = F.sum(F.when(F.col("before") < 0.2 * F.col("total"), F.col("mom")))
    return p.groupBy(key).agg(F.log10(bright / F.sum("mom")).alias("m20"))


def asymmetry(pixels: DataFrame, key: str, cx: float, cy: float) -> DataFrame:
    """Difference to the frame turned by 180 degrees about a centre, over its flux."""
    turned = pixels.select(key, (2 * cy - F.col("y")).cast("int").alias("y"), (2 * cx - F.col("x")).cast("int").alias("x"), F.col("value").alias("other"))
    return pixels.join(turned, [key, "y", "x"]).groupBy(key).agg((F.sum(F.abs(F.col("value") - F.col("other"))) / F.sum(F.abs("value"))).alias("asymmetry"))


def coverage(radius: float) -> Column:
    """Share of the pixel (x, y) within a radius of (sx, sy); edge pixels are split 5 x 5."""
    grid = F.array(*[F.struct(F.lit((i - 2) / 5.0).alias("i"), F.lit((j - 2) / 5.0).alias("j")) for i in range(5) for j in range(5)])
    hits = F.aggregate(grid, F.lit(0.0), lambda n, g: n + F.when((F.col("x") + g["i"] - F.col("sx")) ** 2 + (F.col("y") + g["j"] - F.col("sy")) ** 2 <= radius**2, 1.0).otherwise(0.0)) / 25
    far = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    return F.when(far <= radius - 0.8, 1.0).when(far >= radius + 0.8, 0.0).otherwise(hits)


def covered(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, radius) -> np.ndarray:
    """``coverage`` of arrays: the share of each pixel (a column) within a radius of each source (a row)."""
    sx, sy = sx[:, None], sy[:, None]
    far = np.hypot(x - sx, y - sy)
    out, edge = (far <= radius - 0.8).astype(float), np.nonzero((far > radius - 0.8) & (far < radius + 0.8))
    u, v, limit = x[edge[1]], y[edge[1]], np.broadcast_to(radius**2, far.shape)[edge]
    across, down = [[(c + (i - 2) / 5.0 - s[edge[0], 0]) ** 2 for i in range(5)] for c, s in ((u, sx), (v, sy))]
    out[edge] = sum(((a + b) <= limit).astype(float) for a in across for b in down) / 25
    return out


def apertures(sources: DataFrame, pixels: DataFrame, key: str, radius: float, size: float = 8.0) -> DataFrame:
    """Sub-pixel aperture sums per source and frame: sources and pixels meet in cells, edge pixels are split 5 x 5."""
    reach = radius + 1
    xs = F.sequence(F.floor((F.col("sx") - reach) / size), F.floor((F.col("sx") + reach) / size))
    ys = F.sequence(F.floor((F.col("sy") - reach) / size), F.floor((F.col("sy") + reach) / size))
    s = sources.select(F.col("id").alias("source_id"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    s = s.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))
    p = pixels.select(key, "x", "y", "value", "rms", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    near = p.join(s, ["cx", "cy"]).filter((F.abs(F.col("x") - F.col("sx")) <= reach) & (F.abs(F.col("y") - F.col("sy")) <= reach))
    near = near.withColumn("w", coverage(radius)).filter("w > 0")
    flux = F.sum(F.col("w") * F.col("value"))
    return near.groupBy("source_id", key).agg(flux.alias("flux"), F.sum("w").alias("area"), F.sqrt(F.sum(F.col("w") * F.col("rms") * F.col("rms")) + F.greatest(flux, F.lit(0.0))).alias("flux_err"))


def hold_one_out(pixels: DataFrame) -> DataFrame:
    """Each pixel against the median of the other epochs: three middle values of its sky pixel and its own rank say it."""
    w = Window.partitionBy("y", "x")
    rank = F.row_number().over(w.orderBy(F.asc_nulls_last("value"), "epoch"))
    rows = pixels.withColumns({"rank_": rank, "others_": F.count("value").over(w) - 1})
    low = F.floor((F.col("others_") + 1) / 2)
    rows = rows.withColumns({f"v{i}_": F.max(F.when(F.col("rank_") == low + i, F.col("value"))).over(w) for i in range(3)})
    high = low + (F.col("others_") % 2 == 0).cast("int")
    at = lambda place: F.when(place == low, F.col("v0_")).when(place == low + 1, F.col("v1_")).otherwise(F.col("v2_"))
    skip = lambda place: place + (place >= F.col("rank_")).cast("int")
    middle = (at(skip(low)) + at(skip(high))) / 2
    return rows.withColumn("residual", F.col("value") - F.when(F.col("others_") > 0, middle)).drop("rank_", "others_", "v0_", "v1_", "v2_")


def box_mean(pixels: DataFrame, frame: str, half: int) -> DataFrame:
    """Adds ``smooth``, the mean of the pixels up to ``half`` away in x and y that are there: sums along rows, then along columns."""
    span = lambda a, b: Window.partitionBy(frame, a).orderBy(b).rangeBetween(-half, half)
    rows = pixels.withColumns({"s_": F.sum("value").over(span("y", "x")), "n_": F.count("value").over(span("y", "x"))})
    return rows.withColumn("smooth", F.sum("s_").over(span("x", "y")) / F.sum("n_").over(span("x", "y"))).drop("s_", "n_")


def box_max(pixels: DataFrame, frame: str, half: int) -> DataFrame:
    """Adds ``top``, the largest value up to ``half`` pixels away in x and y: along rows, then along columns. Folding at the edges would add none."""
    span = lambda a, b: Window.partitionBy(frame, a).orderBy(b).rangeBetween(-half, half)
    rows = pixels.withColumn("m_", F.max("value").over(span("y", "x")))
    return rows.withColumn("top", F.max("m_").over(span("x", "y"))).drop("m_")


def smoothness(pixels: DataFrame, frame: str, cx: float, cy: float, petrosian: float, sky: Column | None = None, inner: float = 0.25) -> DataFrame:
    """(frame, smoothness, raw, sky_term, box): light above the box mean between a quarter and 1.5 Petrosian radii, over the light there.

    The box is half a Petrosian radius wide, odd and at least 3. Where ``sky`` marks at least 8 pixels, what the same residual
    has there is taken off. Null without light; with fewer than 8 pixels in the ring its outer edge, then its inner one, is dropped.
    """
    box = max(3, round(2 * max(0.25 * petrosian, 1.0)) | 1)
    r = F.hypot(F.col("x") - cx, F.col("y") - cy)
    on_sky = F.coalesce(sky, F.lit(False)) if sky is not None else F.lit(False)
    # the footprint is what is not sky; both are smoothed together
    rows = box_mean(pixels, frame, box // 2).select(frame, "value", F.greatest(F.col("value") - F.col("smooth"), F.lit(0.0)).alias("res"), r.alias("r"), on_sky.alias("sky"))
    rings = {"a": ~F.col("sky") & (F.col("r") > inner * petrosian) & (F.col("r") <= 1.5 * petrosian), "b": ~F.col("sky") & (F.col("r") > inner * petrosian), "c": ~F.col("sky")}
    sums = [f.alias(f"{k}_{n}") for k, test in rings.items() for n, f in (("n", F.count(F.when(test, 1))), ("res", F.sum(F.when(test, F.col("res")))), ("light", F.sum(F.when(test, F.col("value")))))]
    got = rows.groupBy(frame).agg(*sums, F.count(F.when(F.col("sky"), 1)).alias("n_sky"), F.avg(F.when(F.col("sky"), F.col("res"))).alias("sky_res"))
    pick = lambda n: F.when(F.col("a_n") >= 8, F.col(f"a_{n}")).when(F.col("b_n") >= 8, F.col(f"b_{n}")).otherwise(F.col(f"c_{n}"))
    got = got.select(frame, "n_sky", "sky_res", *[pick(n).alias(n) for n in ("n", "res", "light")]).withColumn("light", F.when(F.col("light") > 0, F.col("light")))
    term = F.when(F.col("light").isNull(), F.lit(None)).when(F.col("n_sky") >= 8, F.col("sky_res") * F.col("n") / F.col("light")).otherwise(0.0)
    got = got.withColumns({"raw": F.col("res") / F.col("light"), "sky_term": term})
    return got.select(frame, (F.col("raw") - F.col("sky_term")).alias("smoothness"), "raw", "sky_term", F.lit(box).alias("box"))
