"""Measurements on pixel frames: backgrounds, flux scales, subtraction, calibration, profiles and ring structure."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pixels import clipped_statistics, reflect


def background_mesh(pixels: DataFrame, frame: str, box: int) -> DataFrame:
    """(frame, by, bx, level, noise): clipped mode and deviation per box, then the median of the boxes around."""
    boxes = pixels.withColumns({"by": F.floor(F.col("y") / box), "bx": F.floor(F.col("x") / box)})
    mesh = clipped_statistics(boxes, [frame, "by", "bx"]).select(frame, "by", "bx", "mode", F.col("std").alias("noise"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = mesh.select(frame, "by", "bx", "mode", around.alias("d"))
    near = near.select(frame, (F.col("by") + F.col("d.dy")).alias("by"), (F.col("bx") + F.col("d.dx")).alias("bx"), "mode")
    level = near.groupBy(frame, "by", "bx").agg(F.median("mode").alias("level"))
    return mesh.select(frame, "by", "bx", "noise").join(level, [frame, "by", "bx"])


def background(pixels: DataFrame, good: DataFrame, frame: str, box: int, ny: int, nx: int) -> DataFrame:
    """(frame, y, x, level) of all pixels from the mesh of the good ones, bilinear between box centres; a missing box takes the frame's median level."""
    mesh = background_mesh(good, frame, box)
    middle = mesh.groupBy(frame).agg(F.median("level").alias("middle"))
    p = pixels.select(frame, "y", "x", ((F.col("y") + 0.5) / box - 0.5).alias("v"), ((F.col("x") + 0.5) / box - 0.5).alias("u"))
    p = p.withColumns({"fy": F.col("v") - F.floor("v"), "fx": F.col("u") - F.floor("u")})
    p = p.withColumn("d", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1)])))

    def corner(at, step, last):
        return F.least(F.greatest(F.floor(at) + step, F.lit(0)), F.lit(last))

    weight = F.when(F.col("d.dy") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("d.dx") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    p = p.select(frame, "y", "x", weight.alias("w"), corner(F.col("v"), F.col("d.dy"), (ny - 1) // box).alias("by"), corner(F.col("u"), F.col("d.dx"), (nx - 1) // box).alias("bx"))
    got = p.join(mesh, [frame, "by", "bx"], "left").join(middle, frame)
    return got.groupBy(frame, "y", "x").agg(F.sum(F.col("w") * F.coalesce("level", "middle")).alias("level"))


def near_pixels(sources: DataFrame, pixels: DataFrame, frame: str, reach: float, size: float = 8.0) -> DataFrame:
    """Pixels within ``reach`` in x and y of (source_id, frame, sx, sy); both sides meet in cells of a frame."""
    xs = F.sequence(F.floor((F.col("sx") - reach) / size), F.floor((F.col("sx") + reach) / size))
    ys = F.sequence(F.floor((F.col("sy") - reach) / size), F.floor((F.col("sy") + reach) / size))
    s = sources.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))
    p = pixels.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    return p.join(s, [frame, "cx", "cy"]).filter((F.abs(F.col("x") - F.col("sx")) <= reach) & (F.abs(F.col("y") - F.col("sy")) <= reach)).drop("cx", "cy")


def by_cells(sources: DataFrame, pixels: DataFrame, frame: str, reach: float, stage, schema: str, size: float = 32.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """``stage`` (arrays sx, sy of a few sources, then x, y, value, rms of their pixels, then ``extra`` columns of the sources; a tuple of arrays in the order of ``schema``) of (source_id, frame, sx, sy).

    A source goes to the cell of its frame that holds it, a pixel to every cell it can reach, so no row of a source and a pixel is made;
    a stage has at most about 200,000 of them at once, or one source's. Pixels without a value do not count.
    """

    def cells(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))

    s = sources.select("source_id", frame, "sx", "sy", *extra).withColumns({"cx": F.floor(F.col("sx") / size), "cy": F.floor(F.col("sy") / size)})
    kept = pixels.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col(frame).isNotNull())
    p = kept.select(frame, "x", "y", "value", F.col("rms") if "rms" in pixels.columns else F.lit(None).cast("double").alias("rms"))
    p = p.withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    names = [part.split()[0] for part in schema.split(",")]

    def run(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        light, parts = [near[c].to_numpy(float) for c in ("x", "y", "value", "rms")], []
        step = max(1, 200_000 // max(1, len(near)))
        for i in range(0, len(mine), step):
            some = mine.iloc[i : i + step]
            got = stage(some["sx"].to_numpy(float), some["sy"].to_numpy(float), *light, *[some[c].to_numpy(float) for c in extra])
            parts.append(some[["source_id", frame]].assign(**dict(zip(names, got, strict=True))))
        return pd.concat(parts) if parts else mine[["source_id", frame]].reindex(columns=["source_id", frame, *names])

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sources.select("source_id", frame).schema)
    key, spark = [frame, "cx", "cy"], sources.sparkSession
    # few bytes are much work here, and a given number of partitions is not coalesced
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    s, p = s.repartition(n, *key), p.repartition(n, *key)
    return s.groupBy(*key).cogroup(p.groupBy(*key)).applyInPandas(run, f"{keys}, {schema}")


def _gathered(mask: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each row's values where the mask holds, from the left, then infinities."""
    out = np.full((len(mask), max(1, int(mask.sum(axis=1).max(initial=0)))), np.inf)
    row, column = np.nonzero(mask)
    start = np.concatenate(([0], np.cumsum(mask.sum(axis=1))[:-1])) if len(mask) else np.zeros(0, int)
    out[row, np.arange(len(row)) - start[row]] = values[column]
    return out


def _middle(rows: np.ndarray) -> np.ndarray:
    """Medians of sorted rows that end in infinities; NaN of an empty one."""
    n = np.isfinite(rows).sum(axis=1)
    at = np.arange(len(rows))
    return np.where(n > 0, 0.5 * rows[at, np.maximum(n - 1, 0) // 2] + 0.5 * rows[at, np.minimum(n // 2, rows.shape[1] - 1)], np.nan)


def ring_sky(sx, sy, x, y, value, inner: float, outer: float, sigma: float = 3.0, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, deviation and count of each source's ring after ``pixels.sigma_clip``; zeros below five pixels."""
    r = np.hypot(x - sx[:, None], y - sy[:, None])
    rows = np.sort(_gathered((r >= inner) & (r < outer), value), axis=1)
    live = np.arange(len(rows))
    for _ in range(rounds):
        now = rows[live]
        known, middle = np.isfinite(now), _middle(now)
        with np.errstate(invalid="ignore"):
            off = np.where(known, np.abs(now - middle[:, None]), np.inf)
        spread = 1.4826 * _middle(np.sort(off, axis=1))
        zero = ~(spread > 0)
        spread[zero] = _deviation(now[zero])
        with np.errstate(invalid="ignore"):
            keep = known & ((off <= sigma * spread[:, None]) | (spread == 0)[:, None])
        changed = (keep != known).any(axis=1)
        rows[live[changed]] = np.sort(np.where(keep, now, np.inf)[changed], axis=1)
        live = live[changed]
        if not len(live):
            break
    n = np.isfinite(rows).sum(axis=1)
    enough = n >= 5
    return np.where(enough, _middle(rows), 0.0), np.where(enough, _deviation(rows), 0.0), np.where(enough, n, 0)


def _deviation(rows: np.ndarray) -> np.ndarray:
    known = np.isfinite(rows)
    n = np.maximum(known.sum(axis=1), 1)
    mean = np.where(known, rows, 0.0).sum(axis=1) / n
    return np.sqrt((np.where(known, rows - mean[:, None], 0.0) ** 2).sum(axis=1) / n)


def annulus_background(sources: DataFrame, pixels: DataFrame, frame: str, inner: float, outer: float) -> DataFrame:
    """Clipped median, deviation and count of the pixels in a ring around each source; zeros below five pixels."""

    def stage(sx, sy, x, y, value, rms):
        return ring_sky(sx, sy, x, y, value, inner, outer)

    return by_cells(sources, pixels, frame, outer, stage, "level double, rms double, n long")


def flux_scale(science: DataFrame, reference: DataFrame, frame: str) -> DataFrame:
    """(frame, scale): least squares through the origin on pixels bright in both, refitted once without outliers.

    ``reference`` is one frame (y, x, ref). Pixels above 10 sigma in both count; with fewer than 25 those above
    3 sigma; with fewer than 10 the scale is 1. It stays within 0.05 and 20.
    """
    noise = clipped_statistics(science, frame).select(frame, F.col("std").alias("na"))
    one = clipped_statistics(reference.select(F.lit(0).alias("one"), F.col("ref").alias("value")), "one").select(F.col("std").alias("nb"))
    both = science.select(frame, "y", "x", "value").join(reference, ["y", "x"]).join(noise, frame).join(F.broadcast(one))
    above = F.least(F.col("value") / F.col("na"), F.col("ref") / F.col("nb"))
    w = Window.partitionBy(frame)
    both = both.withColumn("above", above)
    level = F.when(F.count_if(F.col("above") > 10).over(w) >= 25, 10).when(F.count_if(F.col("above") > 3).over(w) >= 10, 3)
    good = both.withColumn("level", level).filter("above > level")
    ratio = F.sum(F.col("value") * F.col("ref")) / F.greatest(F.sum(F.col("ref") * F.col("ref")), F.lit(1e-12))
    first = good.groupBy(frame).agg(ratio.alias("s0"))
    good = good.join(first, frame).withColumn("res", F.col("value") - F.col("s0") * F.col("ref"))
    good = good.withColumn("off", F.abs(F.col("res") - F.median("res").over(w)))
    good = good.withColumn("spread", 1.4826 * F.median("off").over(w)).filter("off < 3 * spread")
    second = good.groupBy(frame).agg(F.when(F.count("*") >= 10, ratio).alias("s1"))
    out = noise.select(frame).join(first, frame, "left").join(second, frame, "left")
    return out.select(frame, F.least(F.greatest(F.coalesce("s1", "s0", F.lit(1.0)), F.lit(0.05)), F.lit(20.0)).alias("scale"))


def subtract(science: DataFrame, reference: DataFrame, frame: str) -> DataFrame:
    """(frame, y, x, difference, noise): scaled reference off, then the clipped median of what is left.

    ``reference``: y, x, ref, ref_rms; frames come aligned and of equal seeing.
    """
    scale = flux_scale(science, reference.select("y", "x", "ref"), frame)
    d = science.join(reference, ["y", "x"]).join(scale, frame).withColumn("value", F.col("value") - F.col("scale") * F.col("ref"))
    middle = clipped_statistics(d, frame).select(frame, F.col("median").alias("level"))
    noise = F.sqrt(F.pow("rms", F.lit(2.0)) + F.pow(F.col("scale") * F.col("ref_rms"), F.lit(2.0)))
    return d.join(middle, frame).select(frame, "y", "x", (F.col("value") - F.col("level")).alias("difference"), noise.alias("noise"))


def calibrate(raw: DataFrame, bias: DataFrame, dark: DataFrame, flat: DataFrame, exposure: float) -> DataFrame:
    """(raw - bias - dark * exposure) / (flat / its median); null where the scaled flat is 1e-3 or less."""
    middle = flat.agg(F.median("value").alias("middle"))
    frames = [f.select("y", "x", F.col("value").alias(n)) for f, n in ((bias, "bias_"), (dark, "dark_"), (flat, "flat_"))]
    for f in frames:
        raw = raw.join(f, ["y", "x"])
    raw = raw.join(F.broadcast(middle)).withColumn("gain", F.col("flat_") / F.col("middle"))
    level = F.col("value") - F.col("bias_") - F.col("dark_") * exposure
    return raw.withColumn("value", F.when(F.col("gain") > 1e-3, level / F.col("gain"))).drop("bias_", "dark_", "flat_", "middle", "gain")


def petrosian_radius(pixels: DataFrame, frame: str, cx: float, cy: float, eta: float, most: float, steps: int = 60) -> DataFrame:
    """First radius whose ring (0.9 to 1.1 r) has at most ``eta`` of the mean inside, linear between steps."""
    r = F.hypot(F.col("x") - cx, F.col("y") - cy)
    k = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")
    rows = pixels.select(frame, "value", r.alias("r")).filter(F.col("r") < 1.1 * most).select("*", k).withColumn("edge", 0.5 + F.col("k") * ((most - 0.5) / (steps - 1)))
    ring, inside = (F.col("r") >= F.col("edge") * 0.9) & (F.col("r") < F.col("edge") * 1.1), F.col("r") < F.col("edge")
    means = rows.groupBy(frame, "k", "edge").agg(F.when(F.count_if(ring) >= 3, F.avg(F.when(ring, F.col("value")))).alias("local"), F.when(F.count_if(inside) >= 3, F.avg(F.when(inside, F.col("value")))).alias("mean"))
    o = Window.partitionBy(frame).orderBy("k")
    means = means.withColumn("ratio", F.when(F.abs("mean") > 1e-12, F.col("local") / F.col("mean")))
    means = means.withColumns({"v0": F.lag("ratio").over(o), "r0": F.lag("edge").over(o)})
    fall = F.col("v0") - F.col("ratio")
    at = F.when(F.col("v0").isNull() | (F.abs(fall) < 1e-12), F.col("edge")).otherwise(F.col("r0") + (F.col("v0") - eta) / fall * (F.col("edge") - F.col("r0")))
    low = F.when(F.col("ratio") <= eta, F.struct("k", at.alias("at")))
    return means.groupBy(frame).agg(F.when(F.count("ratio") >= 3, F.min(low)["at"]).alias("radius"))


def fourier_modes(pixels: DataFrame, frame: str, cx: float, cy: float, modes: int = 6) -> DataFrame:
    """(frame, ring, mode, amplitude over mode 0, phase) of each whole-pixel ring."""
    angle, m = F.atan2(F.col("y") - cy, F.col("x") - cx), F.explode(F.sequence(F.lit(0), F.lit(modes))).alias("mode")
    rows = pixels.select(frame, "value", F.floor(F.hypot(F.col("x") - cx, F.col("y") - cy)).alias("ring"), angle.alias("angle"), m)
    turn = F.col("mode") * F.col("angle")
    s = rows.groupBy(frame, "ring", "mode").agg(F.sum(F.col("value") * F.cos(turn)).alias("re"), (-F.sum(F.col("value") * F.sin(turn))).alias("im"), F.abs(F.sum("value")).alias("mean"))
    return s.select(frame, "ring", "mode", F.when(F.col("mean") > 1e-12, F.hypot("re", "im") / F.col("mean")).otherwise(0.0).alias("amplitude"), F.atan2("im", "re").alias("phase"))


def phase_winding(phases: DataFrame, frame: str) -> DataFrame:
    """Slope and R2 of the unwrapped phase over the log of the ring's middle radius; zeros below five rings."""
    o = Window.partitionBy(frame).orderBy("ring")
    turns = F.coalesce(-F.round((F.col("phase") - F.lag("phase").over(o)) / (2 * math.pi)), F.lit(0.0))
    rows = phases.withColumn("turns", turns).withColumn("whole", F.col("phase") + 2 * math.pi * F.sum("turns").over(o)).withColumn("lr", F.log(F.col("ring") + 0.5))
    enough = F.count("*") >= 5
    return rows.groupBy(frame).agg(F.when(enough, F.regr_slope("whole", "lr")).otherwise(0.0).alias("slope"), F.when(enough, F.regr_r2("whole", "lr")).otherwise(0.0).alias("r2"))


def subtract_smooth(pixels: DataFrame, frame: str, cx: float, cy: float, most: float, bins: int = 40, share: float = 0.25) -> DataFrame:
    """Pixels less the given percentile of their radius bin; bins below four pixels are left alone."""
    r = F.hypot(F.col("x") - cx, F.col("y") - cy)
    rows = pixels.withColumn("bin", F.least(F.floor(r / (most / bins)), F.lit(bins - 1)))
    per = rows.groupBy(frame, "bin").agg(F.when(F.count("*") >= 4, F.percentile("value", F.lit(share))).otherwise(0.0).alias("smooth"))
    return rows.join(per, [frame, "bin"]).withColumn("value", F.col("value") - F.col("smooth")).drop("smooth", "bin")


def ring_completeness(residual: DataFrame, frame: str, cx: float, cy: float, radius: float, width: float, bins: int) -> DataFrame:
    """Share of the angle bins of a ring whose mean is above 1.5 sigma, and that mean's level over the noise."""
    noise = clipped_statistics(residual, frame).select(frame, F.greatest("std", F.lit(1e-9)).alias("noise"))
    turn = (F.atan2(F.col("y") - cy, F.col("x") - cx) + math.pi) / (2 * math.pi)
    ring = residual.filter(F.abs(F.hypot(F.col("x") - cx, F.col("y") - cy) - radius) <= max(width, 1.0))
    per = ring.groupBy(frame, F.least(F.floor(turn * bins), F.lit(bins - 1)).alias("bin")).agg(F.avg("value").alias("value"))
    return per.join(noise, frame).groupBy(frame).agg(F.avg((F.col("value") > 1.5 * F.col("noise")).cast("double")).alias("completeness"), F.avg(F.col("value") / F.col("noise")).alias("significance"))


def bad_lines(pixels: DataFrame, frame: str, size: int, sigma: float = 6.0, share: float = 0.55) -> DataFrame:
    """(frame, axis, line, share): columns (axis x) and rows (y) off their neighbours along most of their length.

    A line's median must leave its five-wide running median by ``sigma`` deviations (not less than a median's own
    error), and ``share`` of its pixels must lie on the same side by half of that.
    """
    whole = clipped_statistics(pixels, frame).filter("std > 0").select(frame, F.col("median").alias("middle"), F.col("std").alias("pixel_noise"))
    rows = pixels.select(frame, "value", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("line")) for a in ("x", "y")])).alias("l")).select(frame, "l.*", "value")
    lines = rows.groupBy(frame, "axis", "line").agg(F.median("value").alias("profile"), F.count("*").alias("n"))
    step = F.explode(F.array(*map(F.lit, (-2, -1, 0, 1, 2)))).alias("d")
    taps = lines.select(frame, "axis", "line", step).select(frame, "axis", "line", reflect(F.col("line") + F.col("d"), size).alias("src"))
    smooth = taps.join(lines.select(frame, "axis", F.col("line").alias("src"), "profile"), [frame, "axis", "src"]).groupBy(frame, "axis", "line").agg(F.median("profile").alias("smooth"))
    left = lines.join(smooth, [frame, "axis", "line"]).select(frame, "axis", "line", "n", (F.col("profile") - F.col("smooth")).alias("value"))
    noise = clipped_statistics(left, [frame, "axis"]).select(frame, "axis", "std")
    floor = F.greatest("std", 1.2533 * F.col("pixel_noise") / F.sqrt("n"))
    off = left.join(noise, [frame, "axis"]).join(whole, frame).filter(F.abs("value") > sigma * floor).select(frame, "axis", "line", "middle", F.col("value").alias("off"))
    same = (F.col("value") - F.col("middle")) * F.sign("off") > 0.5 * F.abs("off")
    return rows.join(off, [frame, "axis", "line"]).groupBy(frame, "axis", "line").agg(F.avg(same.cast("double")).alias("share")).filter(F.col("share") >= share)


def percentile_stretch(pixels: DataFrame, low: float = 0.01, high: float = 0.995, log_scale: float | None = None) -> DataFrame:
    """Add ``stretched``: each frame's values between two of its percentiles as 0 to 1, by a logarithm with ``log_scale``."""
    limits = pixels.groupBy("epoch").agg(F.percentile("value", [low, high]).alias("limits"))
    scaled = (F.col("value") - F.col("limits")[0]) / F.greatest(F.col("limits")[1] - F.col("limits")[0], F.lit(1e-12))
    scaled = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
    if log_scale:
        scaled = F.log(log_scale * scaled + 1) / F.log(F.lit(log_scale + 1))
    return pixels.join(limits, "epoch").withColumn("stretched", scaled).drop("limits")


def robust_score(pixels: DataFrame) -> DataFrame:
    """Add ``score``: values as distances from their frame's median in robust sigmas."""
    middle = pixels.groupBy("epoch").agg(F.median("value").alias("middle"))
    away = pixels.join(middle, "epoch").withColumn("away", F.col("value") - F.col("middle"))
    sigma = away.groupBy("epoch").agg((1.4826 * F.median(F.abs("away"))).alias("sigma"))
    return away.join(sigma, "epoch").withColumn("score", F.col("away") / F.greatest("sigma", F.lit(1e-9))).drop("middle", "away", "sigma")


def boxcar_extract(pixels: DataFrame, trace: float, half_width: float) -> DataFrame:
    """Spectrum of each slit frame: per column the pixels near the trace, less the median of the others."""
    near = F.abs(F.col("y") - trace) <= half_width
    by_column = pixels.groupBy("epoch", "x")
    sums = by_column.agg(F.sum(F.when(near, F.col("value"))).alias("total"), F.count_if(near).alias("n"), F.median(F.when(~near, F.col("value"))).alias("sky"), F.sqrt(F.sum(F.when(near, F.col("rms") ** 2))).alias("error"))
    return sums.select("epoch", "x", (F.col("total") - F.col("n") * F.col("sky")).alias("flux"), "error")


def forced_photometry(pixels: DataFrame, positions: list[tuple[float, float]], radius: float = 4.0, annulus: tuple[float, float] = (8.0, 14.0)) -> DataFrame:
    """Light curve of each given position: flux in the aperture less the annulus' median, in every epoch. The positions are a literal list."""
    at = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for n, (x, y) in enumerate(positions)])
    rows = pixels.filter(~F.col("bad")).withColumn("at", F.explode(at))
    r = F.sqrt((F.col("x") - F.col("at.x")) ** 2 + (F.col("y") - F.col("at.y")) ** 2)
    rows = rows.withColumn("r", r).filter(F.col("r") <= annulus[1])
    inside, ring = F.col("r") <= radius, F.col("r") >= annulus[0]
    sums = rows.groupBy(F.col("at.n").alias("position"), "epoch", "mjd").agg(F.sum(F.when(inside, F.col("value"))).alias("total"), F.count_if(inside).alias("n_pix"), F.median(F.when(ring, F.col("value"))).alias("sky"), F.sqrt(F.sum(F.when(inside, F.col("rms") ** 2))).alias("flux_err"))
    return sums.select("position", "epoch", "mjd", (F.col("total") - F.col("n_pix") * F.coalesce("sky", F.lit(0.0))).alias("flux"), "flux_err")


def bilinear(pixels: DataFrame, dx: float, dy: float) -> DataFrame:
    """Frames sampled between their pixels, at (x + dx, y + dy), each pixel adding its share to the samples beside it."""
    shares = [(0, 0, (1 - dx) * (1 - dy)), (1, 0, dx * (1 - dy)), (0, 1, (1 - dx) * dy), (1, 1, dx * dy)]
    parts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(float(w)).alias("w")) for x, y, w in shares])
    sent = pixels.select("epoch", "x", "y", "value", F.explode(parts).alias("part"))
    sent = sent.groupBy("epoch", (F.col("y") - F.col("part.y")).alias("y"), (F.col("x") - F.col("part.x")).alias("x"))
    return sent.agg(F.sum(F.col("value") * F.col("part.w")).alias("sample"), F.count("*").alias("corners")).filter("corners = 4").drop("corners")


def block_function(pixels: DataFrame, factor: int, function, name: str) -> DataFrame:
    """Any function of a block's values, handed over as one pandas Series a block."""

    def reduce(values: pd.Series) -> float:
        return function(values)

    reduce = F.pandas_udf(reduce, "double", F.PandasUDFType.GROUPED_AGG)

    block = [(F.floor(F.col(c) / factor)).cast("int").alias(f"b{c}") for c in ("y", "x")]
    return pixels.groupBy("epoch", *block).agg(reduce("value").alias(name))
