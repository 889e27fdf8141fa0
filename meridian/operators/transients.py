"""Search for transients over an epoch table: subtract, threshold, label, measure, score and merge."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pixels as P
from . import rules as R
from .linking import merge_epochs
from .rounds import cut

#: Sigmas of a detection, least area, score of a real candidate, edge left out, candidates of an epoch, limits of a flux scale.
SIGMA, LEAST_AREA, REAL, MARGIN, MOST, SCALES = 5.0, 3, 0.7, 6, 500, (0.05, 20.0)


def differences(pixels: DataFrame, frame: str = "epoch") -> DataFrame:
    """Pixels with ``template`` (median of the other epochs), ``difference`` to the scaled template, and its ``noise``.

    The scale of a frame is the least-squares ratio over pixels bright in both: above 10 sigma where there are 25 such, else above 3 where there
    are 10, else 1. The template's share of the noise is that of a mean of the other epochs.
    """
    others = F.count("value").over(Window.partitionBy("y", "x")) - 1
    rows = cut(P.hold_one_out(pixels).withColumn("template", F.col("value") - F.col("residual")).withColumn("others", others).filter("template IS NOT NULL").drop("residual"))
    level = F.least("value", "template") / F.col("rms")
    top, low = (F.count(F.when(level > s, 1)) for s in (10, 3))
    ratio = [F.sum(F.when(level > s, F.col("value") * F.col("template"))) / F.sum(F.when(level > s, F.col("template") * F.col("template"))) for s in (10, 3)]
    scale = F.when(top >= 25, ratio[0]).when(low >= 10, ratio[1]).otherwise(1.0)
    scales = rows.filter("NOT bad").groupBy(frame).agg(F.least(F.greatest(scale, F.lit(SCALES[0])), F.lit(SCALES[1])).alias("scale"))
    rows = rows.join(scales, frame)
    noise = F.col("rms") * F.sqrt(1 + F.col("scale") * F.col("scale") / F.col("others"))
    return rows.withColumns({"difference": F.col("value") - F.col("scale") * F.col("template"), "noise": noise}).drop("others")


def epoch_candidates(pixels: DataFrame, frame: str = "epoch", psf_fwhm: float = 3.0, sigma: float = SIGMA, least_area: int = LEAST_AREA, real: float = REAL, margin: int = MARGIN, most: int = MOST) -> DataFrame:
    """(det_id, epoch, x, y, significance, delta_flux, area, real_bogus, artifact, bogus, dipole): residuals of every epoch, scored by their stamps.

    Regions of at least ``least_area`` pixels above ``sigma``, inside the margin and not bad, are measured about their highest pixel;
    an epoch keeps its ``most`` best.
    """
    diff = cut(differences(pixels, frame))
    edges = diff.groupBy(frame).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inner = F.col("x").between(F.col("x0") + margin, F.col("x1") - margin) & F.col("y").between(F.col("y0") + margin, F.col("y1") - margin)
    on = diff.join(edges, frame).filter(inner & ~F.col("bad")).select(frame, "y", "x", (F.col("difference") / F.col("noise")).alias("value"))
    labels = cut(P.label(on, frame, sigma).select(frame, "y", "x", "label"))
    rows = labels.join(diff.select(frame, "y", "x", "difference", "noise"), [frame, "y", "x"])
    light = F.greatest("difference", F.lit(0.0))
    found = rows.groupBy(frame, "label").agg(
        F.count("*").alias("area"), F.sum(light).alias("delta_flux"), (F.sum(light * F.col("x")) / F.sum(light)).alias("cx"), (F.sum(light * F.col("y")) / F.sum(light)).alias("cy"), F.median("noise").alias("local_noise"),
        F.max_by(F.struct("difference", "y", "x"), F.struct("difference", -F.col("y"), -F.col("x"))).alias("peak"),
    )
    found = cut(found.filter((F.col("area") >= least_area) & (F.col("delta_flux") > 0)))

    # stamps meet their pixels in cells as wide as a stamp
    size = max(11, 2 * math.ceil(3 * psf_fwhm) + 1)
    start = {c: F.greatest(F.col(f"peak.{c}") - size // 2, F.lit(0)) for c in ("y", "x")}
    placed = found.select(frame, "label", "local_noise", start["y"].alias("sy"), start["x"].alias("sx"))
    for c in ("y", "x"):
        placed = placed.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"s{c}") / size), F.floor((F.col(f"s{c}") + size - 1) / size))))
    cells = diff.select(frame, "y", "x", F.col("difference").alias("value"), F.floor(F.col("y") / size).alias("cy"), F.floor(F.col("x") / size).alias("cx"))
    stamps = cells.join(placed, [frame, "cy", "cx"]).filter(F.col("y").between(F.col("sy"), F.col("sy") + size - 1) & F.col("x").between(F.col("sx"), F.col("sx") + size - 1))
    stamps = stamps.select(F.col("label").alias("stamp"), "y", "x", (F.col("value") / F.col("local_noise")).alias("value"))
    # in units of the local noise every feature keeps its value
    features = R.real_bogus(R.stamp_features(stamps, "stamp", 1.0, psf_fwhm)).withColumnRenamed("stamp", "label")
    out = found.join(features, "label").withColumn("significance", F.col("peak.difference") / F.col("local_noise"))
    order = Window.partitionBy(frame).orderBy(F.round("real_bogus", 9).desc(), F.round("significance", 9).desc(), "label")
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    bogus = F.col("real_bogus") < real
    return cut(out.select(
        (F.col(frame).cast("long") * 1_000_000 + F.col("rank")).alias("det_id"), F.col(frame).alias("epoch"), F.col("cx").alias("x"), F.col("cy").alias("y"), "significance", "delta_flux", "area", "real_bogus",
        F.when(bogus, F.col("worst")).alias("artifact"), bogus.alias("bogus"), (F.col("dipole_ratio") > 0.35).alias("dipole"),
    ))


def search(pixels: DataFrame, frame: str = "epoch", radius: float = 3.0, **how) -> DataFrame:
    """(candidate_id, x, y, n_epochs, multi_epoch, best_epoch, best_real_bogus, significance, artifact, bogus, verdict), best first by ``rank``.

    Candidates of all epochs that lie within ``radius`` are one, seen first where its position stands.
    """
    every = epoch_candidates(pixels, frame, **how)
    first = every.select(F.col("det_id").alias("candidate_id"), "x", "y", "artifact", "bogus")
    merged = merge_epochs(every.select("det_id", "epoch", "x", "y", "real_bogus", "significance"), radius).join(first, "candidate_id")
    score = 0.35 * F.col("best_real_bogus") + 0.25 * R.step(F.col("significance"), 7, 2) + 0.2 * F.col("multi_epoch").cast("double")
    merged = merged.withColumn("verdict", F.when(F.col("bogus"), "not_interesting").otherwise(R.verdict(score)))
    from .match import number_rows

    order = merged.withColumns({"a_": -F.col("n_epochs"), "b_": -F.round("best_real_bogus", 9), "c_": -F.round("significance", 9)})
    return number_rows(order, "a_", "b_", "c_", "candidate_id").withColumnRenamed("number", "rank").drop("a_", "b_", "c_")
