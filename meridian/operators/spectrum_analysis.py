"""Supernova types by template matching, and the whole analysis of a spectrum: redshift first, then what the redshift allows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import fit_lines
from .redshift import LEAST_PIXELS, MOST_TEMPLATES, _arrays, antisymmetric_r, correlate, dispersions, flatten, log_grid, prepare, redshifts
from .rounds import cut
from .spectra import balmer_reddening, continuum, diagnostic_class, line_ratio

#: R of a claimed type and its lead over other types; velocity step; shift allowed at a known redshift, and the searched range.
LEAST_QUALITY, LEAST_MARGIN, STEP, SLACK, SEARCHED = 5.0, 2.0, 100.0, 0.02, (-0.02, 0.35)


def supernova_scores(w: np.ndarray, v: np.ndarray, z: float | None, library: list[tuple]) -> list[tuple]:
    """(type, phase, quality, shift) for each (type, phase, wavelengths, values) with a correlation peak in range."""
    at = z or 0.0
    grid = log_grid(w[0] / (1 + max(at, 0.0) + 0.1), w[-1], STEP)
    n, step, out = len(grid), math.log(grid[1] / grid[0]), []
    shift = np.expm1(np.arange(1 - n, n) * step)
    inside = np.flatnonzero((shift > SEARCHED[0]) & (shift < SEARCHED[1]) if z is None else np.abs(shift) < SLACK)
    found = correlate(prepare(w, v, grid), np.stack([prepare(tw * (1 + at), tv, grid) for _, _, tw, tv in library]))
    for (kind, phase, _, _), c in zip(library, found, strict=True):
        peak = int(inside[np.argmax(c[inside])])
        quality = antisymmetric_r(c, peak)
        if math.isfinite(quality):
            out.append((kind, phase, quality, float(shift[peak])))
    return out


def classify_supernovae(spectra: DataFrame, hosts: DataFrame, templates: DataFrame) -> DataFrame:
    """One row a spectrum: sn_type, phase, redshift, quality, margin, runner_up, confident, reason.

    ``hosts`` is (spec_id, z); a spectrum without a host's redshift is searched in redshift too. ``templates`` is
    (type, phase, pix, wavelength, flux, error), at most MOST_TEMPLATES. A type is claimed if its best R reaches 5 and leads every other type by 2.
    """
    flat = _arrays(flatten(templates.withColumn("name_", F.struct("type", "phase")), "name_", 150), "name_").limit(MOST_TEMPLATES + 1).collect()
    if len(flat) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    library = sorted(((str(r.name_.type), float(r.name_.phase), np.array(r.w), np.array(r.v)) for r in flat), key=lambda t: t[:2])

    def run(parts):
        for part in parts:
            rows = []
            for s, z, w, v in zip(part["spec_id"], part["z"], part["w"], part["v"], strict=True):
                rows += [(s, *x) for x in supernova_scores(np.array(w), np.array(v), None if pd.isna(z) else float(z), library)] if library else []
            yield pd.DataFrame(rows, columns=["spec_id", "type", "phase", "quality", "shift"])

    arrays = _arrays(flatten(spectra, half=150), "spec_id").join(hosts.select("spec_id", "z"), "spec_id", "left")
    scores = cut(arrays.filter(F.size("w") >= LEAST_PIXELS).select("spec_id", "z", "w", "v").mapInPandas(run, "spec_id long, type string, phase double, quality double, shift double"))
    per_type = scores.groupBy("spec_id", "type").agg(F.max(F.struct("quality", "phase", "shift")).alias("best"))
    order = Window.partitionBy("spec_id").orderBy(F.desc("best.quality"), "type")
    ranked = per_type.withColumns({"r": F.row_number().over(order), "next_type": F.lead("type").over(order), "next_quality": F.lead("best.quality").over(order)}).filter("r = 1")
    every = spectra.select("spec_id").distinct().join(hosts.select("spec_id", "z"), "spec_id", "left")
    rows = every.join(ranked, "spec_id", "left").join(arrays.select("spec_id", F.size("w").alias("n")), "spec_id", "left")
    quality, margin = F.col("best.quality"), F.coalesce(F.col("best.quality") - F.col("next_quality"), F.lit(float("inf")))
    reason = (
        F.when(F.coalesce(F.col("n"), F.lit(0)) < LEAST_PIXELS, "too few usable pixels").when(F.col("type").isNull(), "no usable correlation").when(quality < LEAST_QUALITY, "no match above noise")
        .when(margin < LEAST_MARGIN, "types not separated").otherwise("matched")
    )
    rows = rows.withColumn("reason", reason).withColumn("confident", F.col("reason") == "matched")
    return rows.select(
        "spec_id", F.when(F.col("confident"), F.col("type")).alias("sn_type"), F.col("best.phase").alias("phase"), F.coalesce(F.col("z"), F.col("best.shift")).alias("redshift"), quality.alias("quality"),
        F.when(F.col("type").isNotNull(), margin).alias("margin"), F.col("next_type").alias("runner_up"), "confident", "reason",
    )


def analyse(spectra: DataFrame, templates: DataFrame, known: DataFrame | None = None, early: str = "early_type", resolution: float = 5.0, z_range: tuple[float, float] = (-0.005, 1.2)) -> DataFrame:
    """One row a spectrum: z, z_used, is_star, reliable, flags, stopped_at, n_detected, log_o3_hb, log_n2_ha, region, confident, ebv, sigma.

    Lines, diagnostics, reddening and dispersion are measured only where the spectrum is no star and its redshift is reliable or given
    in ``known`` (spec_id, z): a line fitted at a wrong redshift still returns a flux. ``early`` names the template whose lines are broadened.
    """
    found = cut(redshifts(spectra, templates, z_range))
    given = known.select("spec_id", F.col("z").alias("given")) if known is not None else found.select("spec_id", F.lit(None).cast("double").alias("given")).limit(0)
    rows = found.join(given, "spec_id", "left")
    stopped = F.when(F.col("is_star"), "identified as a star").when(F.col("given").isNull() & ~F.col("reliable"), "redshift not reliable")
    rows = cut(rows.withColumn("stopped_at", stopped).withColumn("z_used", F.when(F.col("stopped_at").isNull(), F.coalesce("given", "z"))))
    at = rows.filter("z_used IS NOT NULL").select("spec_id", F.col("z_used").alias("z"))
    lines = cut(fit_lines(continuum(spectra, 75, 4), at, resolution=resolution))
    one = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    wide = lines.groupBy("spec_id").agg(F.count(F.when(F.col("detected"), 1)).alias("n_detected"), *[one(n, c).alias(f"{a}_{c}") for a, n in (("hb", "H beta"), ("o3", "[O III] 5007"), ("ha", "H alpha"), ("n2", "[N II] 6584")) for c in ("flux", "flux_error")])
    pair = lambda a: (F.col(f"{a}_flux"), F.col(f"{a}_flux_error"))
    wide = wide.withColumns({"oxygen": line_ratio(pair("o3"), pair("hb")), "nitrogen": line_ratio(pair("n2"), pair("ha")), "balmer": line_ratio(pair("ha"), pair("hb"))})
    wide = diagnostic_class(wide, "oxygen", "nitrogen").withColumn("ebv", balmer_reddening(F.when(F.col("balmer.status") == "measured", F.col("balmer.value"))))
    wide = wide.select("spec_id", "n_detected", "log_o3_hb", "log_n2_ha", "region", "confident", "ebv")
    rows = rows.select("spec_id", "z", "z_used", "is_star", "reliable", "flags", "stopped_at").join(wide, "spec_id", "left")
    rest = templates.filter(F.col("template") == early).drop("template", "kind")
    if rest.isEmpty():
        return rows.withColumn("sigma", F.lit(None).cast("double"))
    return rows.join(dispersions(spectra, at, rest, resolution).select("spec_id", "sigma"), "spec_id", "left")
