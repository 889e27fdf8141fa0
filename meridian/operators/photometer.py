"""Catalog photometry: fixed and adaptive apertures, light radii, aperture correction, magnitudes and flags of every source."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import magnitude, magnitude_error, surface_brightness
from .frames import by_cells, ring_sky
from .pixels import covered

#: Aperture radii, the primary one, the sky ring, the factor of the first moment, steps of a growth curve, least signal to noise.
RADII, PRIMARY, RING, FACTOR, STEPS, LEAST_SNR = (2.0, 3.0, 5.0, 8.0, 12.0), 5.0, (8.0, 14.0), 2.5, 28, 3.0


def enclosed_share(rows: DataFrame, curve: DataFrame, frame: str, radius: str) -> DataFrame:
    """Adds ``share``, the frame's growth curve (frame, radius, enclosed) at a column of radii, linear between its radii and flat beyond; null without a curve."""
    points = curve.groupBy(frame).agg(F.collect_list(F.struct(F.col("radius").alias("r_"), F.col("enclosed").alias("e_"))).alias("points_"))
    rows = rows.join(points, frame, "left")
    lo, hi = F.array_max(F.filter("points_", lambda p: p["r_"] <= F.col(radius))), F.array_min(F.filter("points_", lambda p: p["r_"] >= F.col(radius)))
    rows = rows.withColumns({"lo_": lo, "hi_": hi})
    step = F.col("hi_.r_") - F.col("lo_.r_")
    share = F.when(F.col("lo_").isNull(), F.col("hi_.e_")).when(F.col("hi_").isNull() | (step == 0), F.col("lo_.e_")).otherwise(F.col("lo_.e_") + (F.col(radius) - F.col("lo_.r_")) / F.nullif(step, F.lit(0.0)) * (F.col("hi_.e_") - F.col("lo_.e_")))
    return rows.withColumn("share", share).drop("points_", "lo_", "hi_")


def measure(sources: DataFrame, pixels: DataFrame, frame: str, curve: DataFrame | None = None, radii: tuple[float, ...] = RADII, primary: float = PRIMARY, ring: tuple[float, float] = RING, gain: float = 1.0, zero_point: float = 25.0) -> DataFrame:
    """One row for each source (source_id, frame, sx, sy, semi_major, area_pixels) of its own frame.

    Fluxes in circles of ``radii`` and in one of 2.5 first moments of the source's light (0.6 of the primary radius at least, at most the
    ring's outer edge), less the sky of a ring; radii of half and 0.9 of the light out to three primary radii or six semi-axes, and 5 log10(r80 / r20). ``curve``, the field's
    growth curve, corrects the adaptive flux for the light beyond its circle. Where that flux is not positive the primary
    aperture stands in (aperture_fallback). Pieces of a pixel count apart; neighbours are not masked.
    """
    reach = max(*radii, ring[1], 3 * primary) + 1
    key, fixed, low = [frame, "source_id"], sorted({*radii, primary}), max(2.0, 0.6 * primary)

    def stage(sx, sy, x, y, value, rms, semi_major):
        level, sky_rms, n_sky = ring_sky(sx, sy, x, y, value, *ring)
        dx, dy = x - sx[:, None], y - sy[:, None]
        r, light, noise = np.hypot(dx, dy), value - level[:, None], np.nan_to_num(rms * rms)
        none = ~((np.abs(dx) <= reach) & (np.abs(dy) <= reach)).any(axis=1)
        sums = []
        for radius in fixed:
            w = covered(x, y, sx, sy, radius)
            sums += [(w * light).sum(axis=1), w @ noise, w.sum(axis=1)]
        most = np.minimum(np.maximum(3 * primary, 6 * np.fmax(semi_major, 1.0)), reach - 1)
        within = r <= most[:, None]
        inner = within & (r <= ring[1])
        positive = np.where(inner, np.maximum(light, 0.0), 0.0)
        total = positive.sum(axis=1)
        kron = np.where(total > 0, (positive * r).sum(axis=1) / np.where(total > 0, total, 1.0), np.nan)
        aperture = np.where(np.isnan(kron), primary, np.minimum(np.maximum(FACTOR * kron, low), ring[1]))
        aperture[~inner.any(axis=1)] = np.nan
        w = covered(x, y, sx, sy, aperture[:, None])
        sums += [np.where(np.isnan(aperture), np.nan, v) for v in ((w * light).sum(axis=1), w @ noise, w.sum(axis=1))]

        # growth curves on steps of each source's own reach, of pixels in 4 x 4 pieces
        row, at = np.nonzero(within)
        step, rings = (most - 1) / (STEPS - 1), np.zeros(len(sx) * STEPS)
        for i in range(16):
            far = np.hypot(x[at] + ((i // 4 + 0.5) / 4 - 0.5) - sx[row], y[at] + ((i % 4 + 0.5) / 4 - 0.5) - sy[row])
            k = np.maximum(np.ceil((far - 1) / step[row] - 1e-9), 0).astype(int)
            in_ = k < STEPS
            rings += np.bincount(row[in_] * STEPS + k[in_], weights=light[row, at][in_] / 16, minlength=len(rings))
        enclosed = np.cumsum(rings.reshape(-1, STEPS), axis=1)
        shares = []
        for share in (0.2, 0.5, 0.8, 0.9):
            target = share * enclosed[:, -1]
            k = (enclosed >= target[:, None]).argmax(axis=1)
            e1, e0 = (np.take_along_axis(enclosed, np.maximum(k - d, 0)[:, None], 1)[:, 0] for d in (0, 1))
            rise, flat = e1 - e0, (k == 0) | (np.abs(e1 - e0) < 1e-12)
            found = np.where(flat, 1 + k * step, 1 + (k - 1) * step + (target - e0) / np.where(flat, 1.0, rise) * step)
            shares.append(np.where((enclosed[:, -1] > 0) & within.any(axis=1), found, np.nan))
        return level, sky_rms, n_sky, *[np.where(none, np.nan, v) for v in (*sums, kron, aperture, *shares)]

    named = [f"{part}_{name}" for name in [*(f"{r:g}".replace(".", "_") for r in fixed), "auto"] for part in "fva"]
    schema = ", ".join(f"{c} double" for c in (*named, "kron_radius", "aperture_radius", "r20", "r50", "r80", "r90"))
    got = by_cells(sources, pixels, frame, reach, stage, f"level double, sky_rms double, n_sky long, {schema}", extra=("semi_major",))
    got = got.withColumn("concentration", F.when(F.col("r20") > 0, 5 * F.log10(F.col("r80") / F.col("r20"))))
    out = sources.join(got, key)
    out = enclosed_share(out, curve, frame, "aperture_radius") if curve is not None else out.withColumn("share", F.lit(None).cast("double"))
    correction = F.when(F.col("share").between(0.3, 1.0), 1 / F.col("share")).otherwise(1.0)

    def error(name: str):
        spread = F.when(F.col("n_sky") > 0, F.col(f"a_{name}") ** 2 * F.col("sky_rms") ** 2 / F.col("n_sky")).otherwise(0.0)
        return F.sqrt(F.col(f"v_{name}") + F.greatest(F.col(f"f_{name}"), F.lit(0.0)) / gain + spread)

    main = f"{primary:g}".replace(".", "_")
    fallback = ~F.coalesce(F.col("f_auto") > 0, F.lit(False))
    out = out.withColumns({"fallback": fallback, "aperture_correction": correction, "raw": F.when(fallback, F.col(f"f_{main}")).otherwise(F.col("f_auto")), "raw_err": F.when(fallback, error(main)).otherwise(error("auto"))})
    out = out.withColumns({"flux": F.col("raw") * F.col("aperture_correction"), "flux_err": F.col("raw_err") * F.col("aperture_correction"), "snr": F.col("raw") / F.nullif("raw_err", F.lit(0.0))})
    mag = magnitude(F.col("flux"), zero_point)
    flags = [("aperture_fallback", F.col("fallback")), ("negative_flux", ~F.coalesce(F.col("flux") > 0, F.lit(False))), ("low_snr", F.coalesce(F.col("snr") < LEAST_SNR, F.lit(False)))]
    apertures = [F.col(f"f_{r:g}".replace(".", "_")).alias(f"flux_{r:g}".replace(".", "_")) for r in radii]
    return out.select(
        "source_id", frame, *apertures, F.col("level").alias("background"), "kron_radius", "aperture_radius", "aperture_correction", "flux", "flux_err", "snr", mag.alias("magnitude"), magnitude_error(F.col("flux"), F.col("flux_err")).alias("magnitude_err"),
        surface_brightness(F.col("flux"), F.greatest("area_pixels", F.lit(1)), 1.0, zero_point).alias("surface_brightness"), "r50", "r90", "concentration", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in flags])).alias("flags"),
    )
