"""Rule-based scores and classes as Column expressions: weighted soft votes, vetoes and margins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, logistic, softmax

#: Relative weights of the real/bogus terms, and the name of each term's failure.
REAL_BOGUS_WEIGHTS = {"significance": 1.4, "psf_match": 1.6, "not_dipole": 1.5, "not_negative": 1.0, "not_cosmic_ray": 1.2, "not_streak": 0.8, "centred": 1.0}
ARTIFACTS = {
    "significance": "low_significance", "psf_match": "not_point_like", "not_dipole": "subtraction_dipole", "not_negative": "oversubtraction",
    "not_cosmic_ray": "cosmic_ray", "not_streak": "streak_or_satellite", "centred": "off_centre_residual",
}
#: Priority of each kind of candidate, and what a match with a known object leaves of it.
PRIORITY = {"transient": 1.00, "lens": 0.85, "anomaly": 0.70, "variable": 0.55}
KNOWN_FACTOR = {"anomaly": 0.25, "lens": 0.60, "variable": 0.70, "transient": 0.95}


def weighted(votes: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the votes that are not null; null without any."""
    total = reduce(lambda a, v: a + F.coalesce(v[0] * v[1], F.lit(0.0)), votes, F.lit(0.0))
    weight = reduce(lambda a, v: a + F.when(v[0].isNotNull(), v[1]).otherwise(0.0), votes, F.lit(0.0))
    return F.when(weight > 0, total / weight)


def step(x: Column, threshold: float, width: float, above: bool = True) -> Column:
    return logistic(x if above else -x, width, threshold if above else -threshold)


def best_of(scores: dict[str, Column], full: float, base: float) -> tuple[Column, Column]:
    """Name of the largest share and its confidence, scaled down when the runner-up is within ``full``."""
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(p.alias("p"), F.lit(n).alias("name")) for n, p in scores.items()])))
    top, margin = ranked[0]["p"], ranked[0]["p"] - ranked[1]["p"]
    return ranked[0]["name"], clip(top * (base + (1 - base) * F.least(margin / full, F.lit(1.0))), 0, 0.99)


def stellarity(fwhm: Column, r50: Column, snr: Column, psf_fwhm: float) -> Column:
    """Chance that a source is unresolved, from its sizes over the PSF's; faint ones are drawn to one half."""
    value = F.coalesce(weighted([(F.when(r50 > 0, step(r50 / (0.5 * psf_fwhm), 1.55, 0.18, False)), 1.6), (F.when(fwhm > 0, step(fwhm / psf_fwhm, 1.40, 0.13, False)), 1.2)]), F.lit(0.5))
    faint = F.when(snr < 10, clip(snr / 10, 0.15, 1.0)).otherwise(1.0)
    return clip(0.5 + faint * (value - 0.5), 0, 1)


def combine(shape: Column, colour: Column, weight: float = 0.8, most: float = 1.2) -> Column:
    """Shape and colour chances fused in log-odds; colour moves them by at most ``most``."""
    def logit(p):
        q = clip(p, 1e-4, 1 - 1e-4)
        return F.log(q / (1 - q))

    return F.when(colour.isNull(), shape).otherwise(1 / (1 + F.exp(-(logit(shape) + clip(weight * logit(colour), -most, most)))))


def source_class(rows: DataFrame, psf_fwhm: float) -> DataFrame:
    """Adds stellarity, predicted class and confidence from evidence for star, galaxy and artefact."""
    rows = rows.withColumn("stellarity", stellarity(F.col("fwhm"), F.col("r50"), F.col("flux") / F.col("flux_err"), psf_fwhm))
    point = F.col("stellarity")
    long = 1 / F.greatest(1 - F.col("ellipticity"), F.lit(0.01))
    odd = F.when(long > 5, clip((long - 5) / 5, 0, 1)).otherwise(0.0) + F.when(F.col("area_pixels") <= 3, 0.5).otherwise(0.0)
    names = ["star", "galaxy", "artifact"]
    rows = rows.withColumn("share", softmax(F.array(3 * point, 3 * (1 - point), 2.5 * F.least(odd, F.lit(1.0)))))
    name, confidence = best_of({n: F.col("share")[i] for i, n in enumerate(names)}, 0.3, 0.4)
    return rows.withColumns({"predicted": name, "confidence": confidence}).drop("share")


def morphology_class(rows: DataFrame) -> DataFrame:
    """Adds morphology and confidence: bulge or disc, then flattened or round, ordered or disturbed, and mergers."""
    c, g, m, a, e = (F.col(n) for n in ("concentration", "gini", "m20", "asymmetry", "ellipticity"))
    rows = rows.withColumns({
        "early": weighted([(step(c, 3.05, 0.28), 1.6), (step(g - (0.14 * m + 0.80), 0.0, 0.035), 1.1)]),
        "flat": step(e, 0.32, 0.09),
        "disturbed": weighted([(step(c, 2.44, 0.13, False), 1.3), (step(g, 0.462, 0.020, False), 1.2), (step(m, -1.59, 0.06), 1.0), (step(a, 0.20, 0.06), 1.0), (step(e, 0.26, 0.09, False), 0.9)]),
        "merging": F.greatest(step(a, 0.35, 0.06), step(g - (-0.14 * m + 0.33), 0.0, 0.04) * step(m, -1.30, 0.10)),
    })
    early, late, ordered = F.col("early"), 1 - F.col("early"), clip(0.62 - 1.15 * F.col("disturbed"), 0.05, 1.0)
    evidence = {"elliptical": early * (1 - F.col("flat")), "lenticular": early * F.col("flat"), "spiral": late * ordered, "irregular": late * (1 - ordered), "merger": 1.15 * F.col("merging")}
    total = reduce(lambda s, x: s + x, evidence.values(), F.lit(0.0))
    rows = rows.withColumns({f"p_{n}": x / total for n, x in evidence.items()})
    name, confidence = best_of({n: F.col(f"p_{n}") for n in evidence}, 0.25, 0.35)
    small = F.col("area_pixels").between(1, 11)
    out = rows.withColumns({"morphology": F.when(small, "unresolved").otherwise(name), "morphology_confidence": F.when(small, 0.2).otherwise(confidence)})
    return out.drop("early", "flat", "disturbed", "merging", *[f"p_{n}" for n in evidence])


def real_bogus_terms(psf_fwhm: float = 3.0, dipole: float = 0.35) -> dict[str, Column]:
    """Soft tests of a residual stamp's features, each in [0, 1]."""
    expected = 1 / max(math.pi * (max(psf_fwhm, 1.0) / 2) ** 2, 1.0)
    return {
        "significance": step(F.col("peak_significance"), 5.0, 1.2),
        "psf_match": clip((F.col("psf_correlation") - 0.25) / 0.5, 0, 1),
        "not_dipole": step(F.col("dipole_ratio"), dipole, 0.12, False),
        "not_negative": 1 - clip(F.col("negative_fraction") / 0.25, 0, 1),
        "not_cosmic_ray": clip(1 - (F.col("sharpness") / expected - 1.6) / 2, 0, 1),
        "not_streak": clip(1 - (F.col("elongation") - 1.6) / 2, 0, 1),
        "centred": clip(1 - F.col("centroid_offset") / max(psf_fwhm, 1.0), 0, 1),
    }


def real_bogus(rows: DataFrame) -> DataFrame:
    """Adds real_bogus, a weighted geometric mean so that one failed test is a veto, and the worst test's artefact."""
    terms = real_bogus_terms()
    logs = weighted([(F.log(F.greatest(t, F.lit(1e-4))), REAL_BOGUS_WEIGHTS[n]) for n, t in terms.items()])
    worst = F.array_sort(F.array_compact(F.array(*[F.when(t.isNotNull(), F.struct(t.alias("t"), F.lit(ARTIFACTS[n]).alias("n"))) for n, t in terms.items()])))
    return rows.withColumns({"real_bogus": F.coalesce(clip(F.exp(logs), 0, 1), F.lit(0.0)), "worst": worst[0]["n"]})


def stamp_features(pixels: DataFrame, key: str, noise: float, psf_fwhm: float = 3.0) -> DataFrame:
    """Shape features of residual stamps, one aggregation per stamp.

    ``psf_correlation`` is that of the values with a Gaussian of ``psf_fwhm`` about the stamp's middle; null where either is flat.
    """
    v, w = F.col("value"), F.greatest("value", F.lit(0.0))
    whole = Window.partitionBy(key)
    middle = [(F.min(c).over(whole) + F.max(c).over(whole)) / 2.0 for c in ("x", "y")]
    away = (F.col("x") - middle[0]) * (F.col("x") - middle[0]) + (F.col("y") - middle[1]) * (F.col("y") - middle[1])
    pixels = pixels.withColumn("psf_", F.exp(-0.5 * away / (psf_fwhm / 2.3548) ** 2))
    s = pixels.groupBy(key).agg(
        (F.covar_pop(v, F.col("psf_")) / F.nullif(F.stddev_pop(v) * F.stddev_pop("psf_"), F.lit(0.0))).alias("psf_correlation"),
        F.max(v).alias("top"), F.min(v).alias("low"), F.avg((v < -2 * noise).cast("double")).alias("negative_fraction"), F.sum(w).alias("total"),
        F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("x") * F.col("x")).alias("wxx"), F.sum(w * F.col("y") * F.col("y")).alias("wyy"),
        F.sum(w * F.col("x") * F.col("y")).alias("wxy"), ((F.min("x") + F.max("x")) / 2.0).alias("mx"), ((F.min("y") + F.max("y")) / 2.0).alias("my"),
    )
    t = F.nullif("total", F.lit(0.0))
    s = s.withColumns({"cx": F.col("wx") / t, "cy": F.col("wy") / t})
    s = s.withColumns({"a": F.col("wxx") / t - F.col("cx") ** 2, "b": F.col("wyy") / t - F.col("cy") ** 2, "c": F.col("wxy") / t - F.col("cx") * F.col("cy")})
    root, half = F.sqrt(((F.col("a") - F.col("b")) / 2) ** 2 + F.col("c") ** 2), (F.col("a") + F.col("b")) / 2
    longer = F.sqrt(F.greatest(half + root, F.lit(1e-9))) / F.sqrt(F.greatest(half - root, F.lit(1e-9)))
    return s.select(
        key, (F.col("top") / noise).alias("peak_significance"), "psf_correlation",
        F.when(F.col("top") > 0, F.abs("low") / F.col("top")).otherwise(1.0).alias("dipole_ratio"), "negative_fraction",
        F.coalesce(F.col("top") / t, F.lit(1.0)).alias("sharpness"), F.coalesce(longer, F.lit(1.0)).alias("elongation"), F.hypot(F.col("cx") - F.col("mx"), F.col("cy") - F.col("my")).alias("centroid_offset"),
    )


def verdict(score: Column) -> Column:
    return F.when(score >= 0.75, "high_priority").when(score >= 0.55, "follow_up_recommended").when(score >= 0.35, "worth_a_look").otherwise("not_interesting")


def deflector(kind: Column, concentration: Column, area: Column, snr: Column) -> Column:
    """How plausible a source is as a lensing galaxy; stars are not."""
    terms = [(F.lit(0.5), 1.0), (step(concentration, 3.2, 0.4), 1.0), (clip(area / 60, 0, 1), 1.0), (step(snr, 20, 8), 1.0)]
    return F.when(kind == "star", 0.0).otherwise(weighted(terms))


def novelty_type() -> Column:
    return (
        F.when(F.col("m20") > -1.1, "multiple_nuclei").when(F.col("asymmetry") > 0.35, "highly_asymmetric")
        .when(F.col("ellipticity") > 0.8, "extremely_elongated").when(F.col("class") == "unknown", "unclassified").otherwise("statistical_outlier")
    )


def rank_follow_up(items: DataFrame, limit: int = 20) -> DataFrame:
    """items (kind, id, x, y, score, known, interesting) of every search as one ranked list.

    Scores are weighted by kind and cut for known objects; at one position (0.1 pixel) the strongest case leads and each other adds 0.15 of its score.
    """
    weight = F.create_map(*[F.lit(v) for k in PRIORITY.items() for v in k])[F.col("kind")]
    factor = F.when(F.col("known"), F.create_map(*[F.lit(v) for k in KNOWN_FACTOR.items() for v in k])[F.col("kind")]).otherwise(1.0)
    rows = items.withColumn("score", weight * factor * F.col("score"))
    place = Window.partitionBy(F.round("x", 1), F.round("y", 1)).orderBy(F.round("score", 9).desc(), "kind", "id")
    rows = rows.withColumns({"turn": F.row_number().over(place), "all": F.sum("score").over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    total = F.least(F.lit(1.0), F.col("score") + 0.15 * (F.col("all") - F.col("score")))
    rows = rows.filter("turn = 1 AND interesting").select("kind", "id", total.alias("score"))
    return rows.orderBy(F.round("score", 9).desc(), "kind", "id").limit(limit)
