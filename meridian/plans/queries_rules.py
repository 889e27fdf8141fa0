"""Queries of rule-based scores, classes and follow-up ranking."""

from pyspark.sql import functions as F

from ..operators import rules as R
from .registry import query


def _logit(x, threshold, width, above=True):
    return f"(1 / (1 + exp({'-' if above else ''}(({x}) - ({threshold})) / {width})))"


STELLAR = f"(({_logit('r50 / 1.5', 1.55, 0.18, False)} * 1.6 + {_logit('fwhm / 3', 1.40, 0.13, False)} * 1.2) / 2.8)"
SHARP = f"CASE WHEN flux / flux_err < 10 THEN 0.5 + least(greatest(flux / flux_err / 10, 0.15), 1) * ({STELLAR} - 0.5) ELSE {STELLAR} END"


@query("sca19_stellarity", "sources", f"SELECT source_id, {SHARP} AS stellarity FROM sources", "stellarity")
def _(v):
    return v.sources.select("source_id", R.stellarity(F.col("fwhm"), F.col("r50"), F.col("flux") / F.col("flux_err"), 3.0).alias("stellarity"))


@query("sca20_source_class")
def _(v):
    return R.source_class(v.sources, 3.0).select("source_id", "stellarity", "predicted", "confidence")


@query("sca22_morphology_class")
def _(v):
    return R.morphology_class(v.sources).select("source_id", "morphology", "morphology_confidence")


@query("agg34_stamp_features", "pixels", """WITH s AS (SELECT epoch, max(value) AS top, min(value) AS low, avg(CASE WHEN value < -10 THEN 1.0 ELSE 0 END) AS negative_fraction, sum(greatest(value, 0)) AS t, sum(greatest(value, 0) * x) AS wx, sum(greatest(value, 0) * y) AS wy, (min(x) + max(x)) / 2.0 AS mx, (min(y) + max(y)) / 2.0 AS my FROM pixels GROUP BY epoch)
SELECT epoch, top / 5 AS peak_significance, abs(low) / top AS dipole_ratio, negative_fraction, top / t AS sharpness, sqrt(pow(wx / t - mx, 2) + pow(wy / t - my, 2)) AS centroid_offset FROM s""", "peak_significance dipole_ratio negative_fraction sharpness centroid_offset")  # fmt: skip
def _(v):
    return R.stamp_features(v.pixels, "epoch", 5.0).select("epoch", "peak_significance", "dipole_ratio", "negative_fraction", "sharpness", "centroid_offset")


@query("sca24_real_bogus")
def _(v):
    return R.real_bogus(R.stamp_features(v.pixels, "epoch", 5.0)).select("epoch", "real_bogus", "worst")


@query("sca25_verdicts", "epoch_detections", f"WITH s AS (SELECT det_id, 0.35 * real_bogus + 0.25 * {_logit('significance', 7, 2)} AS score FROM epoch_detections) SELECT det_id, score, CASE WHEN score >= 0.75 THEN 'high_priority' WHEN score >= 0.55 THEN 'follow_up_recommended' WHEN score >= 0.35 THEN 'worth_a_look' ELSE 'not_interesting' END AS verdict FROM s", "score")
def _(v):
    score = 0.35 * F.col("real_bogus") + 0.25 * R.step(F.col("significance"), 7, 2)
    return v.epoch_detections.select("det_id", score.alias("score"), R.verdict(score).alias("verdict"))


@query("sca26_deflectors", "sources", f"SELECT source_id, CASE WHEN class = 'star' THEN 0 ELSE (0.5 + {_logit('concentration', 3.2, 0.4)} + least(area_pixels / 60.0, 1) + {_logit('flux / flux_err', 20, 8)}) / 4 END AS plausibility FROM sources", "plausibility")
def _(v):
    return v.sources.select("source_id", R.deflector(F.col("class"), F.col("concentration"), F.col("area_pixels"), F.col("flux") / F.col("flux_err")).alias("plausibility"))


@query("sca27_novelty_type", "sources", "SELECT source_id, CASE WHEN m20 > -1.1 THEN 'multiple_nuclei' WHEN asymmetry > 0.35 THEN 'highly_asymmetric' WHEN ellipticity > 0.8 THEN 'extremely_elongated' WHEN class = 'unknown' THEN 'unclassified' ELSE 'statistical_outlier' END AS kind FROM sources")
def _(v):
    return v.sources.select("source_id", R.novelty_type().alias("kind"))


@query("top02_follow_up", "sources", """WITH i AS (SELECT CASE source_id % 4 WHEN 0 THEN 'transient' WHEN 1 THEN 'lens' WHEN 2 THEN 'anomaly' ELSE 'variable' END AS kind, source_id AS id, round(x / 200) AS x, round(y / 200) AS y, redshift AS score, class = 'star' AS known, flux > 50 AS interesting FROM sources),
w AS (SELECT *, score * CASE kind WHEN 'transient' THEN 1.0 WHEN 'lens' THEN 0.85 WHEN 'anomaly' THEN 0.7 ELSE 0.55 END * CASE WHEN NOT known THEN 1 ELSE CASE kind WHEN 'transient' THEN 0.95 WHEN 'lens' THEN 0.6 WHEN 'anomaly' THEN 0.25 ELSE 0.7 END END AS s FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY round(s, 9) DESC, kind, id) AS turn, sum(s) OVER (PARTITION BY x, y) AS total FROM w)
SELECT kind, id, least(1, s + 0.15 * (total - s)) AS score FROM r WHERE turn = 1 AND interesting ORDER BY round(least(1, s + 0.15 * (total - s)), 9) DESC, kind, id LIMIT 20""", "score")  # fmt: skip
def _(v):
    kind = F.element_at(F.array(*map(F.lit, ["transient", "lens", "anomaly", "variable"])), (F.col("source_id") % 4 + 1).cast("int"))
    rows = v.sources.select(kind.alias("kind"), F.col("source_id").alias("id"), F.round(F.col("x") / 200).alias("x"), F.round(F.col("y") / 200).alias("y"), F.col("redshift").alias("score"), (F.col("class") == "star").alias("known"), (F.col("flux") > 50).alias("interesting"))
    return R.rank_follow_up(rows)


@query("agg25_kron_radius", "pixels", "SELECT epoch, sum(sqrt(pow(x - 9.5, 2) + pow(y - 9.5, 2)) * greatest(value, 0)) / sum(greatest(value, 0)) AS kron FROM pixels WHERE sqrt(pow(x - 9.5, 2) + pow(y - 9.5, 2)) <= 9 GROUP BY epoch", "kron")
def _(v):
    r, w = F.hypot(F.col("x") - 9.5, F.col("y") - 9.5), F.greatest("value", F.lit(0.0))
    return v.pixels.filter(r <= 9).groupBy("epoch").agg((F.sum(r * w) / F.sum(w)).alias("kron"))


@query("agg24_curve_of_growth", "pixels", "SELECT epoch, r AS radius, sum(value) AS enclosed FROM pixels, (SELECT unnest([2, 4, 6, 8]) AS r) WHERE sqrt(pow(x - 9.5, 2) + pow(y - 9.5, 2)) <= r GROUP BY epoch, r", "enclosed")
def _(v):
    radii = F.explode(F.array(*map(F.lit, [2, 4, 6, 8]))).alias("radius")
    rows = v.pixels.select("epoch", "value", F.hypot(F.col("x") - 9.5, F.col("y") - 9.5).alias("d"), radii)
    return rows.filter("d <= radius").groupBy("epoch", "radius").agg(F.sum("value").alias("enclosed"))


@query("agg34_psf_correlation", "pixels", """WITH m AS (SELECT *, (min(x) OVER w + max(x) OVER w) / 2.0 AS mx, (min(y) OVER w + max(y) OVER w) / 2.0 AS my FROM pixels WINDOW w AS (PARTITION BY epoch))
SELECT epoch, corr(value, exp(-0.5 * (pow(x - mx, 2) + pow(y - my, 2)) / pow(3.0 / 2.3548, 2))) AS psf_correlation FROM m GROUP BY epoch""", "psf_correlation")  # fmt: skip
def _(v):
    return R.stamp_features(v.pixels, "epoch", 5.0).select("epoch", "psf_correlation")
