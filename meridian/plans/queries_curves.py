"""Queries over light curves: variability, folding, periods, shapes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import lightcurve as L
from .registry import query

ORDER = ["mjd", "detection_id"]

FEATURES_SQL = """
WITH a AS (SELECT *, count(*) OVER w AS n, avg(flux) OVER w AS m, stddev_pop(flux) OVER w AS sd, median(flux) OVER w AS md, min(mjd) OVER w AS t0
           FROM detections WINDOW w AS (PARTITION BY object_truth)),
b AS (SELECT *, sqrt(n / greatest(n - 1, 1)) * (flux - m) / flux_err AS delta FROM a),
c AS (SELECT *, flux - lag(flux) OVER o AS step, delta * lag(delta) OVER o AS pair FROM b WINDOW o AS (PARTITION BY object_truth ORDER BY mjd, detection_id)),
f AS (SELECT object_truth, CAST(count(*) AS DOUBLE) AS n_epochs, max(mjd) - min(mjd) AS baseline, avg(flux) AS mean_flux, median(flux) AS median_flux, stddev_pop(flux) AS std_flux,
  CASE WHEN count(*) >= 2 THEN 1.4826 * median(abs(flux - md)) END AS mad,
  CASE WHEN count(*) >= 2 THEN (sum(flux * flux / (flux_err * flux_err)) - pow(sum(flux / (flux_err * flux_err)), 2) / sum(1 / (flux_err * flux_err))) / (count(*) - 1) END AS reduced_chi2,
  CASE WHEN count(*) >= 4 THEN avg(sign(pair) * sqrt(abs(pair))) END AS stetson_j,
  CASE WHEN count(*) >= 3 THEN sqrt(greatest(var_samp(flux) - avg(flux_err * flux_err), 0)) / abs(avg(flux)) END AS fractional_variability,
  CASE WHEN count(*) >= 3 THEN quantile_cont(flux, 0.95) - quantile_cont(flux, 0.05) END AS amplitude,
  CASE WHEN count(*) >= 3 THEN CASE WHEN stddev_pop(flux) <= 1e-12 THEN 0 ELSE avg(pow((flux - m) / sd, 3)) END END AS skewness,
  CASE WHEN count(*) >= 4 THEN CASE WHEN stddev_pop(flux) <= 1e-12 THEN 0 ELSE avg(pow((flux - m) / sd, 4)) - 3 END END AS kurtosis,
  CASE WHEN count(*) >= 3 THEN avg(CASE WHEN abs(flux - m) > sd THEN 1.0 ELSE 0.0 END) END AS beyond_1std,
  CASE WHEN count(*) >= 3 AND var_samp(flux) > 1e-12 THEN avg(step * step) / var_samp(flux) END AS von_neumann_eta,
  CASE WHEN count(*) >= 3 THEN regr_slope(flux, mjd - t0) END AS linear_trend
  FROM c GROUP BY object_truth)
"""
SCORE_SQL = """, v AS (SELECT *, list_filter([least(reduced_chi2 / 3, CASE WHEN reduced_chi2 IS NOT NULL THEN 1 END), CASE WHEN stetson_j IS NOT NULL THEN least(greatest(stetson_j, 0) / 3, 1) END,
   CASE WHEN fractional_variability IS NOT NULL THEN least(fractional_variability / 0.05, 1) END, CASE WHEN von_neumann_eta IS NOT NULL THEN least(greatest((2 - von_neumann_eta) / 1.2, 0), 1) END], lambda x: x IS NOT NULL) AS votes FROM f),
s AS (SELECT *, CASE WHEN len(votes) > 0 THEN least(greatest(list_avg(votes), 0), 1) ELSE 0 END AS score FROM v)
"""
FEATURES = "n_epochs baseline mean_flux median_flux std_flux mad reduced_chi2 stetson_j fractional_variability amplitude skewness kurtosis beyond_1std von_neumann_eta linear_trend"


@query("win01_variability_features", "detections", FEATURES_SQL + "SELECT * FROM f", FEATURES)
def _(v):
    return L.variability(v.detections, "object_truth", ORDER)


for _name, _columns in {
    "win02_reduced_chi2": "reduced_chi2",
    "win03_stetson_j": "stetson_j",
    "win04_von_neumann": "von_neumann_eta",
    "win05_amplitude": "fractional_variability amplitude",
    "win06_moments": "skewness kurtosis beyond_1std linear_trend",
}.items():
    query(_name, "detections", FEATURES_SQL + f"SELECT object_truth, {', '.join(_columns.split())} FROM f", _columns)(lambda v, c=_columns.split(): L.variability(v.detections, "object_truth", ORDER).select("object_truth", *c))


@query("win07_variability_class", "detections", FEATURES_SQL + SCORE_SQL + """SELECT object_truth, score, CASE WHEN score < 0.3 THEN 'non_variable' WHEN coalesce(skewness > 1 AND von_neumann_eta < 1, false) THEN 'eruptive'
   WHEN coalesce(abs(mean_flux) > 1e-9 AND abs(linear_trend) * greatest(baseline, 1e-9) > 0.25 * abs(mean_flux), false) THEN 'secular_trend' ELSE 'stochastic' END AS class FROM s""", "score")  # fmt: skip
def _(v):
    rows = L.variability(v.detections, "object_truth", ORDER).withColumn("score", L.variability_score())
    return rows.select("object_truth", "score", L.variable_class(F.col("score")).alias("class"))


@query("model30_most_variable", "detections", FEATURES_SQL + SCORE_SQL + "SELECT object_truth, n_epochs, reduced_chi2, stetson_j, von_neumann_eta, score FROM s ORDER BY round(score, 6) DESC, object_truth LIMIT 20", "n_epochs reduced_chi2 stetson_j von_neumann_eta score")
def _(v):
    return L.most_variable(v.detections, "object_truth", ORDER, 20)


@query("win08_phase_fold", "detections", "SELECT detection_id, object_truth, fmod((mjd - min(mjd) OVER (PARTITION BY object_truth)) / 3.5, 1.0) AS phase, flux FROM detections", "phase flux")
def _(v):
    return L.phase_fold(v.detections, "object_truth", F.lit(3.5)).select("detection_id", "object_truth", "phase", "flux")


@query("win09_curve_shape", "detections", """
WITH g AS (SELECT object_truth, CAST(count(*) AS DOUBLE) AS n_epochs, min(mjd) AS t0, max(mjd) AS t1, arg_min(flux, mjd) AS f0, arg_max(flux, mjd) AS f1, max(flux) AS top, median(flux) AS base FROM detections GROUP BY object_truth),
p AS (SELECT g.*, (SELECT min(mjd) FROM detections d WHERE d.object_truth = g.object_truth AND d.flux = g.top) AS tp FROM g WHERE n_epochs >= 3 AND top > 0),
r AS (SELECT *, CASE WHEN tp > t0 THEN (top - f0) / (tp - t0) END AS rise, CASE WHEN t1 > tp THEN (top - f1) / (t1 - tp) END AS fall FROM p)
SELECT object_truth, rise AS rise_rate, fall AS decline_rate, tp AS peak_time, (top - base) / greatest(abs(top), 1e-9) AS peak_fraction, CASE WHEN abs(fall) > 1e-9 THEN rise / abs(fall) END AS asymmetry, n_epochs FROM r""",
       "rise_rate decline_rate peak_time peak_fraction asymmetry n_epochs")
def _(v):
    return L.shape(v.detections, "object_truth")


@query("prj07_normalised_curves", "detections", "SELECT detection_id, CASE WHEN abs(m) > 1e-12 THEN flux / m ELSE 0 END AS norm_flux, CASE WHEN abs(m) > 1e-12 THEN flux_err / abs(m) END AS norm_err FROM (SELECT *, median(flux) OVER (PARTITION BY object_truth) AS m FROM detections)", "norm_flux norm_err")
def _(v):
    return L.normalise(v.detections, "object_truth").select("detection_id", "norm_flux", "norm_err")


@query("agg10_robust_scale", "detections", "SELECT band, median(flux) AS location, 1.4826 * median(abs(flux - m)) AS scale FROM (SELECT *, median(flux) OVER (PARTITION BY band) AS m FROM detections) GROUP BY band", "location scale")
def _(v):
    middle = v.detections.groupBy("band").agg(F.median("flux").alias("m"))
    rows = v.detections.join(middle, "band")
    return rows.groupBy("band").agg(F.median("flux").alias("location"), (L.MAD_SIGMA * F.median(F.abs(F.col("flux") - F.col("m")))).alias("scale"))


@query("model16_lomb_scargle", "detections", """
WITH a AS (SELECT *, count(*) OVER w AS n, mjd - min(mjd) OVER w AS t, max(mjd) OVER w - min(mjd) OVER w AS base, 1 / (flux_err * flux_err) / sum(1 / (flux_err * flux_err)) OVER w AS wt FROM detections WINDOW w AS (PARTITION BY object_truth)),
b AS (SELECT *, flux - sum(wt * flux) OVER (PARTITION BY object_truth) AS y, greatest(1 / least(100.0, 2 * base), 1 / (5 * base)) AS lo FROM a WHERE n >= 5 AND base > 0),
c AS (SELECT object_truth, n, t, wt, y, k, lo + k * ((50 - lo) / 199) AS fr FROM b, (SELECT range AS k FROM range(200))),
tau AS (SELECT object_truth, k, 0.5 * atan2(sum(wt * 2 * sin(2 * pi() * fr * t) * cos(2 * pi() * fr * t)), sum(wt * (pow(cos(2 * pi() * fr * t), 2) - pow(sin(2 * pi() * fr * t), 2)))) AS h FROM c GROUP BY object_truth, k),
s AS (SELECT c.object_truth, c.k, any_value(n) AS n, any_value(fr) AS fr, sum(wt * y * y) AS yy, sum(wt * pow(cos(2 * pi() * fr * t - h), 2)) AS cc, sum(wt * pow(sin(2 * pi() * fr * t - h), 2)) AS ss,
      sum(wt * y * cos(2 * pi() * fr * t - h)) AS yc, sum(wt * y * sin(2 * pi() * fr * t - h)) AS ys FROM c JOIN tau ON c.object_truth = tau.object_truth AND c.k = tau.k GROUP BY c.object_truth, c.k),
p AS (SELECT *, CASE WHEN yy > 0 THEN least(greatest((CASE WHEN cc > 1e-12 THEN yc * yc / cc ELSE 0 END + CASE WHEN ss > 1e-12 THEN ys * ys / ss ELSE 0 END) / yy, 0), 1) ELSE 0 END AS power FROM s)
SELECT object_truth, max(power) AS power, CAST(any_value(n) AS DOUBLE) AS n_epochs FROM p GROUP BY object_truth""", "power n_epochs")  # fmt: skip
def _(v):
    return L.periods(v.detections, "object_truth", n_frequencies=200).select("object_truth", "power", "n_epochs")


@query("model16_periods")
def _(v):
    return L.periods(v.detections, "object_truth")


@query("win21_curve_encoding")
def _(v):
    return L.encode(v.detections, "object_truth", ORDER, 64)


@query("win19_last_limit", "detections", "SELECT d.object_truth, max(d.mjd) AS last_limit_mjd, arg_max(d.band, d.mjd) AS last_limit_band FROM detections d JOIN (SELECT object_truth, max(mjd) AS newest FROM detections GROUP BY object_truth) n ON d.object_truth = n.object_truth WHERE d.flux / d.flux_err < 5 AND d.mjd < newest GROUP BY d.object_truth", "last_limit_mjd")
def _(v):
    newest = v.detections.withColumn("newest", F.max("mjd").over(Window.partitionBy("object_truth")))
    return L.last_before(newest, "object_truth", "newest", F.col("flux") / F.col("flux_err") >= 5)


@query("model14_nearest_centroid", "detections", FEATURES_SQL + """, k AS (SELECT *, object_truth % 3 AS label FROM f),
x AS (SELECT object_truth, label, [coalesce(std_flux, 0) / 30, coalesce(skewness, 0), coalesce(von_neumann_eta, 0)] AS x FROM k),
ce AS (SELECT label AS centre, [avg(x[1]), avg(x[2]), avg(x[3])] AS m FROM x GROUP BY label),
di AS (SELECT object_truth, centre, sqrt(pow(x[1] - m[1], 2) + pow(x[2] - m[2], 2) + pow(x[3] - m[3], 2)) AS dist FROM x, ce),
p AS (SELECT *, 1 / (1 + dist) / sum(1 / (1 + dist)) OVER (PARTITION BY object_truth) AS probability FROM di)
SELECT object_truth, CAST(centre AS BIGINT) AS predicted, probability FROM p QUALIFY row_number() OVER (PARTITION BY object_truth ORDER BY round(dist, 9), centre) = 1""", "probability")  # fmt: skip
def _(v):
    from ..operators import learn

    f = L.variability(v.detections, "object_truth", ORDER)
    x = F.array(F.coalesce("std_flux", F.lit(0.0)) / 30, F.coalesce("skewness", F.lit(0.0)), F.coalesce("von_neumann_eta", F.lit(0.0)))
    rows = f.select("object_truth", (F.col("object_truth") % 3).alias("label"), x.alias("x"))
    return learn.nearest_centroid(rows, rows, "object_truth").select("object_truth", "predicted", "probability")
