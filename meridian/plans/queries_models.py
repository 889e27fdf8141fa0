"""Queries of photometric redshifts, novelty models and bootstrap errors."""

import math

from pyspark.sql import functions as F

from ..functions.columns import magnitude
from ..operators import boosting, learn, photoz
from ..operators import pixels as P
from .registry import query



def noise(*keys: str):
    """Normal deviates from a hash of the keys, the same in every run and partitioning."""
    u, w = ((F.pmod(F.xxhash64(*keys, F.lit(n)), F.lit(1 << 40)) + 0.5) / float(1 << 40) for n in (1, 2))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * w)


@query("model17_photoz", "detections", """WITH m AS (SELECT object_truth, band, 25 - 2.5 * log10(avg(flux)) AS mag FROM detections WHERE flux > 0 GROUP BY object_truth, band),
o AS (SELECT a.object_truth, a.mag - b.mag AS gr, b.mag - c.mag AS ri FROM m a JOIN m b ON a.object_truth = b.object_truth JOIN m c ON a.object_truth = c.object_truth WHERE a.band = 'g' AND b.band = 'r' AND c.band = 'i'),
l AS (SELECT range % 4 AS template, floor(range / 4) * 0.02 AS z, -0.5 + 0.3 * (range % 4) + 0.8 * floor(range / 4) * 0.02 AS tgr, -0.3 + 0.1 * (range % 4) + 0.4 * floor(range / 4) * 0.02 AS tri FROM range(204)),
x AS (SELECT object_truth, z, template, pow((gr - tgr) / 0.2, 2) + pow((ri - tri) / 0.2, 2) AS chi2 FROM o, l),
y AS (SELECT *, exp(-0.5 * (chi2 - min(chi2) OVER (PARTITION BY object_truth))) AS p FROM x)
SELECT object_truth, min(chi2) AS chi2, sum(p * z) / sum(p) AS z_mean FROM y GROUP BY object_truth""", "chi2 z_mean")  # fmt: skip
def _(v):
    def mag(band):
        return magnitude(F.avg(F.when(F.col("band") == band, F.col("flux"))))

    o = v.detections.filter("flux > 0").groupBy("object_truth").agg((mag("g") - mag("r")).alias("gr"), (mag("r") - mag("i")).alias("ri"))
    k, z = F.col("id") % 4, F.floor(F.col("id") / 4) * 0.02
    library = v.spark.range(204).select(k.alias("template"), z.alias("z"), (-0.5 + 0.3 * k + 0.8 * z).alias("gr"), (-0.3 + 0.1 * k + 0.4 * z).alias("ri"))
    o = o.withColumns({"e1": F.lit(0.2), "e2": F.lit(0.2)})
    return photoz.fit(o, library, "object_truth", ["gr", "ri"], ["e1", "e2"]).select("object_truth", "chi2", "z_mean")


@query("model13_mahalanobis")
def _(v):
    return learn.mahalanobis(v.sources, "source_id", ["flux", "gini", "m20", "asymmetry"])


@query("model08_isolation_forest")
def _(v):
    return learn.isolation_forest(v.embeddings.select("vec_id", F.col("embedding").alias("x")), "vec_id")


@query("model27_bootstrap_gini")
def _(v):
    noisy = v.pixels.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("value", F.col("value") + F.col("rms") * noise("epoch", "y", "x", "replicate"))
    noisy = noisy.withColumn("frame", F.col("epoch") * 100 + F.col("replicate"))
    g = P.gini(noisy, "frame").withColumn("epoch", F.floor(F.col("frame") / 100))
    return g.groupBy("epoch").agg(F.avg("gini").alias("mean"), F.stddev_samp("gini").alias("error"))


def _ensemble(v):
    x = v.embeddings.select("vec_id", F.col("embedding").alias("x"))
    near = learn.novelty(learn.neighbours(x, "vec_id", 8), "vec_id").withColumnRenamed("novelty", "score")
    return learn.ensemble([near, learn.reconstruction_score(x, 8).select("vec_id", "score"), learn.isolation_forest(x, "vec_id")], "vec_id")


@query("model12_anomaly_ensemble")
def _(v):
    return _ensemble(v).select("vec_id", "score")


@query("top04_anomalies")
def _(v):
    return _ensemble(v).orderBy(F.round("score", 9).desc(), "vec_id").limit(20)


@query("model30_variability_search")
def _(v):
    from ..operators import lightcurve as L

    scored = L.variability(v.detections, "object_truth", ["mjd", "detection_id"]).withColumn("score", L.variability_score())
    worth = v.detections.join(scored.filter("score > 0.35 AND n_epochs >= 6").select("object_truth"), "object_truth", "left_semi")
    period = L.periods(worth, "object_truth").select("object_truth", "period", "false_alarm_probability")
    out = scored.join(period, "object_truth", "left")
    return out.select("object_truth", "score", "period", "false_alarm_probability", (F.col("score") > 0.5).alias("variable"), F.coalesce(F.col("false_alarm_probability") < 0.01, F.lit(False)).alias("periodic"))


_SHAPE = ["concentration", "asymmetry", "gini", "m20", "ellipticity", "r50"]


def _shapes(v):
    return v.sources.select("source_id", F.array(*_SHAPE).alias("x"), F.col("class").alias("label"))


@query("model10_boosted_trees")
def _(v):
    """Classes of all sources by their shapes, from a model fitted on all of them."""
    return boosting.score_boosted(_shapes(v), "source_id", boosting.fit_boosted(_shapes(v)))


@query("model10_importances")
def _(v):
    model = boosting.fit_boosted(_shapes(v), rounds=20)
    rows = [(name, float(share)) for name, share in zip(_SHAPE, model.importance(), strict=True)]
    return v.spark.createDataFrame(rows, "feature string, importance double")


@query("model15_shapley")
def _(v):
    """Why each source without a class is given the class it is given by a model of those that have one."""
    rows = _shapes(v)
    known = rows.filter("label <> 'unknown'")
    model = boosting.fit_boosted(known, rounds=20)
    return boosting.shapley(rows.filter("label = 'unknown'"), "source_id", known, model.predict_proba, _SHAPE, coded=boosting.Coded(model))
