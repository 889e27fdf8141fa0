"""Queries of population summaries, reviews, calibration and pixel tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import magnitude
from ..operators import pixels as P
from ..operators import population as N
from ..operators import review as R
from .registry import query

MAG = "(25 - 2.5 * log10(flux))"
COUNTS = f"c AS (SELECT k, count(*) AS n0 FROM (SELECT CAST(floor({MAG} / 0.5) AS BIGINT) AS k FROM sources WHERE flux > 0) GROUP BY k), b AS (SELECT unnest(range((SELECT min(k) FROM c), (SELECT max(k) FROM c) + 1)) AS k), n AS (SELECT b.k * 0.5 AS bin, coalesce(n0, 0) AS n, CASE WHEN n0 > 0 THEN log10(n0) END AS log_n FROM b LEFT JOIN c ON b.k = c.k)"


def _counts(v):
    return N.number_counts(v.sources, magnitude(F.col("flux")))


@query("agg01_class_counts", "sources", "SELECT class, count(*) AS n FROM sources GROUP BY class")
def _(v):
    return v.sources.groupBy("class").agg(F.count("*").alias("n"))


@query("agg02_field_statistics", "sources", f"SELECT count(*) AS n, count(*) / (4096.0 * 4096 / 3600) AS density, min({MAG}) AS brightest, max({MAG}) AS faintest, count(*) FILTER (class = 'star') / CAST(count(*) FILTER (class = 'galaxy') AS DOUBLE) AS star_galaxy FROM sources WHERE flux > 0", "density brightest faintest star_galaxy")
def _(v):
    m = magnitude(F.col("flux"))
    return v.sources.filter("flux > 0").agg(F.count("*").alias("n"), (F.count("*") / (4096.0 * 4096 / 3600)).alias("density"), F.min(m).alias("brightest"), F.max(m).alias("faintest"), (F.count_if(F.col("class") == "star") / F.count_if(F.col("class") == "galaxy")).alias("star_galaxy"))


@query("agg03_number_counts", "sources", f"WITH {COUNTS} SELECT * FROM n", "bin log_n")
def _(v):
    return _counts(v)


@query("agg04_counts_slope", "sources", f"WITH {COUNTS} SELECT CASE WHEN count(log_n) >= 3 THEN regr_slope(log_n, bin) END AS slope FROM n", "slope")
def _(v):
    return N.counts_slope(_counts(v))


@query("agg05_completeness", "sources", f"WITH {COUNTS} SELECT bin AS limit_mag FROM n ORDER BY n DESC, bin LIMIT 1", "limit_mag")
def _(v):
    return N.completeness(_counts(v))


@query("agg44_field_reference", "sources", "SELECT median(area_pixels) AS area, median(r50) AS r50, count(*) AS n_resolved FROM sources WHERE area_pixels > 20", "area r50")
def _(v):
    return N.field_reference(v.sources)


@query("agg45_verdict_agreement", "verdicts", "SELECT model_label, count(*) AS n, avg(CASE WHEN label = model_label THEN 1.0 ELSE 0 END) AS agreement, CAST(count(*) FILTER (label <> model_label AND model_confidence > 0.9) AS BIGINT) AS confidently_wrong FROM verdicts GROUP BY model_label", "agreement")
def _(v):
    return R.agreement(v.verdicts)


@query("agg46_disagreements", "verdicts", "SELECT source_id, string_agg(label, '|' ORDER BY label) AS labels FROM (SELECT DISTINCT source_id, label FROM verdicts) GROUP BY source_id HAVING count(*) > 1")
def _(v):
    return R.disagreements(v.verdicts)


@query("agg47_class_balance", "scored_labels", "WITH c AS (SELECT y, count(*) AS c FROM scored_labels GROUP BY y) SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS classes, max(c) / CAST(min(c) AS DOUBLE) AS imbalance, arg_max(y, c) AS majority, max(c) / CAST(sum(c) AS DOUBLE) AS majority_share FROM c", "imbalance majority_share")
def _(v):
    return R.class_balance(v.scored_labels, "y")


@query("agg48_feature_report", "sources", " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0 END) AS finite, median({c}) AS median, stddev_pop({c}) AS std FROM sources" for c in ("flux", "gini", "m20", "r50")), "finite median std")
def _(v):
    return N.feature_report(v.sources, ["flux", "gini", "m20", "r50"])


@query("agg49_reliability", "scored_labels", "SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score, avg(CAST(y AS DOUBLE)) AS observed FROM scored_labels GROUP BY 1", "mean_score observed")
def _(v):
    return N.reliability(v.scored_labels)


@query("agg49_calibration_errors", "scored_labels", "WITH b AS (SELECT count(*) AS n, abs(avg(score) - avg(CAST(y AS DOUBLE))) AS gap FROM scored_labels GROUP BY least(floor(score * 10), 9)) SELECT sum(n * gap) / sum(n) AS ece, max(gap) AS worst, (SELECT avg(pow(score - y, 2)) FROM scored_labels) AS brier, sum(n * gap) / sum(n) <= 0.15 AS usable FROM b", "ece worst brier")
def _(v):
    return N.calibration_errors(v.scored_labels)


@query("agg58_ranking_auc", "scored_labels", "WITH s AS (SELECT round(score, 3) AS s, y FROM scored_labels) SELECT avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS auc FROM s a, s b WHERE a.y = 1 AND b.y = 0", "auc")
def _(v):
    return N.auc(v.scored_labels.select(F.round("score", 3).alias("score"), "y"), "score", "y")


@query("agg53_catalog_digest")
def _(v):
    return N.digest(v.sources, ["x", "y", "flux"])


@query("win18_latest_verdict", "verdicts", "SELECT source_id, seq, label FROM verdicts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, seq DESC) = 1")
def _(v):
    return R.latest(v.verdicts).select("source_id", "seq", "label")


@query("src12_vote_labels", "scored_labels", "SELECT doc_id, ['p0', 'p1', 'p2'][list_position([p0, p1, p2], greatest(p0, p1, p2))] AS label, greatest(p0, p1, p2) / (p0 + p1 + p2) AS weight FROM scored_labels WHERE greatest(p0, p1, p2) / (p0 + p1 + p2) >= 0.5", "weight")
def _(v):
    return R.vote_labels(v.scored_labels, "doc_id", ["p0", "p1", "p2"], 0.5)


for _method, _order in (("uncertainty", "DESC"), ("confident", "ASC")):
    query(f"top06_review_{_method}", "scored_labels", f"SELECT doc_id FROM (SELECT doc_id, round(1 - (l[3] - l[2]), 9) AS u FROM (SELECT doc_id, list_sort([p0, p1, p2]) AS l FROM scored_labels)) ORDER BY u {_order}, doc_id LIMIT 30")(lambda v, m=_method: R.select_for_review(v.scored_labels.select("doc_id", F.array("p0", "p1", "p2").alias("p")), "doc_id", 30, m).select("doc_id"))


@query("top06_review_balanced")
def _(v):
    return R.select_for_review(v.scored_labels.select("doc_id", F.array("p0", "p1", "p2").alias("p")), "doc_id", 30, "balanced").select("doc_id")


@query("top07_vetting_queue", "sources verdicts", "SELECT source_id, row_number() OVER (ORDER BY flux DESC, source_id) AS rank FROM (SELECT * FROM sources ORDER BY flux DESC, source_id LIMIT 200) QUALIFY source_id NOT IN (SELECT source_id FROM verdicts WHERE reviewer = 'rev1')")
def _(v):
    from pyspark.sql import Window

    top = v.sources.orderBy(F.desc("flux"), "source_id").limit(200).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("flux"), "source_id")))
    return R.vetting_queue(top.select("source_id", "rank"), v.verdicts, "rev1")


# pixel tables


@query("prj11_valid_pixels", "pixels", "SELECT epoch, count(*) AS n FROM pixels WHERE NOT bad GROUP BY epoch")
def _(v):
    return P.valid(v.pixels).groupBy("epoch").agg(F.count("*").alias("n"))


@query("prj17_circular_mask", "pixels", "SELECT epoch, sum(value) AS flux FROM pixels WHERE pow(x - 9.5, 2) + pow(y - 9.5, 2) <= 25 GROUP BY epoch", "flux")
def _(v):
    return v.pixels.filter((F.col("x") - 9.5) ** 2 + (F.col("y") - 9.5) ** 2 <= 25).groupBy("epoch").agg(F.sum("value").alias("flux"))


@query("agg11_sigma_clip")
def _(v):
    return P.clipped_statistics(P.valid(v.pixels), "epoch")


@query("agg14_block_reduce", "pixels", "SELECT epoch, CAST(floor(y / 4) AS BIGINT) AS by, CAST(floor(x / 4) AS BIGINT) AS bx, avg(value) AS value FROM pixels GROUP BY ALL", "value")
def _(v):
    return v.pixels.groupBy("epoch", F.floor(F.col("y") / 4).alias("by"), F.floor(F.col("x") / 4).alias("bx")).agg(F.avg("value").alias("value"))


@query("agg15_radial_profile", "pixels", "SELECT epoch, CAST(floor(sqrt(pow(x - 9.5, 2) + pow(y - 9.5, 2))) AS BIGINT) AS r, avg(value) AS profile FROM pixels GROUP BY ALL", "profile")
def _(v):
    return v.pixels.groupBy("epoch", F.floor(F.hypot(F.col("x") - 9.5, F.col("y") - 9.5)).alias("r")).agg(F.avg("value").alias("profile"))


@query("agg18_epoch_stack", "pixels", "SELECT y, x, median(value) AS value, bool_or(bad) AS any_bad, bool_and(bad) AS all_bad FROM pixels GROUP BY y, x", "value")
def _(v):
    return P.stack(v.pixels, "median")


@query("agg18_trimmed_stack", "pixels", "SELECT y, x, CASE WHEN count(*) >= 5 THEN (sum(value) - max(value) - min(value)) / (count(*) - 2) ELSE avg(value) END AS value FROM pixels GROUP BY y, x", "value")
def _(v):
    return P.stack(v.pixels, "trimmed")


@query("agg20_frame_moments", "pixels", """WITH s AS (SELECT epoch, sum(value) AS f, sum(value * x) / sum(value) AS cx, sum(value * y) / sum(value) AS cy, sum(value * x * x) / sum(value) AS xx, sum(value * y * y) / sum(value) AS yy, sum(value * x * y) / sum(value) AS xy, max(value) AS peak, count(*) AS area FROM pixels WHERE value > 0 GROUP BY epoch)
SELECT epoch, f AS flux, peak, cx, cy, sqrt((xx - cx * cx + yy - cy * cy) / 2 + sqrt(pow((xx - cx * cx - yy + cy * cy) / 2, 2) + pow(xy - cx * cy, 2))) AS semi_major FROM s""", "flux peak cx cy semi_major")  # fmt: skip
def _(v):
    return P.moments(v.pixels.filter("value > 0"), ["epoch"]).select("epoch", "flux", "peak", "cx", "cy", "semi_major")


@query("agg29_gini", "pixels", "WITH r AS (SELECT epoch, abs(value) AS v, row_number() OVER (PARTITION BY epoch ORDER BY abs(value), y, x) AS i, count(*) OVER (PARTITION BY epoch) AS n FROM pixels) SELECT epoch, sum((2 * i - n - 1) * v) / (sum(v) * (max(n) - 1)) AS gini FROM r GROUP BY epoch", "gini")
def _(v):
    return P.gini(v.pixels, "epoch")


@query("agg30_m20", "pixels", """WITH p AS (SELECT *, sum(value) OVER w AS t, sum(value * x) OVER w / sum(value) OVER w AS cx, sum(value * y) OVER w / sum(value) OVER w AS cy FROM pixels WHERE value > 0 WINDOW w AS (PARTITION BY epoch)),
q AS (SELECT *, value * (pow(x - cx, 2) + pow(y - cy, 2)) AS mom, coalesce(sum(value) OVER (PARTITION BY epoch ORDER BY value DESC, y, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT epoch, log10(sum(mom) FILTER (before < 0.2 * t) / sum(mom)) AS m20 FROM q GROUP BY epoch""", "m20")  # fmt: skip
def _(v):
    return P.m20(v.pixels, "epoch")


@query("agg31_asymmetry", "pixels", "SELECT a.epoch, sum(abs(a.value - b.value)) / sum(abs(a.value)) AS asymmetry FROM pixels a JOIN pixels b ON a.epoch = b.epoch AND b.x = 19 - a.x AND b.y = 19 - a.y GROUP BY a.epoch", "asymmetry")
def _(v):
    return P.asymmetry(v.pixels, "epoch", 9.5, 9.5)


@query("win12_stencil_mean", "pixels", """WITH f AS (SELECT epoch FROM pixels GROUP BY epoch HAVING count(*) = 400), o AS (SELECT unnest([-1, 0, 1]) AS d),
t AS (SELECT p.epoch, p.y, p.x, CASE WHEN p.y + a.d < 0 THEN -p.y - a.d - 1 WHEN p.y + a.d >= 20 THEN 39 - p.y - a.d ELSE p.y + a.d END AS sy, CASE WHEN p.x + b.d < 0 THEN -p.x - b.d - 1 WHEN p.x + b.d >= 20 THEN 39 - p.x - b.d ELSE p.x + b.d END AS sx FROM pixels p JOIN f ON p.epoch = f.epoch, o a, o b)
SELECT t.epoch, t.y, t.x, sum(q.value / 9.0) AS value FROM t JOIN pixels q ON t.epoch = q.epoch AND t.sy = q.y AND t.sx = q.x GROUP BY t.epoch, t.y, t.x""", "value")  # fmt: skip
def _(v):
    full = v.pixels.groupBy("epoch").count().filter("count = 400").select("epoch")
    taps = [(a, b, 1 / 9) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return P.stencil(v.pixels.join(full, "epoch"), "epoch", taps, 20, 20, "sum")


@query("win13_local_maxima")
def _(v):
    p = v.pixels.withColumn("n", F.count("*").over(Window.partitionBy("epoch"))).filter("n = 400")
    return P.box_max(p, "epoch", 2).filter("value = top AND value > 50").select("epoch", "y", "x", "value")


@query("model09_components", "pixels", """WITH RECURSIVE on_ AS (SELECT epoch, y, x, epoch * 1000000 + y * 1000 + x AS id FROM pixels WHERE value > 60),
e AS (SELECT a.id AS a, b.id AS b FROM on_ a JOIN on_ b ON a.epoch = b.epoch AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r(id, l) AS (SELECT id, id FROM on_ UNION SELECT e.b, r.l FROM r JOIN e ON r.id = e.a WHERE r.l < e.b)
SELECT id, min(l) AS label FROM r GROUP BY id""")  # fmt: skip
def _(v):
    return P.label(v.pixels, "epoch", 60.0, side=1000).select("id", "label")


@query("model32_extraction")
def _(v):
    regions = P.label(v.pixels, "epoch", 60.0, side=1000)
    return P.moments(regions, ["epoch", "label"]).filter("area >= 3")


@query("set04_mask_union", "pixels", "SELECT y, x, bool_or(bad) AS any_bad FROM pixels GROUP BY y, x")
def _(v):
    return P.stack(v.pixels).select("y", "x", "any_bad")


@query("agg33_smoothness", "pixels", """WITH a AS (SELECT *, sum(value) OVER w AS s, count(value) OVER w AS n FROM pixels WINDOW w AS (PARTITION BY epoch, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
b AS (SELECT epoch, value, greatest(value - sum(s) OVER w / sum(n) OVER w, 0) AS res, sqrt(pow(x - 9.5, 2) + pow(y - 9.5, 2)) AS r, x < 2 OR y < 2 OR x > 17 OR y > 17 AS sky FROM a WINDOW w AS (PARTITION BY epoch, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
g AS (SELECT epoch, count(*) FILTER (NOT sky AND r > 1.5 AND r <= 9) AS n, sum(res) FILTER (NOT sky AND r > 1.5 AND r <= 9) AS res, sum(value) FILTER (NOT sky AND r > 1.5 AND r <= 9) AS light, avg(res) FILTER (sky) AS sky_res FROM b GROUP BY epoch)
SELECT epoch, res / light - sky_res * n / light AS smoothness, res / light AS raw, sky_res * n / light AS sky_term, CAST(3 AS INTEGER) AS box FROM g""", "smoothness raw sky_term")  # fmt: skip
def _(v):
    edge = (F.col("x") < 2) | (F.col("y") < 2) | (F.col("x") > 17) | (F.col("y") > 17)
    return P.smoothness(v.pixels, "epoch", 9.5, 9.5, 6.0, edge)
