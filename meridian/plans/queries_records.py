"""Queries of nested and flat records, files, line ratios, stretches, extraction and forced photometry."""

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import frames, match, spectra
from ..operators.rounds import shared_folder
from ..sources import tables
from .queries_match import _OBJ, _PAIRS, _objects, _sky_pairs
from .registry import query

FLAGS = "concat_ws('|', CASE WHEN source_id % 2 = 0 THEN 'edge' END, CASE WHEN source_id % 3 = 0 THEN 'blended' END)"


def _flagged(v):
    flags = F.concat_ws("|", F.when(F.col("source_id") % 2 == 0, "edge"), F.when(F.col("source_id") % 3 == 0, "blended"))
    return v.sources.withColumns({"flags": flags, "semi_major": F.when(F.col("source_id") % 5 != 0, F.col("semi_major"))})


@query("src04_source_rows", "sources", f"""SELECT source_id, x, y, class, coalesce(CASE WHEN source_id % 5 <> 0 THEN semi_major END, greatest(sqrt(area_pixels) / 2, 1)) AS semi_major,
flux, fwhm, concentration, asymmetry, gini, m20, {FLAGS} AS flags FROM sources""", "x y semi_major flux fwhm concentration asymmetry gini m20")  # fmt: skip
def _(v):
    return C.flatten_sources(C.nest_sources(_flagged(v))).drop("flux_err")


@query("src02_nested_json", "sources", f"SELECT source_id, flux, fwhm, gini, {FLAGS} AS flags FROM sources", "flux fwhm gini")
def _(v):
    path = f"{shared_folder(v.spark)}/nested"
    nested = C.nest_sources(_flagged(v))
    nested.write.json(path)
    back = C.flatten_sources(v.spark.read.schema(nested.schema).json(path))
    return back.select("source_id", "flux", "fwhm", "gini", "flags")


@query("src09_reference_file", "reference_objects", "SELECT ref_id, ra, dec, mag_r, mag_r - 0.5 AS mag_i FROM reference_objects WHERE ref_id % 7 <> 0", "ra dec mag_r mag_i")
def _(v):
    path = f"{shared_folder(v.spark)}/references"
    rows = v.reference_objects.select(F.col("ref_id").alias("ID"), F.when(F.col("ref_id") % 7 != 0, F.col("ra")).alias("RAJ2000"), F.col("dec").alias("DEJ2000"), F.col("mag_r").alias("rmag"), (F.col("mag_r") - 0.5).alias("Imag"))
    rows.write.option("header", True).csv(path)
    back = tables.read_references(v.spark, path)
    return back.select(F.col("id").cast("long").alias("ref_id"), "ra", "dec", F.col("magnitudes")["r"].alias("mag_r"), F.col("magnitudes")["i"].alias("mag_i"))


@query("src15_verdict_log", "verdicts", """SELECT reviewer, count(*) AS kept, CAST(count(*) FILTER (seq % 2 = 1) AS BIGINT) AS with_note, (SELECT count(*) FROM verdicts WHERE seq % 11 = 0) AS refused
FROM verdicts WHERE seq % 11 <> 0 GROUP BY reviewer""")  # fmt: skip
def _(v):
    path = f"{shared_folder(v.spark)}/verdict-log"
    rows = v.verdicts.withColumn("reviewer", F.when(F.col("seq") % 11 == 0, "  ").otherwise(F.col("reviewer")))
    old = rows.filter("seq % 2 = 0")
    new = rows.filter("seq % 2 = 1").withColumn("note", F.lit("seen again"))
    refused = tables.append_verdicts(old, path) + tables.append_verdicts(new, path)
    log = tables.read_verdicts(v.spark, path, new.schema)
    return log.groupBy("reviewer").agg(F.count("*").alias("kept"), F.count("note").alias("with_note")).withColumn("refused", F.lit(refused).cast("long"))


@query("src18_report", "sources", """SELECT class, count(*) AS n, round(avg(flux), 4) AS mean_flux, round(max(flux), 4) AS top_flux, arg_max(source_id, struct_pack(f := flux, s := source_id)) AS top_source FROM sources GROUP BY class""", "mean_flux top_flux")
def _(v):
    path = f"{shared_folder(v.spark)}/report"
    report = v.sources.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("flux"), 4).alias("mean_flux"), F.round(F.max("flux"), 4).alias("top_flux"), F.max_by("source_id", F.struct("flux", "source_id")).alias("top_source"))
    report.write.json(path)
    return v.spark.read.schema(report.schema).json(path)


@query("src19_report_rows", "alerts", """WITH limits AS (SELECT h.object_id, max(h.mjd) AS last_limit FROM history h JOIN alerts a ON a.object_id = h.object_id WHERE h.flux < 5 * h.flux_err AND h.mjd < a.mjd GROUP BY h.object_id)
SELECT a.object_id, candid, ra, dec, mjd + 2400000.5 AS discovery_jd, classification AS at_type, last_limit FROM alerts a LEFT JOIN limits l ON l.object_id = a.object_id WHERE classification IS NOT NULL""", "ra dec discovery_jd last_limit")  # fmt: skip
def _(v):
    return tables.report_rows(v.alerts, "reviewer")


@query("src07_alert_sink", "alerts", "SELECT object_id, (SELECT count(*) FROM history h WHERE h.object_id = a.object_id) AS n_history, mjd, flux FROM alerts a WHERE rb >= 0.3", "mjd flux")
def _(v):
    path = f"{shared_folder(v.spark)}/alerts"
    kept = tables.write_alerts(v.alerts, path, 0.3)
    back = v.spark.read.schema(kept).parquet(path)
    return back.select("object_id", F.size("prv_candidates").cast("long").alias("n_history"), "candidate.mjd", "candidate.flux")


@query("join07_standards", "detections reference_objects", f"""WITH {_OBJ}, {_PAIRS}, n AS (SELECT a_id, arg_min(b_id, struct_pack(s := round(sep, 9), b := b_id)) AS b_id FROM pairs WHERE sep <= 2 GROUP BY a_id),
f AS (SELECT object_truth, avg(flux) AS flux, avg(flux_err) AS flux_err FROM detections WHERE band = 'r' GROUP BY object_truth)
SELECT object_truth AS id, n.b_id, 25 - 2.5 * log10(flux) AS instrumental, mag_r FROM f JOIN n ON a_id = object_truth JOIN reference_objects r ON r.ref_id = n.b_id WHERE flux >= 12 * flux_err""", "instrumental mag_r")  # fmt: skip
def _(v):
    means = v.detections.filter("band = 'r'").groupBy(F.col("object_truth").alias("id")).agg(F.avg("flux").alias("flux"), F.avg("flux_err").alias("flux_err"))
    return C.standards(means, match.nearest(_sky_pairs(v, 2.0)), v.reference_objects, 12.0)


@query("join16_metric_comparison", "sources", """WITH t AS (SELECT source_id, gini * 1.05 + (source_id % 7) * 0.01 AS gini, m20 - 0.1 * (source_id % 3) AS m20 FROM sources),
l AS (SELECT 'gini' AS metric, a.gini AS a, t.gini AS b FROM sources a JOIN t USING (source_id) UNION ALL SELECT 'm20', a.m20, t.m20 FROM sources a JOIN t USING (source_id)),
r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY a) + (count(*) OVER (PARTITION BY metric, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY metric ORDER BY b) + (count(*) OVER (PARTITION BY metric, b) - 1) / 2.0 AS rb FROM l),
m AS (SELECT metric, count(*) AS n, median(a - b) AS median_difference, corr(ra, rb) AS spearman FROM r GROUP BY metric)
SELECT m.*, (SELECT 1.4826 * median(abs(a - b - median_difference)) FROM l WHERE l.metric = m.metric) AS scatter FROM m""", "median_difference spearman scatter")  # fmt: skip
def _(v):
    theirs = v.sources.select("source_id", (F.col("gini") * 1.05 + (F.col("source_id") % 7) * 0.01).alias("gini"), (F.col("m20") - 0.1 * (F.col("source_id") % 3)).alias("m20"))
    return C.compare_metrics(v.sources, theirs, "source_id", ["gini", "m20"])


RING = "sqrt(pow(x - px, 2) + pow(y - py, 2))"


@query("join23_forced_photometry", "pixels", f"""WITH p AS (SELECT * FROM (VALUES (0, 5.0, 5.0), (1, 10.0, 9.5), (2, 15.5, 14.0)) AS t(position, px, py)),
r AS (SELECT position, epoch, mjd, value, rms, {RING} AS r FROM pixels, p WHERE NOT bad)
SELECT position, epoch, mjd, sum(value) FILTER (r <= 3) - count(*) FILTER (r <= 3) * coalesce(median(value) FILTER (r >= 5 AND r <= 8), 0) AS flux, sqrt(sum(rms * rms) FILTER (r <= 3)) AS flux_err FROM r WHERE r <= 8 GROUP BY position, epoch, mjd""", "mjd flux flux_err")  # fmt: skip
def _(v):
    return frames.forced_photometry(v.pixels, [(5.0, 5.0), (10.0, 9.5), (15.5, 14.0)], 3.0, (5.0, 8.0))


@query("join24_light_curve", "detections", "SELECT object_truth, band, count(*) AS n, min(mjd) AS first_mjd, max(mjd) AS last_mjd, arg_max(flux, struct_pack(m := mjd, d := detection_id)) AS last_flux FROM detections WHERE band IN ('g', 'r') GROUP BY object_truth, band", "first_mjd last_mjd last_flux")
def _(v):
    curve = F.array_sort(F.collect_list(F.struct("mjd", "detection_id", "flux", "flux_err")))
    curves = v.detections.filter(F.col("band").isin("g", "r")).groupBy("object_truth", "band").agg(curve.alias("curve"))
    return curves.select("object_truth", "band", F.size("curve").cast("long").alias("n"), F.col("curve")[0]["mjd"].alias("first_mjd"), F.element_at("curve", -1)["mjd"].alias("last_mjd"), F.element_at("curve", -1)["flux"].alias("last_flux"))


@query("agg54_boxcar_extract", "pixels", """SELECT epoch, x, sum(value) FILTER (abs(y - 9.5) <= 3) - count(*) FILTER (abs(y - 9.5) <= 3) * median(value) FILTER (abs(y - 9.5) > 3) AS flux, sqrt(sum(rms * rms) FILTER (abs(y - 9.5) <= 3)) AS error
FROM pixels GROUP BY epoch, x""", "flux error")  # fmt: skip
def _(v):
    return frames.boxcar_extract(v.pixels, 9.5, 3.0)


@query("top05_candidates", "epoch_detections", "SELECT det_id, epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY real_bogus DESC, significance DESC, det_id) AS INTEGER) AS rank FROM epoch_detections QUALIFY rank <= 10")
def _(v):
    return C.ranked(v.epoch_detections, "epoch", [F.desc("real_bogus"), F.desc("significance"), F.asc("det_id")], 10).select("det_id", "epoch", "rank")


STRETCH = "least(greatest((value - l[1]) / greatest(l[2] - l[1], 1e-12), 0), 1)"


@query("sca18_percentile_stretch", "pixels", f"WITH q AS (SELECT epoch, quantile_cont(value, [0.01, 0.995]) AS l FROM pixels GROUP BY epoch) SELECT epoch, y, x, {STRETCH} AS stretched FROM pixels JOIN q USING (epoch)", "stretched")
def _(v):
    return frames.percentile_stretch(v.pixels).select("epoch", "y", "x", "stretched")


@query("sca18_log_stretch", "pixels", f"WITH q AS (SELECT epoch, quantile_cont(value, [0.005, 0.999]) AS l FROM pixels GROUP BY epoch) SELECT epoch, y, x, ln(1000 * {STRETCH} + 1) / ln(1001.0) AS stretched FROM pixels JOIN q USING (epoch)", "stretched")
def _(v):
    return frames.percentile_stretch(v.pixels, 0.005, 0.999, 1000.0).select("epoch", "y", "x", "stretched")


@query("sca18_robust_score", "pixels", """WITH m AS (SELECT epoch, median(value) AS m FROM pixels GROUP BY epoch), s AS (SELECT epoch, 1.4826 * median(abs(value - m)) AS s FROM pixels JOIN m USING (epoch) GROUP BY epoch)
SELECT epoch, y, x, (value - m) / greatest(s, 1e-9) AS score FROM pixels JOIN m USING (epoch) JOIN s USING (epoch)""", "score")  # fmt: skip
def _(v):
    return frames.robust_score(v.pixels).select("epoch", "y", "x", "score")


LINES = ["hb", "o3", "ha", "n2"]
LINE_SQL = "l AS (SELECT spec_id, " + ", ".join(f"max(flux) FILTER (pix = {i}) AS {n}, max(error) FILTER (pix = {i}) * (1 + (spec_id + {i}) % 4) AS d{n}" for i, n in enumerate(LINES)) + " FROM spectra WHERE pix < 4 GROUP BY spec_id HAVING count(*) = 4)"
RATIO_SQL = "CASE WHEN {a} >= 3 * d{a} AND {b} >= 3 * d{b} THEN {a} / {b} WHEN {b} >= 3 * d{b} THEN 3 * d{a} / {b} WHEN {a} >= 3 * d{a} THEN {a} / (3 * d{b}) END"
STATUS_SQL = "CASE WHEN {a} >= 3 * d{a} AND {b} >= 3 * d{b} THEN 'measured' WHEN {b} >= 3 * d{b} THEN 'upper_limit' WHEN {a} >= 3 * d{a} THEN 'lower_limit' ELSE 'unavailable' END"
ERROR_SQL = "CASE WHEN {a} >= 3 * d{a} AND {b} >= 3 * d{b} THEN abs({a} / {b}) * sqrt(pow(d{a} / {a}, 2) + pow(d{b} / {b}, 2)) END"
BOTH_SQL = f"{LINE_SQL}, r AS (SELECT spec_id, " + ", ".join(f"{q.format(a=a, b=b)} AS {n}{k}" for a, b, k in (("o3", "hb", "o"), ("n2", "ha", "n")) for q, n in ((RATIO_SQL, "v"), (ERROR_SQL, "e"), (STATUS_SQL, "s"))) + " FROM l)"


def _ratios(v):
    columns = {}
    for i, n in enumerate(LINES):
        columns[n] = F.max(F.when(F.col("pix") == i, F.col("flux")))
        columns["d" + n] = F.max(F.when(F.col("pix") == i, F.col("error"))) * (1 + (F.col("spec_id") + i) % 4)
    rows = v.spectra.filter("pix < 4").groupBy("spec_id").agg(F.count("*").alias("held"), *[c.alias(n) for n, c in columns.items()]).filter("held = 4")
    pair = lambda a, b: spectra.line_ratio((F.col(a), F.col("d" + a)), (F.col(b), F.col("d" + b)))
    return rows.select("spec_id", pair("o3", "hb").alias("o"), pair("n2", "ha").alias("n"))


@query("sca29_line_ratio", "spectra", f"WITH {BOTH_SQL} SELECT spec_id, vo AS value, eo AS error, so AS status FROM r", "value error")
def _(v):
    return _ratios(v).select("spec_id", "o.*")


BOUNDARY = "CASE WHEN x < {p} THEN 0.61 / (x - {p}) + {o} ELSE CAST('-inf' AS DOUBLE) END"


@query("sca30_diagnostic_class", "spectra", f"""WITH {BOTH_SQL}, p AS (SELECT *, CASE WHEN vo > 0 AND vn > 0 THEN log10(vo) END AS y, CASE WHEN vo > 0 AND vn > 0 THEN log10(vn) END AS x FROM r),
b AS (SELECT *, {BOUNDARY.format(p=0.05, o=1.30)} AS k1, {BOUNDARY.format(p=0.47, o=1.19)} AS k2, sqrt(pow(coalesce(eo / (vo * ln(10)), 0), 2) + pow(coalesce(en / (vn * ln(10)), 0), 2)) AS spread FROM p)
SELECT spec_id, y AS log_o3_hb, x AS log_n2_ha, CASE WHEN x IS NULL THEN 'unclassified' WHEN y < k1 THEN 'star-forming' WHEN y < k2 THEN 'composite' WHEN y > 1.05 * x + 0.45 THEN 'Seyfert' ELSE 'LINER' END AS region,
coalesce(so = 'measured' AND sn = 'measured' AND least(abs(y - k1), abs(y - k2)) < CAST('inf' AS DOUBLE) AND least(abs(y - k1), abs(y - k2)) > greatest(2 * spread, 0.05), false) AS confident FROM b""", "log_o3_hb log_n2_ha")  # fmt: skip
def _(v):
    return spectra.diagnostic_class(_ratios(v), "o", "n").select("spec_id", "log_o3_hb", "log_n2_ha", "region", "confident")


@query("sca37_wavelength_axis", "spectra", "SELECT spec_id, pix, (1e-5 * pix + 5.2) * pix + 3990 AS wavelength, pix < 2 OR pix > 40 AS extrapolated FROM spectra", "wavelength")
def _(v):
    return spectra.wavelength_axis(v.spectra, [1e-5, 5.2, 3990.0], 2, 40).select("spec_id", "pix", "wavelength", "extrapolated")


@query("sca38_spectrum_transforms", "spectra", """WITH s AS (SELECT *, wavelength * 1.1 AS w FROM spectra), c AS (SELECT *, w - lag(w) OVER (PARTITION BY spec_id ORDER BY pix) AS step FROM s WHERE w BETWEEN 4405 AND 4600)
SELECT spec_id, count(*) AS n, median(flux / error) AS snr, median(step) AS dispersion FROM c GROUP BY spec_id""", "snr dispersion")  # fmt: skip
def _(v):
    return spectra.spectrum_summary(spectra.shifted(v.spectra, 0.1, 4405.0, 4600.0))


@query("sca39_bilinear", "pixels", """SELECT a.epoch, a.y, a.x, 0.45 * a.value + 0.15 * b.value + 0.3 * c.value + 0.1 * d.value AS sample FROM pixels a
JOIN pixels b ON b.epoch = a.epoch AND b.y = a.y AND b.x = a.x + 1 JOIN pixels c ON c.epoch = a.epoch AND c.y = a.y + 1 AND c.x = a.x JOIN pixels d ON d.epoch = a.epoch AND d.y = a.y + 1 AND d.x = a.x + 1""", "sample")  # fmt: skip
def _(v):
    return frames.bilinear(v.pixels, 0.25, 0.4)


@query("sca34_tabular_features", "sources", """WITH c AS (SELECT source_id, CASE WHEN source_id % 9 <> 0 THEN gini END AS g, m20, r50 FROM sources)
SELECT source_id, coalesce(g, (SELECT median(g) FROM c)) AS f0, m20 AS f1, r50 AS f2 FROM c""", "f0 f1 f2")  # fmt: skip
def _(v):
    rows = v.sources.withColumn("gini", F.when(F.col("source_id") % 9 != 0, F.col("gini")))
    out = C.tabular_features(rows, "source_id", ["gini", "m20", "r50"])
    return out.select("source_id", *[F.col("features")[i].alias(f"f{i}") for i in range(3)])


@query("sca35_narrative", "sources", "SELECT source_id, 'Source ' || source_id || ' is a ' || CASE WHEN ellipticity > 0.5 THEN 'elongated' WHEN ellipticity > 0.2 THEN 'oval' ELSE 'round' END || ' ' || class || ' with signal to noise ' || printf('%.1f', flux / flux_err) AS text FROM sources")
def _(v):
    return C.narrative(v.sources)


@query("udf05_block_function", "pixels", "SELECT epoch, CAST(y // 5 AS INTEGER) AS by, CAST(x // 5 AS INTEGER) AS bx, max(value) - min(value) AS spread FROM pixels GROUP BY ALL", "spread")
def _(v):
    return frames.block_function(v.pixels, 5, lambda values: float(values.max() - values.min()), "spread")


@query("src14_store_reads", "detections", "SELECT field_id, count(*) AS n_detections, count(DISTINCT object_truth) AS n_objects, min(mjd) AS first_mjd, max(mjd) AS last_mjd FROM detections GROUP BY field_id", "first_mjd last_mjd")
def _(v):
    path = f"{shared_folder(v.spark)}/store"
    tables.write_detections(v.detections, path)
    return tables.store_counts(v.spark, path, v.detections.schema)


@query("src10_extract_file", "reference_objects", "SELECT name, ra, dec, mag_r FROM reference_objects WHERE ref_id % 6 <> 0", "ra dec mag_r")
def _(v):
    path = f"{shared_folder(v.spark)}/extract"
    text = F.when(F.col("ref_id") % 6 != 0, F.col("ra").cast("string")).otherwise("---")
    rows = v.reference_objects.select(F.col("name").alias("Name"), text.alias("RAJ2000"), F.col("dec").alias("DEJ2000"), F.col("mag_r").alias("rmag"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    back = tables.read_extract(v.spark, path)
    return back.select("name", "ra", "dec", F.col("magnitudes")["rmag"].alias("mag_r"))
