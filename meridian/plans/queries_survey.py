"""Queries of growth curves, profile scans, template colours, luminosities, survey planes, tiles, models and the alert stream."""

from pyspark.sql import functions as F

from ..functions.columns import magnitude
from ..operators import growth, learn, locus, match, photometer, photoz, population, profiles, quantiles
from ..operators import pixels as P
from ..operators import spectra as S
from ..operators.rounds import shared_folder
from ..sources import tables
from ..streaming import jobs
from .queries_frames import _placed
from .queries_scalar import _E, _SIMPSON, COSMOS, DC_SQL
from .registry import query

CENTRE, MOST = 9.5, 9.0
STEP = (MOST - 0.75) / 29


@query("agg32_concentration", "pixels", f"""WITH o AS (SELECT (range + 0.5) / 4 - 0.5 AS d FROM range(4)), p AS (SELECT epoch, value / 16 AS part, sqrt(pow(x + a.d - {CENTRE}, 2) + pow(y + b.d - {CENTRE}, 2)) AS r FROM pixels, o a, o b),
g AS (SELECT epoch, k, sum(part) AS part FROM (SELECT epoch, part, CAST(greatest(ceil((r - 0.75) / {STEP!r}), 0) AS INTEGER) AS k FROM p WHERE r <= {MOST}) GROUP BY ALL),
c AS (SELECT e.epoch, CAST(k.range AS INTEGER) AS k, 0.75 + k.range * {STEP!r} AS radius, sum(coalesce(part, 0)) OVER (PARTITION BY e.epoch ORDER BY k.range) AS enclosed FROM (SELECT DISTINCT epoch FROM pixels) e CROSS JOIN range(30) k LEFT JOIN g ON g.epoch = e.epoch AND g.k = k.range),
w AS (SELECT *, last_value(enclosed) OVER (PARTITION BY epoch ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total, lag(enclosed) OVER (PARTITION BY epoch ORDER BY k) AS e0, lag(radius) OVER (PARTITION BY epoch ORDER BY k) AS r0 FROM c),
s AS (SELECT unnest([0.2, 0.5, 0.8]) AS share), h AS (SELECT epoch, share, arg_min(CASE WHEN e0 IS NULL OR abs(enclosed - e0) < 1e-12 THEN radius ELSE r0 + (share * total - e0) / (enclosed - e0) * (radius - r0) END, k) AS reach FROM w, s WHERE total > 0 AND enclosed >= share * total GROUP BY ALL),
t AS (SELECT e.epoch, max(reach) FILTER (share = 0.2) AS r20, max(reach) FILTER (share = 0.5) AS r50, max(reach) FILTER (share = 0.8) AS r80 FROM (SELECT DISTINCT epoch FROM pixels) e LEFT JOIN h ON h.epoch = e.epoch GROUP BY e.epoch)
SELECT *, CASE WHEN r20 > 0 THEN 5 * log10(r80 / r20) END AS concentration FROM t""", "r20 r50 r80 concentration")  # fmt: skip
def _(v):
    return profiles.concentration(v.pixels, "epoch", CENTRE, CENTRE, MOST)


@query("agg27_adaptive_aperture", "pixels", f"""WITH k AS (SELECT epoch, sqrt(pow(x - {CENTRE}, 2) + pow(y - {CENTRE}, 2)) AS r, greatest(value, 0) AS light FROM pixels)
SELECT epoch, coalesce(least(greatest(2.5 * sum(light * r) FILTER (r <= 12) / nullif(sum(light) FILTER (r <= 12), 0), 2), 12), 2) AS radius, sum(light * r) FILTER (r <= 12) / nullif(sum(light) FILTER (r <= 12), 0) AS kron FROM k GROUP BY epoch""", "radius kron")  # fmt: skip
def _(v):
    return profiles.adaptive_aperture(v.pixels, "epoch", CENTRE, CENTRE, 2.0, 12.0).select("epoch", "radius", "kron")


B_SQL = "(2 * n - 1.0 / 3 + 4.0 / (405 * n) + 46.0 / (25515 * n * n) + 131.0 / (1148175 * n * n * n))"


@query("model25_sersic_scan", "pixels", f"""WITH p AS (SELECT epoch, floor(sqrt(pow(x - {CENTRE}, 2) + pow(y - {CENTRE}, 2))) + 0.5 AS r, avg(value) AS value FROM pixels GROUP BY ALL),
n AS (SELECT CAST(0.3 AS DOUBLE) + CAST(1.7 AS DOUBLE) * range / 34 AS n FROM range(35) UNION ALL SELECT CAST(2.1 AS DOUBLE) + CAST(5.9 AS DOUBLE) * range / 39 FROM range(40)),
f AS (SELECT epoch, n, regr_slope(ln(value), pow(r, 1 / n)) AS slope, regr_intercept(ln(value), pow(r, 1 / n)) AS start, max(r) AS far FROM p, n WHERE value > 0 GROUP BY epoch, n HAVING count(*) >= 4),
g AS (SELECT *, pow(-{B_SQL} / slope, n) AS r_eff, exp(start - {B_SQL}) AS amplitude, {B_SQL} AS b FROM f WHERE slope < 0),
c AS (SELECT g.epoch, n, r_eff, amplitude, sum(pow(value - amplitude * exp(-b * (pow(r / r_eff, 1 / n) - 1)), 2)) AS chi2 FROM g JOIN p ON p.epoch = g.epoch AND value > 0 WHERE r_eff > 0 AND r_eff <= 10 * far GROUP BY ALL),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY round(chi2, 9), n) = 1)
SELECT e.epoch, n, r_eff, amplitude, chi2 FROM (SELECT DISTINCT epoch FROM pixels) e LEFT JOIN m ON m.epoch = e.epoch""", "n r_eff amplitude chi2")  # fmt: skip
def _(v):
    r = F.floor(F.hypot(F.col("x") - CENTRE, F.col("y") - CENTRE)) + 0.5
    profile = v.pixels.groupBy("epoch", r.alias("r")).agg(F.avg("value").alias("value"))
    return profiles.sersic_scan(profile, "epoch")


@query("join22_apertures")
def _(v):
    return profiles.aperture_fluxes(_placed(v), v.pixels, "epoch", 3.0, 5.0, 9.0)


@query("udf03_tiled_maxima", "pixels", """SELECT a.epoch, a.y, a.x, any_value(a.value) AS value FROM pixels a JOIN pixels b ON a.epoch = b.epoch AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
GROUP BY a.epoch, a.y, a.x HAVING any_value(a.value) > 50 AND max(b.value) <= any_value(a.value)""", "value")  # fmt: skip
def _(v):
    def maxima(part):
        import numpy as np

        y0, x0 = part["y"].min() - 1, part["x"].min() - 1
        grid = np.full((part["y"].max() - y0 + 2, part["x"].max() - x0 + 2), -np.inf)
        grid[part["y"] - y0, part["x"] - x0] = part["value"]
        around = np.max([np.roll(grid, (a, b), (0, 1)) for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        top = around[part["y"] - y0, part["x"] - x0]
        return part.loc[(part["value"] > 50) & (part["value"] >= top), ["epoch", "y", "x", "value"]]

    return profiles.per_tile(v.pixels.select("epoch", "y", "x", "value"), "epoch", 8, 2, maxima, "epoch long, y int, x int, value double")


BANDS = ["g", "r", "i", "z"]
SHIFTS = [0.0, 0.2, 0.5]
FILTER_ROWS = ", ".join(f"('{b}', CAST({photoz.FILTERS[b][0]} AS DOUBLE), CAST({photoz.FILTERS[b][1]} AS DOUBLE))" for b in BANDS)
THROUGH = "0.5 * (1 + tanh(({w} - (centre - 0.5 * width)) / (0.06 * width))) * 0.5 * (1 - tanh(({w} - (centre + 0.5 * width)) / (0.06 * width))) / {w}"


@query("model18_colour_grid", "spectra", f"""WITH t AS (SELECT spec_id, flux AS f1, 3000 + 100.0 * pix AS w1, lag(flux) OVER o AS f0, lag(3000 + 100.0 * pix) OVER o AS w0 FROM spectra WINDOW o AS (PARTITION BY spec_id ORDER BY pix)),
f(band, centre, width) AS (VALUES {FILTER_ROWS}), z AS (SELECT unnest([{', '.join(map(str, SHIFTS))}]::DOUBLE[]) AS z),
r AS (SELECT spec_id, z, band, f0, f1, w0 * (1 + z) AS a, w1 * (1 + z) AS b, centre, width FROM t, z, f WHERE w0 IS NOT NULL),
q AS (SELECT spec_id, z, band, (b - a) / 2 AS half, f0, f1, {THROUGH.format(w='a')} AS t0, {THROUGH.format(w='b')} AS t1 FROM r),
m AS (SELECT spec_id, z, band, sum(half * (f0 * t0 + f1 * t1)) AS top, sum(half * (t0 + t1)) AS bottom FROM q GROUP BY ALL),
k AS (SELECT spec_id, z, band, CASE WHEN top > 0 AND bottom > 0 THEN -2.5 * log10(top / bottom) END AS mag FROM m)
SELECT spec_id AS template, z, max(mag) FILTER (band = 'g') - max(mag) FILTER (band = 'r') AS g_r, max(mag) FILTER (band = 'r') - max(mag) FILTER (band = 'i') AS r_i, max(mag) FILTER (band = 'i') - max(mag) FILTER (band = 'z') AS i_z FROM k GROUP BY ALL""", "z g_r r_i i_z")  # fmt: skip
def _(v):
    templates = v.spectra.select(F.col("spec_id").alias("template"), (3000 + 100.0 * F.col("pix")).alias("wavelength"), "flux")
    return photoz.colour_grid(templates, SHIFTS, BANDS)


@query("model20_emission_redshift")
def _(v):
    rows = v.spectra.select("spec_id", (3600 + 60.0 * F.col("pix")).alias("wavelength"), "flux", "pix", "error")
    middle = S.continuum(rows, 50, 1).select("spec_id", "pix", "continuum")
    flat = rows.join(middle, ["spec_id", "pix"]).select("spec_id", "wavelength", (F.col("flux") / F.nullif("continuum", F.lit(0.0)) - 1).alias("excess"))
    return S.emission_redshift(flat)


AT_03 = f"(SELECT {DC_SQL} AS d FROM (SELECT CAST(0.3 AS DOUBLE) AS z))"


@query("agg06_luminosity_function", "sources", f"""WITH d AS {AT_03}, c AS (SELECT CAST(floor((25 - 2.5 * log10(flux) - (SELECT 5 * log10(d * 1.3 * 1e5) FROM d)) / 0.5) AS BIGINT) AS k, count(*) AS n0 FROM sources WHERE flux > 0 GROUP BY k),
b AS (SELECT unnest(range((SELECT min(k) FROM c), (SELECT max(k) FROM c) + 1)) AS k)
SELECT b.k * 0.5 AS bin, coalesce(n0, 0) AS n, 1e6 * coalesce(n0, 0) / ((SELECT 4.0 / 3 * pi() * pow(d, 3) * 100 / 41252.96 FROM d) * 0.5) AS phi FROM b LEFT JOIN c ON b.k = c.k""", "bin phi")  # fmt: skip
def _(v):
    return population.luminosity_function(v.sources, magnitude(F.col("flux")), 0.3, 100.0, COSMOS).withColumn("phi", F.col("phi") * 1e6)


@query("agg55_annotate", "sources", f"""WITH s AS (SELECT *, CASE WHEN source_id % 4 <> 0 THEN redshift END AS photoz FROM sources), a AS (SELECT *, coalesce(photoz, CASE WHEN class = 'galaxy' THEN CAST(0.1 AS DOUBLE) END) AS z FROM s),
g AS (SELECT z, {DC_SQL} AS d, 977.79 / 70 * {_SIMPSON.format(f='((1 + z / 512 * i) * ' + _E + ')')} AS lookback FROM (SELECT DISTINCT z FROM a WHERE z > 0))
SELECT source_id, a.z, CASE WHEN photoz IS NOT NULL THEN CASE WHEN source_id % 3 <> 0 THEN 'photometric' ELSE 'photometric_unreliable' END WHEN class = 'galaxy' THEN 'assumed_nominal' END AS redshift_source,
2 * semi_major * 0.4 AS angular_arcsec, 2 * semi_major * 0.4 * d / (1 + a.z) * 1000 * pi() / 648000 AS size_kpc, 25 - 2.5 * log10(flux) - 5 * log10(d * (1 + a.z) * 1e5) AS absolute_mag, lookback AS lookback_gyr FROM a LEFT JOIN g ON g.z = a.z""", "z angular_arcsec size_kpc absolute_mag lookback_gyr")  # fmt: skip
def _(v):
    rows = v.sources.withColumns({"photoz": F.when(F.col("source_id") % 4 != 0, F.col("redshift")), "reliable": F.col("source_id") % 3 != 0})
    out = population.annotate(rows, COSMOS, 0.4, F.col("class") == "galaxy", magnitude(F.col("flux")), None, 0.1)
    return out.select("source_id", "z", "redshift_source", "angular_arcsec", "size_kpc", "absolute_mag", "lookback_gyr")


@query("agg50_average_precision")
def _(v):
    b = v.boxes.select(F.col("box_id").alias("id"), "frame_id", "x_min", "y_min", "x_max", "y_max")
    shift = F.col("id") % 7
    truth = b.select("id", "frame_id", *[(F.col(c) + shift).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])
    best = match.greedy_overlaps(b, truth, 16.0, 0.5)
    return population.average_precision(v.boxes.select(F.col("box_id").alias("id"), "score"), best.select(F.col("a_id").alias("id")), truth.count())


@query("src16_series_frames", "pixels", """WITH f AS (SELECT epoch, min(mjd) AS mjd, max(y) + 1 AS ny, max(x) + 1 AS nx, count(*) AS n FROM pixels GROUP BY epoch), r AS (SELECT *, row_number() OVER (ORDER BY mjd, epoch) AS position FROM f)
SELECT *, (ny, nx, n) = (SELECT (ny, nx, n) FROM r WHERE position = 1) AS consistent FROM r""", "mjd")  # fmt: skip
def _(v):
    return tables.series_frames(v.pixels).withColumn("position", F.col("position").cast("long"))


@query("src17_survey_planes", "pixels", """SELECT epoch, count(*) AS n, CAST(count(*) FILTER ((x * y) & 5 <> 0 OR (x + y) % 5 - 1 <= 0 OR value >= 200) AS BIGINT) AS n_bad,
sum(CASE WHEN (x + y) % 5 - 1 > 0 THEN 1 / sqrt((x + y) % 5 - 1) END) AS total_sigma FROM pixels GROUP BY epoch""", "total_sigma")  # fmt: skip
def _(v):
    keys = ["epoch", "y", "x"]
    mask = v.pixels.select(*keys, (F.col("x") * F.col("y")).alias("bits"))
    weight = v.pixels.select(*keys, ((F.col("x") + F.col("y")) % 5 - 1.0).alias("noise"))
    rows = tables.survey_planes(v.pixels.select(*keys, "value"), keys, mask, weight, "weight", 5, 200.0)
    return rows.groupBy("epoch").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.sum("sigma").alias("total_sigma"))


@query("src11_snapshot", "reference_objects", "SELECT ref_id, mag_r FROM reference_objects WHERE ref_id % 3 = 2", "mag_r")
def _(v):
    rows = v.reference_objects.select("ref_id", "mag_r", (60000 + 10.0 * (F.col("ref_id") % 3)).alias("snapshot_mjd"))
    return tables.newest_snapshot(rows, 30.0, 60045.0).select("ref_id", "mag_r")


WEIGHTS = {"star": (2.0, -1.0, 0.5), "galaxy": (-1.0, 1.5, 0.2), "artefact": (0.1, 0.3, -0.4)}
LOGITS = {c: f"({a} * gini + {b} * m20 + {d} * concentration)" for c, (a, b, d) in WEIGHTS.items()}
TOTAL = " + ".join(f"exp({x})" for x in LOGITS.values())


@query("udf04_scores", "sources", "SELECT source_id, " + ", ".join(f"exp({x}) / ({TOTAL}) AS {c}" for c, x in LOGITS.items()) + " FROM sources", "star galaxy artefact")
def _(v):
    def predict(x):
        import numpy as np

        e = np.exp(x @ np.array(list(WEIGHTS.values())).T)
        return e / e.sum(axis=1, keepdims=True)

    return learn.score_rows(v.sources, "source_id", ["gini", "m20", "concentration"], predict, list(WEIGHTS))


@query("agg59_linear_probe")
def _(v):
    rows = v.embeddings.select(F.crc32(F.col("vec_id").cast("string").cast("binary")).alias("h"), F.col("embedding").alias("x"), "label")
    return learn.linear_probe(rows.filter("h % 5 <> 0").drop("h"), rows.filter("h % 5 = 0").drop("h"))


@query("str02_distinct_alerts", "detections", "SELECT detection_id AS candid, any_value(flux) AS flux FROM detections GROUP BY detection_id", "flux")
def _(v):
    folder = shared_folder(v.spark)
    rows = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").select(F.col("event_id").alias("candid"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("flux"))
    twice = rows.unionByName(rows.filter("candid % 3 = 0"))
    twice.write.parquet(f"{folder}/in")
    stream = v.spark.readStream.schema(twice.schema).parquet(f"{folder}/in")
    kept = jobs.distinct_alerts(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    kept.awaitTermination()
    return v.spark.read.schema(twice.schema).parquet(f"{folder}/out").select("candid", "flux")


@query("agg28_field_growth")
def _(v):
    """The growth curve of every frame from its brightest placed sources; a frame is 20 pixels wide, so stars reach a fifth of that."""
    light = v.sources.select("source_id", (F.col("flux") / F.col("flux_err")).alias("snr"))
    stars = _placed(v).join(light, "source_id").select("epoch", F.col("source_id").alias("star"), F.col("sx").alias("x"), F.col("sy").alias("y"), "snr")
    return growth.growth_curve(growth.star_curves(stars, v.pixels, "epoch", 4.0), "epoch")


def _colours(v):
    """Two colours, a stellarity and the signal to noise of every object with light in g, r and i."""
    mean = v.detections.filter("flux > 0").groupBy(F.col("object_truth").alias("id")).pivot("band", ["g", "r", "i"]).agg(F.avg("flux"))
    snr = v.detections.filter("flux > 0").groupBy(F.col("object_truth").alias("id")).agg(F.avg(F.col("flux") / F.col("flux_err")).alias("snr"))
    rows = mean.filter("g IS NOT NULL AND r IS NOT NULL AND i IS NOT NULL").join(snr, "id")
    return rows.select("id", (-2.5 * F.log10(F.col("g") / F.col("r"))).alias("x"), (-2.5 * F.log10(F.col("r") / F.col("i"))).alias("y"), (F.pmod(F.col("id") * 7, F.lit(11)) / 10.0).alias("stellarity"), "snr")


_COLOURS = """m AS (SELECT object_truth AS id, avg(flux) FILTER (band = 'g') AS g, avg(flux) FILTER (band = 'r') AS r, avg(flux) FILTER (band = 'i') AS i, avg(flux / flux_err) AS snr FROM detections WHERE flux > 0 GROUP BY object_truth),
c AS (SELECT id, -2.5 * log10(g / r) AS x, -2.5 * log10(r / i) AS y, ((id * 7) % 11) / 10.0 AS stellarity, snr FROM m WHERE g IS NOT NULL AND r IS NOT NULL AND i IS NOT NULL),
grid AS (SELECT list(-2.6 + 5.2 / 127 * range) AS gx FROM range(128)),
d AS (SELECT id, x, y, stellarity, log10(snr) AS key, list_min(list_transform(gx, lambda a: sqrt(pow(a - x, 2) + pow(0.1 - 0.2 * a - y, 2)))) AS d FROM c, grid)"""


@query("agg42_stellar_locus")
def _(v):
    found = locus.fit_locus(_colours(v))
    rows = [(i, float(c), found.n_stars, found.low, found.high, found.scatter) for i, c in enumerate(found.coefficients)] if found else []
    return v.spark.createDataFrame(rows, "term int, coefficient double, n_stars long, low double, high double, scatter double")


@query("agg43_population_widths", "detections", f"""WITH {_COLOURS}, k AS (SELECT *, CASE WHEN stellarity >= 0.6 THEN 1 WHEN stellarity <= 0.3 THEN 0 END AS star FROM d), e AS (SELECT quantile_cont(key, [0.0, 1.0 / 3, 2.0 / 3, 1.0]) AS q FROM k WHERE star = 1),
b AS (SELECT k.*, CASE WHEN key > q[1] - 1e-6 AND key <= q[2] THEN 0 WHEN key > q[2] AND key <= q[3] THEN 1 WHEN key > q[3] AND key <= q[4] THEN 2 END AS bin FROM k, e WHERE star IS NOT NULL),
l AS (SELECT star, bin, quantile_cont(d, 0.9) AS lim, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL)
SELECT b.star, b.bin, sqrt(avg(b.d * b.d) / 2) AS width, any_value(l.n) AS n FROM b JOIN l ON b.star = l.star AND b.bin = l.bin WHERE l.n < 5 OR b.d <= l.lim GROUP BY ALL""", "width")  # fmt: skip
def _(v):
    """Widths about a given straight locus, in bins of the stars' signal to noise."""
    line = locus.Locus([-0.2, 0.1], -2.0, 2.0)
    star = F.when(F.col("stellarity") >= locus.STAR, 1).when(F.col("stellarity") <= locus.GALAXY, 0)
    rows = _colours(v).select(line.distance(F.col("x"), F.col("y")).alias("d"), F.log10("snr").alias("key"), star.alias("star")).filter("star IS NOT NULL")
    q = quantiles.quantiles(rows.filter("star = 1"), "key", [0.0, 1 / 3, 2 / 3, 1.0])
    key = F.col("key")
    bins = F.when((key > q[0] - 1e-6) & (key <= q[1]), 0).when((key > q[1]) & (key <= q[2]), 1).when((key > q[2]) & (key <= q[3]), 2)
    return locus.rayleigh_widths(rows.withColumn("bin", bins).filter("bin IS NOT NULL"), ["star", "bin"])


@query("agg43_separation", "detections", f"""WITH {_COLOURS}, k AS (SELECT *, CASE WHEN stellarity >= 0.6 THEN 1 WHEN stellarity <= 0.3 THEN 0 END AS star FROM d),
w AS (SELECT star, d FROM k WHERE star IS NOT NULL),
p AS (SELECT star, 0.95 * d / pow(0.25, 2) * exp(-0.5 * pow(d / 0.25, 2)) + 0.05 * d / pow(1.4, 2) * exp(-0.5 * pow(d / 1.4, 2)) AS a, 0.95 * d / pow(0.35, 2) * exp(-0.5 * pow(d / 0.35, 2)) + 0.05 * d / pow(1.4, 2) * exp(-0.5 * pow(d / 1.4, 2)) AS b FROM w),
t AS (SELECT star, round(least(greatest(a / (a + b), 0.08), 0.92), 9) AS v FROM p),
u AS (SELECT v, count(*) FILTER (star = 1) AS s, count(*) FILTER (star = 0) AS g FROM t GROUP BY v), o AS (SELECT *, coalesce(sum(g) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM u)
SELECT sum(s * (below + 0.5 * g)) / (sum(s) * sum(g)) AS auc FROM o""", "auc")  # fmt: skip
def _(v):
    """How well colours of given widths tell stars from galaxies about a given locus."""
    line = locus.Locus([-0.2, 0.1], -2.0, 2.0, centres=[-9.0], star_width=[0.25], galaxy_width=[0.35])
    star = F.when(F.col("stellarity") >= locus.STAR, 1).when(F.col("stellarity") <= locus.GALAXY, 0)
    rows = _colours(v).select(F.round(line.stellarity(F.col("x"), F.col("y"), F.col("snr")), 9).alias("score"), star.alias("star")).filter("star IS NOT NULL AND score IS NOT NULL")
    return population.auc(rows, "score", "star")


@query("sca21_colour_stellarity", "detections", f"""WITH {_COLOURS}, p AS (SELECT id, d, 0.95 * d / pow(0.25, 2) * exp(-0.5 * pow(d / 0.25, 2)) + 0.05 * d / pow(1.4, 2) * exp(-0.5 * pow(d / 1.4, 2)) AS a, 0.95 * d / pow(0.35, 2) * exp(-0.5 * pow(d / 0.35, 2)) + 0.05 * d / pow(1.4, 2) * exp(-0.5 * pow(d / 1.4, 2)) AS b FROM d)
SELECT id, d AS distance, least(greatest(a / (a + b), 0.08), 0.92) AS stellarity FROM p""", "distance stellarity")  # fmt: skip
def _(v):
    line = locus.Locus([-0.2, 0.1], -2.0, 2.0, centres=[-9.0], star_width=[0.25], galaxy_width=[0.35])
    x, y = F.col("x"), F.col("y")
    return _colours(v).select("id", line.distance(x, y).alias("distance"), line.stellarity(x, y, F.col("snr")).alias("stellarity"))


@query("model33_catalog_photometry")
def _(v):
    """Every placed source; frames are 20 pixels wide, so radii and ring are small, and the frame's own growth curve corrects."""
    light = v.sources.select("source_id", (F.col("flux") / F.col("flux_err")).alias("snr"), "area_pixels")
    placed = _placed(v).join(light, "source_id")
    stars = placed.select("epoch", F.col("source_id").alias("star"), F.col("sx").alias("x"), F.col("sy").alias("y"), "snr")
    curve = growth.growth_curve(growth.star_curves(stars, v.pixels, "epoch", 4.0), "epoch").select("epoch", "radius", "enclosed")
    out = photometer.measure(placed.drop("snr"), v.pixels, "epoch", curve, radii=(2.0, 3.0), primary=3.0, ring=(5.0, 9.0))
    return out.withColumn("flags", F.concat_ws("|", "flags"))
