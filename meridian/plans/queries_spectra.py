"""Queries of spectra, calibration fits and composed searches."""

from pyspark.sql import functions as F

from ..functions.columns import horner, magnitude
from ..operators import fit, linking, match
from ..operators import lines as L
from ..operators import pixels as P
from ..operators import redshift as Z
from ..operators import spectrum_analysis as A
from ..operators import transients
from ..operators import spectra as S
from .registry import query


@query("win15_running_median", "spectra", "SELECT spec_id, pix, quantile_cont(flux, 0.5) OVER (PARTITION BY spec_id ORDER BY pix ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS continuum FROM spectra", "continuum")
def _(v):
    return S.continuum(v.spectra, 10, 1).select("spec_id", "pix", "continuum")


@query("win15_continuum")
def _(v):
    return S.continuum(v.spectra, 10, 3).select("spec_id", "pix", "continuum")


PEAKS = """a AS (SELECT *, median(flux) OVER (PARTITION BY spec_id) AS m, lag(flux) OVER o AS f0, lead(flux) OVER o AS f2 FROM spectra WINDOW o AS (PARTITION BY spec_id ORDER BY pix)),
b AS (SELECT *, 1.4826 * median(abs(flux - m)) OVER (PARTITION BY spec_id) AS mad FROM a), p AS (SELECT spec_id, pix, wavelength, flux, pix + coalesce(0.5 * (f0 - f2) / nullif(f0 - 2 * flux + f2, 0), 0) AS centre FROM b WHERE flux - m > mad AND flux >= f0 AND flux > f2)"""


@query("win14_peaks", "spectra", f"WITH {PEAKS} SELECT spec_id, pix, centre, wavelength, flux FROM p", "centre wavelength flux")
def _(v):
    return S.peaks(v.spectra)


@query("join06_line_match", "spectra", f"""WITH {PEAKS}, l AS (SELECT 4000.0 + 37 * range AS line FROM range(60)),
q AS (SELECT spec_id, pix, line, abs(wavelength - line) AS off FROM p JOIN l ON abs(wavelength - line) <= 12), r AS (SELECT *, row_number() OVER (PARTITION BY spec_id, pix ORDER BY round(off, 9), line) AS i, row_number() OVER (PARTITION BY spec_id, line ORDER BY round(off, 9), pix) AS j FROM q)
SELECT spec_id, pix, line, off FROM r WHERE i = 1 AND j = 1""", "line off")  # fmt: skip
def _(v):
    lines = v.spark.range(60).select((4000.0 + 37 * F.col("id")).alias("line"))
    return S.match_lines(S.peaks(v.spectra), lines, 12.0)


@query("sca31_balmer", "sources", "SELECT source_id, CASE WHEN concentration > 2.86 THEN 2.5 / (3.61 - 2.53) * log10(concentration / 2.86) ELSE 0 END AS ebv FROM sources", "ebv")
def _(v):
    return v.sources.select("source_id", S.balmer_reddening(F.col("concentration")).alias("ebv"))


@query("agg41_zero_point")
def _(v):
    mags = v.detections.filter("band = 'r' AND flux > 0").groupBy(F.col("object_truth").alias("id")).agg(F.avg("ra").alias("ra"), F.avg("dec").alias("dec"), magnitude(F.avg("flux")).alias("mag"))
    near = match.nearest(match.sky_pairs(mags, v.reference_objects.select(F.col("ref_id").alias("id"), "ra", "dec"), 2.0))
    pairs = near.join(mags.withColumnRenamed("id", "a_id"), "a_id").join(v.reference_objects.select(F.col("ref_id").alias("b_id"), F.col("mag_r").alias("catalog_mag")), "b_id")
    zp, err, n = S.zero_point(pairs)
    return pairs.agg(F.count("*").alias("pairs")).select("pairs", F.lit(float(zp or 0)).alias("zero_point"), F.lit(float(err)).alias("error"), F.lit(int(n)).alias("kept"))


@query("model01_polynomial")
def _(v):
    c, scatter = fit.polynomial(v.sources, "concentration", "gini", 3)
    model = horner(F.col("concentration"), [float(x) for x in c])
    return v.sources.select("source_id", model.alias("fitted"), F.lit(scatter).alias("scatter"))


@query("model29_transient_search", "pixels", """WITH t AS (SELECT a.epoch, a.y, a.x, any_value(a.value) AS value, median(b.value) AS template FROM pixels a JOIN pixels b ON a.y = b.y AND a.x = b.x AND a.epoch <> b.epoch GROUP BY a.epoch, a.y, a.x)
SELECT epoch, y, x, value - template AS residual FROM t WHERE value - template > 60""", "residual")  # fmt: skip
def _(v):
    return P.hold_one_out(v.pixels).filter("residual > 60").select("epoch", "y", "x", "residual")


@query("model31_moving_objects")
def _(v):
    t = linking.moving_objects(v.epoch_detections)
    return t.select("tracklet_id", "n_points", "rms", "score", "chance", "chance_plausible")


def _long(v):
    """Spectra of 512 pixels cut from the detections, so that their number grows with the table."""
    pix = F.pmod("detection_id", F.lit(512))
    return v.detections.select(F.floor(F.col("detection_id") / 512).cast("long").alias("spec_id"), pix.alias("pix"), (3700 + 6.0 * pix).alias("wavelength"), "flux", F.col("flux_err").alias("error"))


def _templates(v):
    """Four of them as templates, the first a star, each moved to rest from a redshift of its own."""
    t = _long(v).filter("spec_id < 4")
    kind = F.when(F.col("spec_id") == 0, "star").otherwise("galaxy")
    wavelength = F.col("wavelength") / (1 + 0.02 * F.col("spec_id"))
    return t.select(F.concat(F.lit("t"), F.col("spec_id")).alias("template"), kind.alias("kind"), "pix", wavelength.alias("wavelength"), "flux", "error")


@query("model19_redshift")
def _(v):
    found = Z.redshifts(_long(v), _templates(v), (-0.005, 0.4))
    return found.withColumn("flags", F.concat_ws("|", "flags"))


@query("model21_line_fluxes")
def _(v):
    spectra = S.continuum(_long(v), 75, 4)
    known = spectra.select("spec_id").distinct().withColumn("z", F.pmod("spec_id", F.lit(7)) * 0.02)
    return L.fit_lines(spectra, known).withColumn("flags", F.concat_ws("|", "flags"))


@query("model23_line_votes", "spectra", f"""WITH {PEAKS}, l AS (SELECT 3990.0 + 13 * range + (range % 5) * 3 AS x FROM range(12)), c AS (SELECT list(x ORDER BY x) AS xs FROM l),
k AS (SELECT spec_id, list(centre ORDER BY centre) AS ps FROM p GROUP BY spec_id HAVING count(*) >= 2),
pair AS (SELECT spec_id, ps, i, j, ps[i + 1] AS p, ps[j + 1] AS q FROM (SELECT *, unnest(range(len(ps))) AS i FROM k), LATERAL (SELECT unnest(range(i + 1, len(ps))) AS j) WHERE ps[j + 1] - ps[i + 1] >= 0.15 * greatest(ps[len(ps)] - ps[1], 1)),
v AS (SELECT pair.*, a, b, (xs[b + 1] - xs[a + 1]) / (q - p) AS scale, xs[a + 1] - (xs[b + 1] - xs[a + 1]) / (q - p) * p AS shift, xs FROM pair, c, (SELECT range AS a FROM range(12)), (SELECT range AS b FROM range(12)) WHERE a < b),
w AS (SELECT *, list_filter(list_transform(ps, lambda y: list_min(list_transform(xs, lambda x: abs(scale * y + shift - x)))), lambda d: d < 4) AS close FROM v WHERE scale BETWEEN 0.2 AND 40),
r AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY len(close) DESC, round(coalesce(list_sum(close), 0), 9), i, j, a, b) AS r FROM w)
SELECT spec_id, scale, shift AS "offset", CAST(len(close) AS INTEGER) AS hits, coalesce(list_sum(close), 0) AS misfit FROM r WHERE r = 1""", "scale offset misfit".replace("offset", '"offset"'))  # fmt: skip
def _(v):
    lines = [3990.0 + 13 * i + (i % 5) * 3 for i in range(12)]
    return L.vote_linear(S.peaks(v.spectra).select("spec_id", "centre"), lines, 4.0)


@query("model24_dispersion")
def _(v):
    known = _long(v).select("spec_id").distinct().withColumn("z", F.pmod("spec_id", F.lit(4)) * 0.02)
    return Z.dispersions(_long(v), known, _templates(v).filter("template = 't1'"))


@query("model29_transient_candidates")
def _(v):
    """Whole chain: subtraction, labels, stamps, scores and merged candidates of all epochs."""
    return transients.search(v.pixels)


@query("model22_supernova_types")
def _(v):
    """The long spectra against six of them as templates of three types; every other one has a host's redshift."""
    t = _long(v).filter("spec_id < 6").select(F.concat(F.lit("T"), F.pmod("spec_id", F.lit(3))).alias("type"), (F.floor(F.col("spec_id") / 3) * 15.0).alias("phase"), "pix", "wavelength", "flux", "error")
    hosts = _long(v).select("spec_id").distinct().withColumn("z", F.when(F.col("spec_id") % 2 == 0, 0.0))
    return A.classify_supernovae(_long(v), hosts, t)


@query("model35_spectrum_analysis")
def _(v):
    found = A.analyse(_long(v), _templates(v), early="t1", z_range=(-0.005, 0.4))
    return found.withColumn("flags", F.concat_ws("|", "flags"))
