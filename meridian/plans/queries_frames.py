"""Queries of frame measurements: backgrounds, subtraction, calibration, profiles, rings and cut-outs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frames as R
from ..operators import linking
from ..operators import pixels as P
from ..operators import spectra as S
from .queries_tables import MAG
from .registry import query

CENTRE = 9.5
#: Wavelengths looked for in every spectrum.
SKY_LINES = [4010.0, 4050.0, 4060.0, 4100.0, 4150.0]
R_SQL = "sqrt(pow(x - 9.5, 2) + pow(y - 9.5, 2))"


def clip_sql(source: str, keys: str, name: str, rounds: int = 5) -> str:
    """CTEs: ``name`` holds the rows of ``source`` that five clipping rounds keep, ``name_s`` their statistics by ``keys``."""
    out, now = [], source
    for i in range(rounds):
        to = name if i == rounds - 1 else f"{name}_{i}"
        out.append(f"{name}_m{i} AS (SELECT *, median(value) OVER w AS m_, stddev_pop(value) OVER w AS sd_ FROM {now} WINDOW w AS (PARTITION BY {keys}))")
        out.append(f"{name}_d{i} AS (SELECT *, 1.4826 * median(abs(value - m_)) OVER (PARTITION BY {keys}) AS s_ FROM {name}_m{i})")
        out.append(f"{to} AS (SELECT * EXCLUDE (m_, sd_, s_) FROM {name}_d{i} WHERE abs(value - m_) <= 3 * CASE WHEN s_ > 0 THEN s_ ELSE sd_ END OR CASE WHEN s_ > 0 THEN s_ ELSE sd_ END = 0)")
        now = to
    stats = f"SELECT {keys}, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, count(*) AS kept FROM {name} GROUP BY {keys}"
    out.append(f"{name}_s AS (SELECT *, CASE WHEN abs(mean - median) > 0.3 * std THEN median ELSE 2.5 * median - 1.5 * mean END AS mode FROM ({stats}))")
    return ", ".join(out)


VALID = "ok AS (SELECT * FROM pixels WHERE value IS NOT NULL AND NOT isnan(value) AND NOT bad)"
PLACED = "placed AS (SELECT source_id, source_id % (SELECT max(epoch) + 1 FROM pixels) AS epoch, x - 20 * floor(x / 20) AS sx, y - 20 * floor(y / 20) AS sy, semi_major FROM sources)"
MESH = f"""{VALID}, boxed AS (SELECT *, y // 5 AS by_, x // 5 AS bx_ FROM ok), {clip_sql("boxed", "epoch, by_, bx_", "c")},
mesh AS (SELECT a.epoch, a.by_, a.bx_, any_value(a.std) AS noise, median(b.mode) AS level FROM c_s a JOIN c_s b ON a.epoch = b.epoch AND abs(a.by_ - b.by_) <= 1 AND abs(a.bx_ - b.bx_) <= 1 GROUP BY ALL)"""
REFERENCE = "ref AS (SELECT y, x, median(value) AS ref FROM pixels GROUP BY y, x)"
SCALE = f"""{REFERENCE}, {clip_sql("pixels", "epoch", "a")}, one AS (SELECT 1 AS k, ref AS value FROM ref), {clip_sql("one", "k", "b")},
both_ AS (SELECT p.epoch, p.value, ref, least(p.value / a_s.std, ref / b_s.std) AS above FROM pixels p JOIN ref ON p.y = ref.y AND p.x = ref.x JOIN a_s ON a_s.epoch = p.epoch, b_s),
good AS (SELECT * FROM (SELECT *, CASE WHEN count(*) FILTER (above > 10) OVER w >= 25 THEN 10 WHEN count(*) FILTER (above > 3) OVER w >= 10 THEN 3 END AS lim FROM both_ WINDOW w AS (PARTITION BY epoch)) WHERE above > lim),
s0 AS (SELECT epoch, sum(value * ref) / greatest(sum(ref * ref), 1e-12) AS s0 FROM good GROUP BY epoch),
r0 AS (SELECT good.*, value - s0 * ref AS res FROM good JOIN s0 ON good.epoch = s0.epoch), r1 AS (SELECT *, abs(res - median(res) OVER (PARTITION BY epoch)) AS off_ FROM r0),
r2 AS (SELECT *, 1.4826 * median(off_) OVER (PARTITION BY epoch) AS spread FROM r1),
s1 AS (SELECT epoch, CASE WHEN count(*) >= 10 THEN sum(value * ref) / greatest(sum(ref * ref), 1e-12) END AS s1 FROM r2 WHERE off_ < 3 * spread GROUP BY epoch),
scales AS (SELECT a_s.epoch, least(greatest(coalesce(s1, s0, 1), 0.05), 20) AS scale FROM a_s LEFT JOIN s0 ON a_s.epoch = s0.epoch LEFT JOIN s1 ON a_s.epoch = s1.epoch)"""
MODES = f"""modes AS (SELECT epoch, ring, mode, CASE WHEN abs(sum(value)) > 1e-12 THEN sqrt(pow(sum(value * cos(mode * a)), 2) + pow(sum(value * sin(mode * a)), 2)) / abs(sum(value)) ELSE 0 END AS amplitude, atan2(-sum(value * sin(mode * a)), sum(value * cos(mode * a))) AS phase
FROM (SELECT epoch, value, CAST(floor({R_SQL}) AS BIGINT) AS ring, atan2(y - 9.5, x - 9.5) AS a, CAST(unnest(range(7)) AS INTEGER) AS mode FROM pixels) GROUP BY ALL)"""
SMOOTH = f"""binned AS (SELECT *, least(CAST(floor({R_SQL} / (13.435 / 40)) AS BIGINT), 39) AS bin FROM pixels),
smooth AS (SELECT epoch, y, x, value - CASE WHEN count(*) OVER w >= 4 THEN quantile_cont(value, 0.25) OVER w ELSE 0 END AS value FROM binned WINDOW w AS (PARTITION BY epoch, bin))"""
REGIONS = """on_ AS (SELECT epoch, y, x, value, epoch * 1000000 + y * 1000 + x AS id FROM pixels WHERE value > 60),
e AS (SELECT a.id AS a, b.id AS b FROM on_ a JOIN on_ b ON a.epoch = b.epoch AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r(id, l) AS (SELECT id, id FROM on_ UNION SELECT e.b, r.l FROM r JOIN e ON r.id = e.a WHERE r.l < e.b),
lab AS (SELECT on_.*, label FROM on_ JOIN (SELECT id, min(l) AS label FROM r GROUP BY id) g ON on_.id = g.id)"""


def _placed(v):
    """Each source in one frame, its position folded into the frame."""
    frames = v.pixels.agg((F.max("epoch") + 1).alias("frames"))
    fold = lambda c: F.col(c) - 20 * F.floor(F.col(c) / 20)
    return v.sources.join(F.broadcast(frames)).select("source_id", (F.col("source_id") % F.col("frames")).alias("epoch"), fold("x").alias("sx"), fold("y").alias("sy"), "semi_major")


def _reference(v):
    return P.stack(v.pixels).select("y", "x", F.col("value").alias("ref"))


@query("agg12_mode_estimate", "pixels", f"WITH {VALID}, {clip_sql('ok', 'epoch', 'c')} SELECT * FROM c_s", "mean median std mode")
def _(v):
    return P.clipped_statistics(P.valid(v.pixels), "epoch")


@query("agg13_background_mesh", "pixels", f"WITH {MESH} SELECT epoch, CAST(by_ AS BIGINT) AS by, CAST(bx_ AS BIGINT) AS bx, level, noise FROM mesh", "level noise")
def _(v):
    return R.background_mesh(P.valid(v.pixels), "epoch", 5)


@query("agg13_background", "pixels", f"""WITH {MESH}, mid AS (SELECT epoch, median(level) AS middle FROM mesh GROUP BY epoch), t AS (SELECT epoch, y, x, (y + 0.5) / 5 - 0.5 AS v, (x + 0.5) / 5 - 0.5 AS u FROM pixels),
k AS (SELECT t.*, dy, dx, (CASE WHEN dy = 1 THEN v - floor(v) ELSE 1 - v + floor(v) END) * (CASE WHEN dx = 1 THEN u - floor(u) ELSE 1 - u + floor(u) END) AS w, least(greatest(floor(v) + dy, 0), 3) AS cy, least(greatest(floor(u) + dx, 0), 3) AS cx FROM t, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx))
SELECT c.epoch, c.y, c.x, round(sum(w * coalesce(level, middle)) + 1e-9, 6) AS level FROM k c JOIN mid ON c.epoch = mid.epoch LEFT JOIN mesh ON mesh.epoch = c.epoch AND by_ = cy AND bx_ = cx GROUP BY c.epoch, c.y, c.x""", "level")  # fmt: skip
def _(v):
    return R.background(v.pixels, P.valid(v.pixels), "epoch", 5, 20, 20).withColumn("level", F.round(F.col("level") + 1e-9, 6))


@query("agg16_annulus_background", "sources pixels", f"""WITH {PLACED}, ring AS (SELECT s.source_id, s.epoch, p.value FROM placed s JOIN pixels p ON p.epoch = s.epoch AND sqrt(pow(p.x - sx, 2) + pow(p.y - sy, 2)) >= 5 AND sqrt(pow(p.x - sx, 2) + pow(p.y - sy, 2)) < 9), {clip_sql("ring", "source_id, epoch", "c")}
SELECT s.source_id, s.epoch, CASE WHEN kept >= 5 THEN median ELSE 0 END AS level, CASE WHEN kept >= 5 THEN std ELSE 0 END AS rms, CASE WHEN kept >= 5 THEN kept ELSE 0 END AS n FROM placed s LEFT JOIN c_s ON s.source_id = c_s.source_id AND s.epoch = c_s.epoch""", "level rms")  # fmt: skip
def _(v):
    return R.annulus_background(_placed(v), v.pixels, "epoch", 5.0, 9.0)


@query("agg17_image_statistics", "pixels", f"WITH {VALID}, {clip_sql('ok', 'epoch', 'c')}, w AS (SELECT epoch, min(value) AS min, max(value) AS max, count(*) AS count FROM ok GROUP BY epoch) SELECT w.*, mean, median, std FROM w JOIN c_s ON w.epoch = c_s.epoch", "min max mean median std")
def _(v):
    ok = P.valid(v.pixels)
    whole = ok.groupBy("epoch").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count"))
    return whole.join(P.clipped_statistics(ok, "epoch").select("epoch", "mean", "median", "std"), "epoch")


@query("agg19_flux_scale", "pixels", f"WITH {SCALE} SELECT * FROM scales", "scale")
def _(v):
    return R.flux_scale(v.pixels, _reference(v), "epoch")


@query("join21_subtraction", "pixels", f"""WITH {SCALE}, diff AS (SELECT p.epoch, p.y, p.x, p.value - scale * ref AS value, sqrt(rms * rms + pow(scale * 5, 2)) AS noise FROM pixels p JOIN ref ON p.y = ref.y AND p.x = ref.x JOIN scales ON scales.epoch = p.epoch), {clip_sql("diff", "epoch", "g")}
SELECT diff.epoch, y, x, value - median AS difference, noise FROM diff JOIN g_s ON diff.epoch = g_s.epoch""", "difference noise")  # fmt: skip
def _(v):
    return R.subtract(v.pixels, _reference(v).withColumn("ref_rms", F.lit(5.0)), "epoch")


@query("join20_calibration", "pixels", """WITH f AS (SELECT y, x, value / (SELECT median(value) FROM pixels WHERE epoch = 2) AS gain FROM pixels WHERE epoch = 2)
SELECT p.epoch, p.y, p.x, round(CASE WHEN gain > 1e-3 THEN (p.value - b.value - d.value * 0.1) / gain END, 3) AS value FROM pixels p JOIN pixels b ON b.epoch = 0 AND b.y = p.y AND b.x = p.x JOIN pixels d ON d.epoch = 1 AND d.y = p.y AND d.x = p.x JOIN f ON f.y = p.y AND f.x = p.x""", "value")  # fmt: skip
def _(v):
    one = [v.pixels.filter(F.col("epoch") == k) for k in range(3)]
    return R.calibrate(v.pixels, *one, 0.1).select("epoch", "y", "x", F.round("value", 3).alias("value"))


@query("agg21_weighted_centroid", "pixels", "SELECT epoch, sum(greatest(value, 0) * x) / nullif(sum(greatest(value, 0)), 0) AS cx, sum(greatest(value, 0) * y) / nullif(sum(greatest(value, 0)), 0) AS cy FROM pixels GROUP BY epoch", "cx cy")
def _(v):
    return P.moments(v.pixels, ["epoch"]).select("epoch", "cx", "cy")


@query("agg22_label_sizes", "pixels", f"""WITH RECURSIVE {REGIONS} SELECT epoch, label, count(*) AS size, row_number() OVER (PARTITION BY epoch ORDER BY label) AS number, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM lab GROUP BY epoch, label HAVING count(*) >= 2""")
def _(v):
    box = [f(c).alias(f"{c}_{n}") for c in ("y", "x") for n, f in (("min", F.min), ("max", F.max))]
    sizes = P.label(v.pixels, "epoch", 60.0, side=1000).groupBy("epoch", "label").agg(F.count("*").alias("size"), *box).filter("size >= 2")
    return sizes.withColumn("number", F.row_number().over(Window.partitionBy("epoch").orderBy("label")).cast("long"))


@query("agg39_arc_radius", "pixels", f"""WITH RECURSIVE {REGIONS}, arcs AS (SELECT epoch, label, sum(value) AS f, sqrt(pow(sum(value * x) / sum(value) - 9.5, 2) + pow(sum(value * y) / sum(value) - 9.5, 2)) AS r FROM lab GROUP BY epoch, label),
m AS (SELECT *, sum(f * r) OVER w / sum(f) OVER w AS mean FROM arcs WINDOW w AS (PARTITION BY epoch)) SELECT epoch, any_value(mean) AS radius, sqrt(sum(f * pow(r - mean, 2)) / sum(f)) AS scatter FROM m GROUP BY epoch""", "radius scatter")  # fmt: skip
def _(v):
    arcs = P.moments(P.label(v.pixels, "epoch", 60.0, side=1000), ["epoch", "label"]).withColumn("r", F.hypot(F.col("cx") - CENTRE, F.col("cy") - CENTRE))
    w = Window.partitionBy("epoch")
    arcs = arcs.withColumn("mean", F.sum(F.col("flux") * F.col("r")).over(w) / F.sum("flux").over(w))
    return arcs.groupBy("epoch").agg(F.first("mean").alias("radius"), F.sqrt(F.sum(F.col("flux") * F.pow(F.col("r") - F.col("mean"), F.lit(2.0))) / F.sum("flux")).alias("scatter"))


@query("agg26_petrosian_radius", "pixels", f"""WITH k AS (SELECT range AS k, 0.5 + range * (11.5 / 59) AS edge FROM range(60)), p AS (SELECT epoch, value, {R_SQL} AS r FROM pixels WHERE {R_SQL} < 1.1 * 12.0),
t AS (SELECT epoch, k, edge, CASE WHEN count(*) FILTER (r >= edge * 0.9 AND r < edge * 1.1) >= 3 THEN avg(value) FILTER (r >= edge * 0.9 AND r < edge * 1.1) END AS loc, CASE WHEN count(*) FILTER (r < edge) >= 3 THEN avg(value) FILTER (r < edge) END AS mean FROM p, k GROUP BY ALL),
q AS (SELECT *, CASE WHEN abs(mean) > 1e-12 THEN loc / mean END AS ratio FROM t), o AS (SELECT *, lag(ratio) OVER w AS v0, lag(edge) OVER w AS r0 FROM q WINDOW w AS (PARTITION BY epoch ORDER BY k)),
b AS (SELECT epoch, k, CASE WHEN v0 IS NULL OR abs(v0 - ratio) < 1e-12 THEN edge ELSE r0 + (v0 - 0.9) / (v0 - ratio) * (edge - r0) END AS rad FROM o WHERE ratio <= 0.9)
SELECT q.epoch, CASE WHEN count(ratio) >= 3 THEN (SELECT arg_min(rad, k) FROM b WHERE b.epoch = q.epoch) END AS radius FROM q GROUP BY q.epoch""", "radius")  # fmt: skip
def _(v):
    return R.petrosian_radius(v.pixels, "epoch", CENTRE, CENTRE, 0.9, 12.0)


@query("agg35_fourier_modes", "pixels", f"WITH {MODES} SELECT epoch, ring, mode, amplitude, amplitude * cos(phase) AS re FROM modes", "amplitude re")
def _(v):
    return R.fourier_modes(v.pixels, "epoch", CENTRE, CENTRE).select("epoch", "ring", "mode", "amplitude", (F.col("amplitude") * F.cos("phase")).alias("re"))


@query("agg36_phase_winding", "pixels", f"""WITH {MODES}, j AS (SELECT *, coalesce(-round((phase - lag(phase) OVER w) / (2 * pi())), 0) AS turns FROM modes WHERE mode = 2 WINDOW w AS (PARTITION BY epoch ORDER BY ring)),
u AS (SELECT *, phase + 2 * pi() * sum(turns) OVER (PARTITION BY epoch ORDER BY ring) AS whole, ln(ring + 0.5) AS lr FROM j)
SELECT epoch, CASE WHEN count(*) >= 5 THEN regr_slope(whole, lr) ELSE 0 END AS slope, CASE WHEN count(*) >= 5 THEN regr_r2(whole, lr) ELSE 0 END AS r2 FROM u GROUP BY epoch""", "slope r2")  # fmt: skip
def _(v):
    return R.phase_winding(R.fourier_modes(v.pixels, "epoch", CENTRE, CENTRE).filter("mode = 2"), "epoch")


@query("agg38_smooth_light", "pixels", f"WITH {SMOOTH} SELECT * FROM smooth", "value")
def _(v):
    return R.subtract_smooth(v.pixels, "epoch", CENTRE, CENTRE, 13.435).select("epoch", "y", "x", "value")


@query("agg37_ring_completeness", "pixels", f"""WITH {SMOOTH}, {clip_sql("smooth", "epoch", "c")}, b AS (SELECT epoch, least(CAST(floor((atan2(y - 9.5, x - 9.5) + pi()) / (2 * pi()) * 36) AS BIGINT), 35) AS bin, avg(value) AS value FROM smooth WHERE abs({R_SQL} - 6) <= 2.5 GROUP BY ALL)
SELECT b.epoch, avg(CASE WHEN value > 1.5 * greatest(std, 1e-9) THEN 1.0 ELSE 0 END) AS completeness, avg(value / greatest(std, 1e-9)) AS significance FROM b JOIN c_s ON b.epoch = c_s.epoch GROUP BY b.epoch""", "completeness significance")  # fmt: skip
def _(v):
    rest = R.subtract_smooth(v.pixels, "epoch", CENTRE, CENTRE, 13.435)
    return R.ring_completeness(rest, "epoch", CENTRE, CENTRE, 6.0, 2.5, 36)


@query("prj12_cutouts", "sources pixels", f"WITH {PLACED} SELECT s.source_id, s.epoch, count(*) AS n, sum(value) AS flux FROM placed s JOIN pixels p ON p.epoch = s.epoch AND abs(p.x - sx) <= 8 AND abs(p.y - sy) <= 8 AND abs(p.x - sx) <= semi_major + 2 AND abs(p.y - sy) <= semi_major + 2 GROUP BY s.source_id, s.epoch", "flux")
def _(v):
    inside = [F.abs(F.col(c) - F.col(f"s{c}")) <= F.col("semi_major") + 2 for c in ("x", "y")]
    return R.near_pixels(_placed(v), v.pixels, "epoch", 8.0).filter(inside[0] & inside[1]).groupBy("source_id", "epoch").agg(F.count("*").alias("n"), F.sum("value").alias("flux"))


@query("prj13_saturation", "pixels", "WITH m AS (SELECT *, max(value) OVER (PARTITION BY epoch) AS peak FROM pixels), n AS (SELECT *, count(*) FILTER (value >= peak * 0.9999) OVER (PARTITION BY epoch) AS at_peak FROM m) SELECT epoch, y, x, at_peak >= 4 AND value >= 0.999 * peak AS saturated FROM n")
def _(v):
    w = Window.partitionBy("epoch")
    rows = v.pixels.withColumn("peak", F.max("value").over(w))
    rows = rows.withColumn("at_peak", F.count_if(F.col("value") >= F.col("peak") * 0.9999).over(w))
    return rows.select("epoch", "y", "x", ((F.col("at_peak") >= 4) & (F.col("value") >= 0.999 * F.col("peak"))).alias("saturated"))


@query("prj18_fill_invalid", "pixels", "WITH f AS (SELECT *, CASE WHEN NOT bad THEN value END AS v FROM pixels) SELECT epoch, y, x, coalesce(v, median(v) OVER (PARTITION BY epoch)) AS value FROM f", "value")
def _(v):
    good = F.when(~F.col("bad"), F.nanvl("value", F.lit(None).cast("double")))
    middle = v.pixels.groupBy("epoch").agg(F.median(good).alias("middle"))
    return v.pixels.join(middle, "epoch").select("epoch", "y", "x", F.coalesce(good, "middle").alias("value"))


@query("agg09_stellar_summary", "sources", f"""WITH s AS (SELECT source_id, x, y, fwhm, {MAG} AS m FROM sources WHERE class = 'star'), n AS (SELECT a.source_id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM s a JOIN s b ON a.source_id <> b.source_id GROUP BY a.source_id)
SELECT median(m) AS median_mag, max(m) - min(m) AS mag_range, median(d) AS median_nn, avg(CASE WHEN d < 2 * fwhm THEN 1.0 ELSE 0 END) AS crowding FROM s JOIN n ON s.source_id = n.source_id""", "median_mag mag_range median_nn crowding")  # fmt: skip
def _(v):
    s = v.sources.filter("class = 'star'").select(F.col("source_id").alias("id"), "x", "y", "fwhm", (25 - 2.5 * F.log10("flux")).alias("m"))
    d = linking.nearest_distances(s.select("id", "x", "y"), 64.0).select("id", "d")
    return s.join(d, "id").agg(F.median("m").alias("median_mag"), (F.max("m") - F.min("m")).alias("mag_range"), F.median("d").alias("median_nn"), F.avg((F.col("d") < 2 * F.col("fwhm")).cast("double")).alias("crowding"))


@query("set06_manifest_differences", "detections", """WITH m AS (SELECT field_id, band || '.' || key AS key, value FROM (SELECT field_id, band, unnest(['rows', 'objects']) AS key, unnest([count(*), count(DISTINCT object_truth)]) AS value FROM detections GROUP BY field_id, band))
SELECT coalesce(a.field_id, b.field_id - 1) AS field_id, coalesce(a.key, b.key) AS key, a.value AS was, b.value AS now FROM m a FULL JOIN m b ON a.field_id + 1 = b.field_id AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def _(v):
    per = v.detections.groupBy("field_id", "band").agg(F.count("*").alias("rows"), F.countDistinct("object_truth").alias("objects"))
    one = per.selectExpr("field_id", "band", "stack(2, 'rows', rows, 'objects', objects) AS (key, value)").withColumn("key", F.concat_ws(".", "band", "key")).drop("band")
    later = one.select((F.col("field_id") - 1).alias("field_id"), "key", F.col("value").alias("now"))
    both = one.withColumnRenamed("value", "was").join(later, ["field_id", "key"], "full")
    return both.filter(~F.col("was").eqNullSafe(F.col("now")))


@query("win16_normalise")
def _(v):
    rows = S.continuum(v.spectra, 10, 3)
    weak = F.col("continuum") < 3 * F.col("error")
    return rows.select("spec_id", "pix", F.when(weak, 1.0).otherwise(F.col("flux") / F.col("continuum")).alias("flux"), weak.alias("masked"))


@query("win17_sky_lines", "spectra", """WITH l AS (SELECT unnest([4010.0, 4050, 4060, 4100, 4150]) AS line), iso AS (SELECT line FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.line <> a.line AND abs(b.line - a.line) < 20)),
p AS (SELECT spec_id, line, wavelength, flux, median(flux) OVER w AS m, count(*) OVER w AS n FROM spectra JOIN iso ON abs(wavelength - line) < 15 WINDOW w AS (PARTITION BY spec_id, line)),
c AS (SELECT spec_id, line, sum(greatest(flux - m, 0) * wavelength) / sum(greatest(flux - m, 0)) - line AS shift FROM p WHERE n >= 5 GROUP BY spec_id, line HAVING sum(greatest(flux - m, 0)) > 0),
g AS (SELECT *, median(shift) OVER (PARTITION BY spec_id) AS middle FROM c WHERE abs(shift) <= 9)
SELECT spec_id, count(*) AS n_lines, median(shift) AS "offset", CASE WHEN count(*) > 2 THEN 1.4826 * median(abs(shift - middle)) END AS scatter, count(*) >= 3 AS reliable FROM g GROUP BY spec_id""", '"offset" scatter')  # fmt: skip
def _(v):
    lines = v.spark.createDataFrame([(x,) for x in SKY_LINES], "line double")
    return S.sky_line_offsets(v.spectra, lines, 15.0, 20.0)


@query("agg23_bad_lines", "pixels", f"""WITH {clip_sql("pixels", "epoch", "c")}, full_ AS (SELECT epoch FROM pixels GROUP BY epoch HAVING count(*) = 400), px AS (SELECT p.* FROM pixels p JOIN full_ ON p.epoch = full_.epoch),
long_ AS (SELECT epoch, 'x' AS axis, x AS line, value FROM px UNION ALL SELECT epoch, 'y', y, value FROM px), prof AS (SELECT epoch, axis, line, median(value) AS profile, count(*) AS n FROM long_ GROUP BY ALL),
taps AS (SELECT epoch, axis, line, n, profile, CASE WHEN line + d < 0 THEN -line - d - 1 WHEN line + d >= 20 THEN 39 - line - d ELSE line + d END AS src FROM prof, (SELECT unnest([-2, -1, 0, 1, 2]) AS d)),
res AS (SELECT t.epoch, t.axis, t.line, any_value(t.n) AS n, any_value(t.profile) - median(q.profile) AS value FROM taps t JOIN prof q ON t.epoch = q.epoch AND t.axis = q.axis AND t.src = q.line GROUP BY t.epoch, t.axis, t.line), {clip_sql("res", "epoch, axis", "m")},
cand AS (SELECT res.*, c_s.median AS med FROM res JOIN m_s ON res.epoch = m_s.epoch AND res.axis = m_s.axis JOIN c_s ON c_s.epoch = res.epoch WHERE c_s.std > 0 AND abs(res.value) > 3 * greatest(m_s.std, 1.2533 * c_s.std / sqrt(n)))
SELECT l.epoch, l.axis, l.line, avg(CASE WHEN (l.value - med) * sign(cand.value) > 0.5 * abs(cand.value) THEN 1.0 ELSE 0 END) AS share FROM long_ l JOIN cand ON l.epoch = cand.epoch AND l.axis = cand.axis AND l.line = cand.line GROUP BY l.epoch, l.axis, l.line HAVING avg(CASE WHEN (l.value - med) * sign(cand.value) > 0.5 * abs(cand.value) THEN 1.0 ELSE 0 END) >= 0.55""", "share")  # fmt: skip
def _(v):
    full = v.pixels.groupBy("epoch").count().filter("count = 400").select("epoch")
    return R.bad_lines(v.pixels.join(full, "epoch"), "epoch", 20, 3.0)
