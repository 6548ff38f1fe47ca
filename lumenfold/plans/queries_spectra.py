"""Queries over recorded spectra: backgrounds, smoothing, peaks, gates, regions, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold import fixed_values as fv
from lumenfold import schemas
from lumenfold.functions.scalars import rnd
from lumenfold.operators import background as bg
from lumenfold.operators import peaks as pk
from lumenfold.operators import points as pt
from lumenfold.operators import quality as ql
from lumenfold.operators import regions as rg
from lumenfold.operators import resample as rs
from lumenfold.operators import smooth as sm
from lumenfold.plans.bindings import KEYS, PTS, labelled, recorded_points
from lumenfold.plans.registry import query

DEFS_SQL = "defs(region, e_min, e_max, typical_be) AS (VALUES " + ", ".join(
    f"('{r}', CAST({v[0]} AS DOUBLE), CAST({v[1]} AS DOUBLE), CAST({v[2]} AS DOUBLE))"
    for r, v in fv.REGION_DEFINITIONS.items()) + ")"


def packed(spark, sf):
    return pt.pack(recorded_points(spark, sf), KEYS)


# ---- shapes -----------------------------------------------------------------

@query("shape_pack_unpack", f"""WITH {PTS}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, i, round(energy, 4) + 0e0 AS energy, round(intensity, 6) + 0e0 AS intensity FROM pts""")
def shape_pack_unpack(spark, sf):
    z = pt.unpack(packed(spark, sf))
    return z.select(*KEYS, "i", rnd("energy", 4).alias("energy"), rnd("intensity", 6).alias("intensity"))


# ---- areas and integrals ----------------------------------------------------

@query("seq_trapezoid_area", f"""WITH {PTS}, seg AS (SELECT instrument, sweep,
  (energy - lag(energy) OVER w) * (intensity + lag(intensity) OVER w) / 2 AS s FROM pts WINDOW w AS (PARTITION BY instrument, sweep ORDER BY i))
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, round(abs(coalesce(sum(s), 0e0)), 6) + 0e0 AS area FROM seg GROUP BY 1, 2""")
def seq_trapezoid_area(spark, sf):
    return pt.trapezoid(recorded_points(spark, sf), KEYS).select(*KEYS, rnd("area", 6).alias("area"))


@query("seq_trapezoid_area_packed", f"""WITH {PTS}, seg AS (SELECT instrument, sweep,
  (energy - lag(energy) OVER w) * (intensity + lag(intensity) OVER w) / 2 AS s FROM pts WINDOW w AS (PARTITION BY instrument, sweep ORDER BY i))
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, round(abs(coalesce(sum(s), 0e0)), 6) + 0e0 AS area FROM seg GROUP BY 1, 2""")
def seq_trapezoid_area_packed(spark, sf):
    return packed(spark, sf).select(*KEYS, rnd(pt.array_trapezoid(F.col("energy"), F.col("intensity")), 6).alias("area"))


@query("seq_integral_to_end", f"""WITH {PTS}, seg AS (SELECT *, coalesce((lead(energy) OVER w - energy) * (intensity + lead(intensity) OVER w) / 2, 0e0) AS s
  FROM pts WINDOW w AS (PARTITION BY instrument, sweep ORDER BY i))
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, i, round(sum(s) OVER (PARTITION BY instrument, sweep ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0e0 AS integral FROM seg""")
def seq_integral_to_end(spark, sf):
    d = bg.integral_to_end(recorded_points(spark, sf), KEYS, "energy", "intensity", "integral")
    return d.select(*KEYS, "i", rnd("integral", 6).alias("integral"))


# ---- backgrounds ------------------------------------------------------------

def shirley_sql(steps: int, clamp: bool = True) -> str:
    """CTEs ending in sh(instrument, sweep, sample, region, layer, i, energy, intensity, b)."""
    w = "(PARTITION BY instrument, sweep ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    o = "(PARTITION BY instrument, sweep ORDER BY i)"
    g = "(PARTITION BY instrument, sweep)"
    text = f""",
s_n AS (SELECT *, count(*) OVER {g} AS n FROM pts),
s_m AS (SELECT *, greatest(1, least(7, n // 5)) AS m FROM s_n),
s_e AS (SELECT *, avg(CASE WHEN i < m THEN intensity END) OVER {g} AS yl, avg(CASE WHEN i >= n - m THEN intensity END) OVER {g} AS yr FROM s_m),
b0 AS (SELECT *, CASE WHEN n > 1 THEN yl + (yr - yl) * i / (n - 1) ELSE yl END AS b FROM s_e)"""
    for k in range(steps):
        text += f""",
g{k} AS (SELECT *, intensity - b AS d, coalesce((lead(energy) OVER {o} - energy) * (intensity - b + lead(intensity - b) OVER {o}) / 2, 0e0) AS seg FROM b{k}),
t{k} AS (SELECT *, sum(seg) OVER {w} AS s FROM g{k}),
z{k} AS (SELECT *, max(CASE WHEN i = 0 THEN s END) OVER {g} AS s0 FROM t{k}),
b{k + 1} AS (SELECT * EXCLUDE (b, d, seg, s, s0), yr + (yl - yr) / (s0 + 1e-15) * s AS b FROM z{k})"""
    last = "least(b, intensity)" if clamp else "b"
    return text + f""",
sh AS (SELECT * EXCLUDE (b), {last} AS b FROM b{steps})"""


#: The background iterated until it stands still; needs WITH RECURSIVE. Ends in sh like `shirley_sql`.
CONVERGED_SQL = """,
cg AS (SELECT instrument, sweep, list(energy ORDER BY i) AS x, list(intensity ORDER BY i) AS y, count(*) AS n, greatest(1, least(7, count(*) // 5)) AS m FROM pts GROUP BY 1, 2),
ce AS (SELECT *, list_avg(y[1:m]) AS yl, list_avg(y[n - m + 1:n]) AS yr FROM cg),
it AS (SELECT instrument, sweep, 0 AS k, false AS done, list_transform(range(n), lambda j: CASE WHEN n > 1 THEN yl + (yr - yl) * j / (n - 1) ELSE yl END) AS b FROM ce
UNION ALL
SELECT instrument, sweep, k + 1, sqrt(list_sum(list_transform(range(1, n + 1), lambda j: pow(nb[j] - b[j], 2)))) / (sqrt(list_sum(list_transform(b, lambda v: v * v))) + 1e-15) < 1e-6, nb
FROM (SELECT *, list_transform(s, lambda v: yr + (yl - yr) * v / (s[1] + 1e-15)) AS nb
  FROM (SELECT *, list_transform(range(1, n + 1), lambda j: coalesce(list_sum(seg[j:]), 0e0)) AS s
    FROM (SELECT it.*, e.n, e.yl, e.yr, list_transform(range(1, e.n), lambda j: (e.x[j + 1] - e.x[j]) * ((e.y[j] - it.b[j]) + (e.y[j + 1] - it.b[j + 1])) / 2) AS seg
      FROM it JOIN ce AS e ON it.instrument = e.instrument AND it.sweep = e.sweep WHERE NOT it.done AND it.k < 100)))),
sh AS (SELECT p.* , least(l.b[p.i + 1], p.intensity) AS b FROM (SELECT instrument, sweep, arg_max(b, k) AS b FROM it GROUP BY 1, 2) l JOIN pts p ON l.instrument = p.instrument AND l.sweep = p.sweep)"""


@query("background_shirley", f"""WITH {PTS}{shirley_sql(5)}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, i, round(b, 5) + 0e0 AS background FROM sh""")
def background_shirley(spark, sf):
    d = bg.shirley_steps(recorded_points(spark, sf), KEYS, 5)
    return d.select(*KEYS, "i", rnd("background", 5).alias("background"))


@query("background_shirley_local", f"""WITH {PTS}{shirley_sql(5, False)}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, i, round(b, 5) + 0e0 AS background FROM sh""")
def background_shirley_local(spark, sf):
    d = bg.shirley_steps(recorded_points(spark, sf), KEYS, 5, clamp=False)
    return d.select(*KEYS, "i", rnd("background", 5).alias("background"))


@query("background_shirley_converged", f"""WITH RECURSIVE {PTS}{CONVERGED_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, i, round(b, 4) + 0e0 AS background FROM sh""")
def background_shirley_converged(spark, sf):
    d = packed(spark, sf).withColumn("background", bg.shirley_packed(F.col("energy"), F.col("intensity")))
    return d.select(*KEYS, F.posexplode("background").alias("i", "b")).select(*KEYS, "i", rnd("b", 4).alias("background"))


@query("background_tougaard", f"""WITH {PTS},
g AS (SELECT a.instrument, a.sweep, a.i, b.i AS j, b.energy AS e, b.intensity * 2866e0 * (a.energy - b.energy) / pow(1643e0 + pow(a.energy - b.energy, 2), 2) AS t
  FROM pts a JOIN pts b ON a.instrument = b.instrument AND a.sweep = b.sweep AND b.i < a.i),
s AS (SELECT *, (e - lag(e) OVER w) * (t + lag(t) OVER w) / 2 AS seg FROM g WINDOW w AS (PARTITION BY instrument, sweep, i ORDER BY j)),
r AS (SELECT instrument, sweep, i, sum(seg) AS b FROM s GROUP BY 1, 2, 3)
SELECT p.instrument, CAST(p.sweep AS BIGINT) AS sweep, p.i, round(coalesce(b, 0e0), 6) + 0e0 AS background FROM pts p LEFT JOIN r USING (instrument, sweep, i)""")
def background_tougaard(spark, sf):
    d = packed(spark, sf).withColumn("background", bg.tougaard_packed(F.col("energy"), F.col("intensity")))
    return d.select(*KEYS, F.posexplode("background").alias("i", "b")).select(*KEYS, "i", rnd("b", 6).alias("background"))


@query("background_linear", f"""WITH {PTS}, f AS (SELECT instrument, sweep, CASE WHEN count(*) > 1 THEN regr_slope(intensity, energy) ELSE 0 END AS s, avg(energy) AS mx, avg(intensity) AS my FROM pts GROUP BY 1, 2)
SELECT p.instrument, CAST(p.sweep AS BIGINT) AS sweep, p.i, round(my + s * (p.energy - mx), 6) + 0e0 AS background FROM pts p JOIN f USING (instrument, sweep)""")
def background_linear(spark, sf):
    d = bg.linear_background(recorded_points(spark, sf), KEYS)
    return d.select(*KEYS, "i", rnd("background", 6).alias("background"))


QUAD_SQL = """
mu AS (SELECT {k}, avg({x}) AS mx FROM {t} GROUP BY {k}),
cu AS (SELECT p.*, p.{x} - mx AS u, p.{y} AS yy FROM {t} p JOIN mu USING ({k})),
mo AS (SELECT {k}, count(*) AS s0, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(yy) AS r0, sum(u*yy) AS r1, sum(u*u*yy) AS r2 FROM cu GROUP BY {k}),
de AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS d0 FROM mo),
co AS (SELECT *, CASE WHEN s0 >= 3 AND abs(d0) > 1e-12*abs(s0*s2*s4) THEN d0 END AS d FROM de),
qu AS (SELECT {k}, s0, (r0*(s2*s4-s3*s3) - s1*(r1*s4-s3*r2) + s2*(r1*s3-s2*r2))/d AS a0,
  (s0*(r1*s4-s3*r2) - r0*(s1*s4-s3*s2) + s2*(s1*r2-r1*s2))/d AS a1,
  (s0*(s2*r2-r1*s3) - s1*(s1*r2-r1*s2) + r0*(s1*s3-s2*s2))/d AS a2 FROM co)"""


@query("background_polynomial", f"""WITH {PTS}, {QUAD_SQL.format(k='instrument, sweep', x='energy', y='intensity', t='pts')}
SELECT c.instrument, CAST(c.sweep AS BIGINT) AS sweep, c.i, round(a0 + a1*u + a2*u*u, 5) + 0e0 AS background FROM cu c JOIN qu USING (instrument, sweep)""")
def background_polynomial(spark, sf):
    d = bg.polynomial_background(recorded_points(spark, sf), KEYS)
    return d.select(*KEYS, "i", rnd("background", 5).alias("background"))


@query("background_subtract", f"""WITH RECURSIVE {PTS}{CONVERGED_SQL}, l AS (SELECT instrument, sweep, CASE WHEN count(*) > 1 THEN regr_slope(intensity, energy) ELSE 0 END AS s, avg(energy) AS mx, avg(intensity) AS my FROM pts GROUP BY 1, 2)
SELECT region, 'shirley' AS method, count(*) AS n, round(sum(intensity - b), 2) + 0e0 AS corrected FROM sh GROUP BY region
UNION ALL SELECT region, 'linear', count(*), round(sum(intensity - (my + s * (energy - mx))), 2) + 0e0 FROM pts JOIN l USING (instrument, sweep) GROUP BY region""")
def background_subtract(spark, sf):
    p = recorded_points(spark, sf)
    out = None
    for m in ("shirley", "linear"):
        d = labelled(bg.background(p, KEYS, m)).groupBy("region").agg(
            F.count("*").alias("n"), rnd(F.sum("corrected"), 2).alias("corrected")).withColumn("method", F.lit(m))
        out = d if out is None else out.unionByName(d)
    return out


# ---- smoothing and peaks ----------------------------------------------------

SG_SQL = "sg(p, j, c) AS (VALUES " + ", ".join(
    f"({p}, {j}, CAST({float(c)!r} AS DOUBLE))" for p, row in enumerate(sm.savgol_matrix(7, 2)) for j, c in enumerate(row)) + ")"

SMOOTH_SQL = f"""{SG_SQL}, sn AS (SELECT *, count(*) OVER (PARTITION BY instrument, sweep) AS n FROM pts),
st AS (SELECT *, greatest(0, least(i - 3, n - 7)) AS a FROM sn WHERE n >= 20),
sv AS (SELECT t.instrument, t.sweep, t.i, sum(g.c * q.intensity) AS y FROM st t JOIN sg g ON g.p = t.i - t.a
  JOIN pts q ON q.instrument = t.instrument AND q.sweep = t.sweep AND q.i = t.a + g.j GROUP BY 1, 2, 3),
sy AS (SELECT p.* EXCLUDE (intensity), coalesce(v.y, p.intensity) AS y FROM pts p LEFT JOIN sv v USING (instrument, sweep, i))"""


@query("smooth_savgol", f"""WITH {PTS}, {SMOOTH_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, i, round(y, 6) + 0e0 AS smooth FROM sy""")
def smooth_savgol(spark, sf):
    d = packed(spark, sf).withColumn("s", sm.savgol(F.col("intensity"), 7, 2, 20))
    return d.select(*KEYS, F.posexplode("s").alias("i", "s")).select(*KEYS, "i", rnd("s", 6).alias("smooth"))


def peaks_sql(src: str, y: str) -> str:
    """CTEs ending in pk(instrument, sweep, i, h, prom)."""
    o = "(PARTITION BY instrument, sweep ORDER BY i)"
    return f"""
r1 AS (SELECT *, CASE WHEN {y} = lag({y}) OVER {o} THEN 0 ELSE 1 END AS f FROM {src}),
r2 AS (SELECT *, sum(f) OVER {o} AS rid FROM r1),
r3 AS (SELECT instrument, sweep, rid, any_value({y}) AS y, min(i) AS a, max(i) AS b FROM r2 GROUP BY 1, 2, 3),
r4 AS (SELECT *, lag(y) OVER q AS yp, lead(y) OVER q AS yn FROM r3 WINDOW q AS (PARTITION BY instrument, sweep ORDER BY rid)),
cand AS (SELECT instrument, sweep, (a + b) // 2 AS i, y AS h FROM r4 WHERE yp < y AND yn < y),
wall AS (SELECT c.instrument, c.sweep, c.i, c.h, max(CASE WHEN p.i < c.i AND p.{y} > c.h THEN p.i END) AS lw, min(CASE WHEN p.i > c.i AND p.{y} > c.h THEN p.i END) AS rw
  FROM cand c JOIN {src} p ON p.instrument = c.instrument AND p.sweep = c.sweep GROUP BY 1, 2, 3, 4),
pk AS (SELECT c.instrument, c.sweep, c.i, c.h, c.h - greatest(min(CASE WHEN p.i <= c.i AND p.i > coalesce(lw, -1) THEN p.{y} END), min(CASE WHEN p.i >= c.i AND p.i < coalesce(rw, 999999) THEN p.{y} END)) AS prom
  FROM wall c JOIN {src} p ON p.instrument = c.instrument AND p.sweep = c.sweep GROUP BY 1, 2, 3, 4)"""


@query("peaks_all", f"""WITH {PTS}, {peaks_sql('pts', 'intensity')}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, CAST(i AS INTEGER) AS i, round(h, 6) + 0e0 AS height, round(prom, 6) + 0e0 AS prominence FROM pk""")
def peaks_all(spark, sf):
    d = pk.find_peaks(packed(spark, sf)).select(*KEYS, F.explode("peaks").alias("p"))
    return d.select(*KEYS, F.col("p.i").alias("i"), rnd("p.height", 6).alias("height"), rnd("p.prominence", 6).alias("prominence"))


@query("peaks_dominant", f"""WITH {PTS}, {peaks_sql('pts', 'intensity')},
mx AS (SELECT instrument, sweep, max(intensity) AS top FROM pts GROUP BY 1, 2),
rk AS (SELECT pk.*, row_number() OVER (PARTITION BY instrument, sweep ORDER BY prom DESC, i) AS rn FROM pk JOIN mx USING (instrument, sweep) WHERE prom >= 1e-1 * top)
SELECT m.instrument, CAST(m.sweep AS BIGINT) AS sweep, CAST(coalesce(r.i, -1) AS INTEGER) AS i, round(p.energy, 4) + 0e0 AS peak_ev FROM mx m LEFT JOIN rk r ON r.instrument = m.instrument AND r.sweep = m.sweep AND rn = 1
LEFT JOIN pts p ON p.instrument = m.instrument AND p.sweep = m.sweep AND p.i = r.i""")
def peaks_dominant(spark, sf):
    d = pk.find_peaks(packed(spark, sf)).withColumn("p", pk.dominant_peak(F.col("peaks"), 0.1 * F.array_max("intensity")))
    return d.select(*KEYS, F.coalesce("p.i", F.lit(-1)).alias("i"), rnd(F.get("energy", F.col("p.i")), 4).alias("peak_ev"))


STATES = [("metal", 281.0), ("carbide", 282.5), ("hydrocarbon", 284.8), ("alcohol", 286.4), ("carbonyl", 288.0),
          ("carbonate", 290.2), ("oxide", 530.0), ("hydroxide", 531.5), ("water", 533.2), ("fluoride", 685.0),
          ("organic fluorine", 688.0), ("amine", 399.5), ("nitrate", 407.0), ("silicon", 99.3), ("silica", 103.5)]
STATES_SQL = "states(state, state_ev) AS (VALUES " + ", ".join(f"('{s}', CAST({e} AS DOUBLE))" for s, e in STATES) + ")"


@query("peaks_nearest_state", f"""WITH {PTS}, {STATES_SQL}, {peaks_sql('pts', 'intensity')},
mx AS (SELECT instrument, sweep, max(intensity) AS top FROM pts GROUP BY 1, 2),
rk AS (SELECT pk.*, row_number() OVER (PARTITION BY instrument, sweep ORDER BY prom DESC, i) AS rn FROM pk JOIN mx USING (instrument, sweep) WHERE prom >= 1e-1 * top),
pe AS (SELECT m.instrument, m.sweep, p.energy FROM mx m LEFT JOIN rk r ON r.instrument = m.instrument AND r.sweep = m.sweep AND rn = 1 LEFT JOIN pts p ON p.instrument = m.instrument AND p.sweep = m.sweep AND p.i = r.i),
ne AS (SELECT pe.*, state, abs(energy - state_ev) AS gap, row_number() OVER (PARTITION BY instrument, sweep ORDER BY abs(energy - state_ev), state_ev) AS rn FROM pe LEFT JOIN states ON abs(energy - state_ev) < 15e-1)
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, CASE WHEN energy IS NULL THEN '(no peak)' ELSE coalesce(state, 'Unknown') END AS state, round(gap, 4) + 0e0 AS gap FROM ne WHERE rn = 1""")
def peaks_nearest_state(spark, sf):
    d = pk.find_peaks(packed(spark, sf)).withColumn("p", pk.dominant_peak(F.col("peaks"), 0.1 * F.array_max("intensity")))
    d = d.select(*KEYS, F.get("energy", F.col("p.i")).alias("energy"))
    states = spark.createDataFrame(STATES, "state string, state_ev double")
    n = pk.nearest_state(d, states, KEYS, tolerance=1.5)
    return n.select(*KEYS, "state", rnd("gap", 4).alias("gap"))


# ---- gates ------------------------------------------------------------------

STATS_SQL = """st AS (SELECT instrument, sweep, any_value(sample) AS sample, any_value(region) AS region, count(*) AS n, min(energy) AS e_lo, max(energy) AS e_hi, min(intensity) AS y_lo, max(intensity) AS y_hi,
  avg(intensity) AS y_mean, stddev_pop(intensity) AS y_std, count(*) FILTER (intensity = 0) AS n_zero FROM pts GROUP BY 1, 2)"""


@query("spectrum_validity", f"""WITH {PTS}, {STATS_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, n >= 2 AND e_lo BETWEEN 0 AND 1500 AND e_hi BETWEEN 0 AND 1500 AND n_zero < n AND (y_mean <= 0 OR (CASE WHEN y_std > 0 THEN y_mean / y_std ELSE 0 END) >= 1e-1) AS valid FROM st""")
def spectrum_validity(spark, sf):
    return rg.spectrum_stats(recorded_points(spark, sf), KEYS).select(*KEYS, rg.is_valid().alias("valid"))


SCAN_SQL = """CASE WHEN instrument % 3 = 0 THEN (CASE WHEN pe >= 100 THEN 'survey' WHEN pe <= 50 AND span < 50 THEN 'narrow' ELSE 'auto' END)
  WHEN span > 100 THEN 'survey' WHEN span < 50 AND (CASE WHEN span > 0 THEN n / span ELSE 0 END) > 4 THEN 'narrow' ELSE 'auto' END"""


def with_scan_type(stats):
    """Every third instrument reports a pass energy of 23.5, 70 or 117.4 eV."""
    i = F.col("instrument")
    pe = F.when(F.pmod(i, F.lit(3)) == 0, F.element_at(F.array(F.lit(23.5), F.lit(70.0), F.lit(117.4)),
                                                       (F.pmod(F.floor(i / 3), F.lit(3)) + 1).cast("int")))
    span = F.col("e_hi") - F.col("e_lo")
    return stats.withColumn("pass_energy", pe).withColumn("scan_type", rg.scan_type(span, F.col("n"), pe))


SCANNED_SQL = f"""sc AS (SELECT *, {SCAN_SQL} AS scan_type FROM (SELECT *, e_hi - e_lo AS span, ([235e-1, 70e0, 1174e-1])[CAST((instrument // 3) % 3 AS INTEGER) + 1] AS pe FROM st))"""


@query("scan_classification", f"""WITH {PTS}, {STATS_SQL}, {SCANNED_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, scan_type FROM sc""")
def scan_classification(spark, sf):
    return with_scan_type(rg.spectrum_stats(recorded_points(spark, sf), KEYS)).select(*KEYS, "scan_type")


@query("survey_split", f"""WITH {PTS}, {STATS_SQL}, {SCANNED_SQL}
SELECT CASE WHEN scan_type = 'survey' THEN 'survey' ELSE 'fit' END AS route, count(*) AS n_spectra, CAST(sum(n) AS BIGINT) AS n_points FROM sc GROUP BY 1""")
def survey_split(spark, sf):
    s = with_scan_type(rg.spectrum_stats(recorded_points(spark, sf), KEYS))
    return s.groupBy(F.when(F.col("scan_type") == "survey", "survey").otherwise("fit").alias("route")).agg(
        F.count("*").alias("n_spectra"), F.sum("n").alias("n_points"))


def with_flags(spark, sf):
    p = recorded_points(spark, sf)
    g = pt.whole(KEYS)
    span = F.max("energy").over(g) - F.min("energy").over(g)
    n = F.count("*").over(g)
    return with_scan_type(p.withColumn("n", n).withColumn("e_lo", F.min("energy").over(g))
                          .withColumn("e_hi", F.max("energy").over(g))
                          .withColumn("all_zero", F.max(F.abs("intensity")).over(g) == 0)).drop("raw")


DETECT_SQL = f"""{PTS}, {STATS_SQL}, {SCANNED_SQL}, {DEFS_SQL},
hit AS (SELECT p.instrument, p.sweep, d.region AS detected, e_min, e_max, scan_type, n_zero = sc.n AS all_zero, count(*) AS np, max(intensity) AS top
  FROM pts p JOIN defs d ON energy BETWEEN e_min AND e_max JOIN sc USING (instrument, sweep) GROUP BY ALL),
det AS (SELECT * FROM hit WHERE (scan_type = 'survey' AND (all_zero OR top > 10)) OR (scan_type = 'narrow' AND np / (e_max - e_min) > 35e-1 AND top > 10))"""


@query("region_detection", f"""WITH {DETECT_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, detected, np AS n_points, round(top, 6) + 0e0 AS max_intensity FROM det""")
def region_detection(spark, sf):
    d = rg.detect_regions(with_flags(spark, sf), schemas.region_defs(spark), KEYS, hr_resolution=3.5)
    return d.select(*KEYS, "detected", "n_points", rnd("max_intensity", 6).alias("max_intensity"))


@query("region_override", f"""WITH {DETECT_SQL}
SELECT sc.instrument, CAST(sc.sweep AS BIGINT) AS sweep, sc.region AS label, CASE WHEN sc.region IN ('C1s', 'O1s', 'F1s') THEN sc.region ELSE detected END AS chosen
FROM sc LEFT JOIN det USING (instrument, sweep)""")
def region_override(spark, sf):
    f = with_flags(spark, sf)
    det = rg.detect_regions(f, schemas.region_defs(spark), KEYS, hr_resolution=3.5).select(*KEYS, "detected")
    own = labelled(rg.spectrum_stats(f, KEYS).select(*KEYS)).drop("sample", "layer")
    d = own.join(det, KEYS, "left")
    return d.select(*KEYS, F.col("region").alias("label"), rg.chosen_region(
        F.col("region"), F.col("region").isin("C1s", "O1s", "F1s"), F.col("detected")).alias("chosen"))


@query("region_extraction", f"""WITH {DETECT_SQL},
ex AS (SELECT p.instrument, p.sweep, detected AS region, energy, intensity, scan_type FROM pts p JOIN det USING (instrument, sweep)
  WHERE energy BETWEEN e_min - (CASE WHEN scan_type = 'survey' THEN 0 ELSE 2 END) AND e_max + (CASE WHEN scan_type = 'survey' THEN 0 ELSE 2 END))
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, region, count(*) AS n_points, round(count(*) / nullif(max(energy) - min(energy), 0), 6) + 0e0 AS resolution, round(sum(intensity), 4) + 0e0 AS total
FROM ex GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def region_extraction(spark, sf):
    f = with_flags(spark, sf)
    defs = schemas.region_defs(spark)
    det = rg.detect_regions(f, defs, KEYS, hr_resolution=3.5)
    scan = f.groupBy(*KEYS).agg(F.first("scan_type").alias("scan_type"))
    wanted = det.select(*KEYS, F.col("detected").alias("region")).join(
        F.broadcast(defs.select("region", "e_min", "e_max")), "region").join(scan, KEYS)
    x = rg.extract_regions(f.select(*KEYS, "i", "energy", "intensity"), wanted, KEYS)
    return x.groupBy(*KEYS, "region").agg(F.count("*").alias("n_points"), rnd(F.max("resolution"), 6).alias("resolution"),
                                          rnd(F.sum("intensity"), 4).alias("total"))


@query("region_fit_ready", f"""WITH {PTS}, {STATS_SQL}
SELECT region, count(*) AS n_spectra, count(*) FILTER (CASE WHEN e_hi > e_lo THEN n / (e_hi - e_lo) ELSE 0 END >= 1016e-2) AS n_ready FROM st GROUP BY region""")
def region_fit_ready(spark, sf):
    s = labelled(rg.spectrum_stats(recorded_points(spark, sf), KEYS))
    span = F.col("e_hi") - F.col("e_lo")
    return s.groupBy("region").agg(F.count("*").alias("n_spectra"), F.count_if(
        F.when(span > 0, F.col("n") / span).otherwise(0.0) >= 10.16).alias("n_ready"))


@query("roi_slice", f"""WITH {PTS}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, count(*) AS n, round(sum(intensity), 4) + 0e0 AS total FROM pts WHERE energy BETWEEN 284 AND 2865e-1 GROUP BY 1, 2""")
def roi_slice(spark, sf):
    return pt.roi(recorded_points(spark, sf), 286.5, 284.0).groupBy(*KEYS).agg(
        F.count("*").alias("n"), rnd(F.sum("intensity"), 4).alias("total"))


@query("energy_kinetic_to_binding", f"""WITH {PTS}, k AS (SELECT instrument, sweep, CASE WHEN instrument % 2 = 0 THEN 14866e-1 - (energy + 900) ELSE energy END AS be FROM pts)
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, count(*) AS n, round(min(be), 4) + 0e0 AS lo, round(max(be), 4) + 0e0 AS hi FROM k WHERE be >= 0 GROUP BY 1, 2""")
def energy_kinetic_to_binding(spark, sf):
    even = F.pmod("instrument", F.lit(2)) == 0
    p = recorded_points(spark, sf).withColumn("energy", F.when(even, F.col("energy") + 900).otherwise(F.col("energy"))) \
        .withColumn("energy_scale", F.when(even, "kinetic").otherwise("binding"))
    return rg.kinetic_to_binding(p, fv.PHOTON_ENERGY_EV).groupBy(*KEYS).agg(
        F.count("*").alias("n"), rnd(F.min("energy"), 4).alias("lo"), rnd(F.max("energy"), 4).alias("hi"))


@query("finite_spectra", f"""WITH {PTS}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, count(*) AS n FROM pts WHERE raw >= 50 GROUP BY 1, 2 HAVING count(*) >= 5""")
def finite_spectra(spark, sf):
    from lumenfold.functions.scalars import finite
    p = recorded_points(spark, sf).withColumn("y", F.when(F.col("raw") < 50, float("nan")).otherwise(F.col("raw")))
    return p.filter(finite(F.col("y"))).groupBy(*KEYS).agg(F.count("*").alias("n")).filter(F.col("n") >= 5)


GATE_SQL = f"""{STATS_SQL.replace('intensity', 'raw')},
g1 AS (SELECT *, CASE WHEN y_std > 0 THEN y_mean / (y_std + 1e-10) ELSE 0 END AS snr, CASE WHEN e_hi > e_lo THEN n / (e_hi - e_lo) ELSE 0 END AS res FROM st),
g2 AS (SELECT *, (CASE WHEN n < 10 THEN 1 ELSE 0 END) + (CASE WHEN snr < 1 THEN 1 ELSE 0 END) AS nc,
  (CASE WHEN e_hi - e_lo < 5 THEN 1 ELSE 0 END) + (CASE WHEN snr >= 1 AND snr < 3 THEN 1 ELSE 0 END) AS nw0, (CASE WHEN (y_hi - y_lo) / (y_mean + 1e-10) < 1e-1 THEN 1 ELSE 0 END) AS fl,
  CASE WHEN res < 5 THEN 1 ELSE 0 END AS lowres FROM g1),
g3 AS (SELECT *, nw0 + (CASE WHEN nc > 0 THEN 0 ELSE fl END) AS nw FROM g2),
g4 AS (SELECT *, CASE WHEN nc > 0 THEN 'critical' WHEN snr >= 10 AND nw = 0 THEN 'excellent' WHEN snr >= 5 AND nw <= 1 THEN 'good' WHEN snr >= 3 AND nw <= 2 THEN 'acceptable' WHEN snr >= 1 THEN 'poor' ELSE 'failed' END AS flag FROM g3)"""


def gated(spark, sf):
    p = recorded_points(spark, sf).drop("intensity").withColumnRenamed("raw", "intensity")
    return ql.gate_spectra(rg.spectrum_stats(p, KEYS))


@query("gate_spectra", f"""WITH {PTS}, {GATE_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, round(snr, 6) + 0e0 AS snr_gate, nw AS n_warning, nc AS n_critical, nw + nc + (CASE WHEN nc > 0 THEN 0 ELSE lowres END) AS n_issues, flag,
res >= 5 AND flag NOT IN ('critical', 'failed', 'poor') AS suitable FROM g4""")
def gate_spectra(spark, sf):
    return gated(spark, sf).select(*KEYS, rnd("snr_gate", 6).alias("snr_gate"), "n_warning", "n_critical",
                                   F.size("issues").alias("n_issues"), "flag", "suitable")


@query("gate_issue_counts", f"""WITH {PTS}, {GATE_SQL}, u AS (
SELECT 'critical' AS level, 'data' AS category FROM g4 WHERE n < 10 UNION ALL SELECT 'warning', 'energy' FROM g4 WHERE e_hi - e_lo < 5
UNION ALL SELECT 'critical', 'snr' FROM g4 WHERE snr < 1 UNION ALL SELECT 'warning', 'snr' FROM g4 WHERE snr >= 1 AND snr < 3
UNION ALL SELECT 'info', 'resolution' FROM g4 WHERE nc = 0 AND lowres = 1 UNION ALL SELECT 'warning', 'peak' FROM g4 WHERE nc = 0 AND fl = 1)
SELECT level, category, count(*) AS n FROM u GROUP BY 1, 2""")
def gate_issue_counts(spark, sf):
    return gated(spark, sf).select(F.explode("issues").alias("x")).groupBy(
        F.col("x.level").alias("level"), F.col("x.category").alias("category")).agg(F.count("*").alias("n"))


@query("gate_alerts", f"""WITH {PTS}, {GATE_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, CASE WHEN nc > 0 THEN 'critical: ' || nc || ' issues, first: ' || (CASE WHEN n < 10 THEN 'too few points' ELSE 'signal to noise unusable' END)
WHEN flag = 'failed' THEN 'failed' WHEN flag = 'poor' THEN 'poor, ' || (nw + lowres) || ' issues' WHEN nw > 0 THEN flag || ': ' || nw || ' warnings' ELSE flag END AS alert FROM g4""")
def gate_alerts(spark, sf):
    from lumenfold.functions.scalars import gate_alert
    g = gated(spark, sf)
    first = F.get(F.filter("issues", lambda x: x["level"] == "critical"), F.lit(0))["message"]
    a = gate_alert(F.col("flag"), F.col("n_critical"), F.col("n_warning"), F.size("issues"), first, F.col("snr_gate"))
    return g.select(*KEYS, F.regexp_replace(a, r"(, |: )snr [-0-9.]+", "").alias("alert"))


@query("low_quality_samples", f"""WITH {PTS}, {GATE_SQL} SELECT sample, count(*) FILTER (flag = 'critical') AS n_critical, count(*) FILTER (flag = 'failed') AS n_failed, count(*) AS n
FROM g4 WHERE flag IN ('critical', 'failed') GROUP BY sample""")
def low_quality_samples(spark, sf):
    """Counts and not a list of flags, which would grow with a sample's spectra."""
    g = labelled(gated(spark, sf)).filter(F.col("flag").isin("critical", "failed"))
    return g.groupBy("sample").agg(F.count_if(F.col("flag") == "critical").alias("n_critical"), F.count_if(F.col("flag") == "failed").alias("n_failed"),
                                   F.count("*").alias("n"))


# ---- quality metrics --------------------------------------------------------

BASE_SQL = f"""
w0 AS (SELECT *, count(*) OVER g AS n, max(energy) OVER g AS hi, min(energy) OVER g AS lo, max(intensity) OVER g AS top, avg(intensity) OVER g AS mean FROM pts WINDOW g AS (PARTITION BY instrument, sweep)),
w1 AS (SELECT *, energy >= hi - (hi - lo) * 25e-2 AS inb FROM w0),
w2 AS (SELECT *, count(*) FILTER (inb) OVER (PARTITION BY instrument, sweep) AS c FROM w1),
bl AS (SELECT * FROM w2 WHERE c < 5 OR inb),
{QUAD_SQL.format(k='instrument, sweep', x='energy', y='intensity', t='bl')},
ba AS (SELECT instrument, sweep, any_value(n) AS n, any_value(top) AS top, any_value(mean) AS mean, avg(intensity) AS bm, stddev_pop(intensity) AS bs, max(intensity) - min(intensity) AS pp, regr_slope(intensity, energy) AS sl FROM bl GROUP BY 1, 2),
bx AS (SELECT ba.*, a2, s0 FROM ba JOIN qu USING (instrument, sweep)),
bq AS (SELECT instrument, sweep, n, CASE WHEN n >= 10 THEN (top - bm) / (bs + 1e-12) ELSE 0 END AS snr_xps, CASE WHEN n >= 10 THEN bm ELSE 0 END AS baseline_mean, CASE WHEN n >= 10 THEN bs ELSE 0 END AS baseline_std,
  CASE WHEN n >= 10 AND s0 >= 3 THEN coalesce(sl, 0) ELSE 0 END AS baseline_slope, CASE WHEN n >= 10 AND s0 >= 5 THEN coalesce(abs(a2), 0) ELSE 0 END AS baseline_curvature,
  CASE WHEN n >= 10 THEN pp ELSE 0 END AS noise_pk_pk, CASE WHEN n >= 10 THEN bs / (mean + 1e-10) ELSE 0 END AS relative_noise FROM bx)"""


@query("quality_baseline", f"""WITH {PTS}, {BASE_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, n, round(snr_xps, 4) + 0e0 AS snr_xps, round(baseline_mean, 6) + 0e0 AS baseline_mean, round(baseline_std, 6) + 0e0 AS baseline_std, round(baseline_slope, 4) + 0e0 AS baseline_slope,
round(baseline_curvature, 3) + 0e0 AS baseline_curvature, round(noise_pk_pk, 6) + 0e0 AS noise_pk_pk, round(relative_noise, 6) + 0e0 AS relative_noise FROM bq""")
def quality_baseline(spark, sf):
    b = ql.baseline_metrics(recorded_points(spark, sf), KEYS)
    digits = {"snr_xps": 4, "baseline_mean": 6, "baseline_std": 6, "baseline_slope": 4, "baseline_curvature": 3,
              "noise_pk_pk": 6, "relative_noise": 6}
    return b.select(*KEYS, "n", *[rnd(c, d).alias(c) for c, d in digits.items()])


RES_SQL = """rd AS (SELECT *, abs(energy - lag(energy) OVER (PARTITION BY instrument, sweep ORDER BY i)) AS d FROM pts),
rq AS (SELECT instrument, sweep, CASE WHEN max(energy) > min(energy) THEN count(*) / (max(energy) - min(energy)) ELSE 0 END AS points_per_ev, coalesce(median(d), 0) AS energy_step_ev, max(energy) - min(energy) AS energy_range FROM rd GROUP BY 1, 2)"""


@query("quality_resolution", f"""WITH {PTS}, {RES_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, round(points_per_ev, 6) + 0e0 AS points_per_ev, round(energy_step_ev, 6) + 0e0 AS energy_step_ev, round(energy_range, 6) + 0e0 AS energy_range FROM rq""")
def quality_resolution(spark, sf):
    r = ql.resolution_metrics(recorded_points(spark, sf), KEYS)
    return r.select(*KEYS, *[rnd(c, 6).alias(c) for c in ("points_per_ev", "energy_step_ev", "energy_range")])


SHIFT_SQL = """sp AS (SELECT instrument, sweep, region, energy AS peak_ev FROM (SELECT *, row_number() OVER (PARTITION BY instrument, sweep ORDER BY intensity DESC, i) AS rn FROM pts) WHERE rn = 1),
sq AS (SELECT sp.*, coalesce(peak_ev - typical_be, 0) AS shift_estimate_ev, abs(coalesce(peak_ev - typical_be, 0)) > 5 AS suspected_shift FROM sp LEFT JOIN defs USING (region))"""


@query("quality_shift", f"""WITH {PTS}, {DEFS_SQL}, {SHIFT_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, region, round(peak_ev, 4) + 0e0 AS peak_ev, round(shift_estimate_ev, 4) + 0e0 AS shift_estimate_ev, round(shift_estimate_ev, 4) > 5 OR round(shift_estimate_ev, 4) < -5 AS suspected_shift FROM sq""")
def quality_shift(spark, sf):
    s = ql.shift_check(labelled(recorded_points(spark, sf)), schemas.region_defs(spark), KEYS)
    e = rnd("shift_estimate_ev", 4)
    return s.select(*KEYS, "region", rnd("peak_ev", 4).alias("peak_ev"), e.alias("shift_estimate_ev"),
                    ((e > 5) | (e < -5)).alias("suspected_shift"))


PEAKQ_SQL = f"""ph AS (SELECT *, intensity - b AS cc, max(intensity - b) OVER (PARTITION BY instrument, sweep) AS h FROM sh),
pa AS (SELECT instrument, sweep, max(h) AS peak_height, coalesce(max(CASE WHEN cc >= h / 2 THEN energy END) - min(CASE WHEN cc >= h / 2 THEN energy END), 0) AS peak_fwhm, stddev_pop(cc) AS sd FROM ph GROUP BY 1, 2),
pb AS (SELECT instrument, sweep, b FROM (SELECT *, row_number() OVER (PARTITION BY instrument, sweep ORDER BY cc DESC, i) AS rn FROM ph) WHERE rn = 1),
pq AS (SELECT pa.*, peak_height / (b + 1e-10) AS peak_to_baseline, peak_height / (sd + 1e-10) AS dynamic_range FROM pa JOIN pb USING (instrument, sweep))"""


@query("quality_peak", f"""WITH RECURSIVE {PTS}{CONVERGED_SQL}, {PEAKQ_SQL}
SELECT pq.instrument, CAST(pq.sweep AS BIGINT) AS sweep, round(peak_height, 4) + 0e0 AS peak_height, round(peak_fwhm, 4) + 0e0 AS peak_fwhm, round(peak_to_baseline, 3) + 0e0 AS peak_to_baseline, round(dynamic_range, 4) + 0e0 AS dynamic_range FROM pq""")
def quality_peak(spark, sf):
    q = ql.peak_metrics(recorded_points(spark, sf), KEYS)
    return q.select(*KEYS, rnd("peak_height", 4).alias("peak_height"), rnd("peak_fwhm", 4).alias("peak_fwhm"),
                    rnd("peak_to_baseline", 3).alias("peak_to_baseline"), rnd("dynamic_range", 4).alias("dynamic_range"))


ASSESS_SQL = f"""{PTS}{CONVERGED_SQL}, {DEFS_SQL}, {SHIFT_SQL}, {BASE_SQL}, {RES_SQL}, {PEAKQ_SQL},
qa AS (SELECT sq.*, bq.snr_xps, bq.relative_noise, rq.points_per_ev, pq.peak_to_baseline, pq.peak_fwhm FROM sq JOIN bq USING (instrument, sweep) JOIN rq USING (instrument, sweep) JOIN pq USING (instrument, sweep)),
qb AS (SELECT *, points_per_ev >= 5 AS hr, (CASE WHEN snr_xps < 3 THEN 1 ELSE 0 END) + (CASE WHEN points_per_ev < 3 THEN 1 ELSE 0 END) + (CASE WHEN suspected_shift THEN 1 ELSE 0 END)
  + (CASE WHEN peak_to_baseline < 2e-1 THEN 1 ELSE 0 END) + (CASE WHEN relative_noise > 2e-1 THEN 1 ELSE 0 END) AS nw FROM qa),
qf AS (SELECT *, CASE WHEN snr_xps >= 20 AND hr AND nw = 0 THEN 'excellent' WHEN snr_xps >= 10 AND hr THEN 'good' WHEN snr_xps >= 3 THEN 'acceptable' WHEN snr_xps >= 2 THEN 'poor' ELSE 'suspicious' END AS quality_flag,
  hr AND snr_xps >= 3 AND peak_to_baseline >= 2e-1 AS suitable FROM qb)"""


@query("quality_assessment", f"""WITH RECURSIVE {ASSESS_SQL}
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, quality_flag, nw AS n_warnings, hr AS is_hr_scan, suitable FROM qf""")
def quality_assessment(spark, sf):
    q = ql.spectrum_quality(labelled(recorded_points(spark, sf)), schemas.region_defs(spark), KEYS)
    return q.select(*KEYS, "quality_flag", F.size("warnings").alias("n_warnings"), "is_hr_scan",
                    F.col("suitable_for_fitting").alias("suitable"))


@query("quality_summary", f"""WITH RECURSIVE {ASSESS_SQL}
SELECT count(*) AS n_spectra, round(avg(snr_xps), 4) AS mean_snr, round(median(snr_xps), 4) AS median_snr, round(median(peak_fwhm) FILTER (peak_fwhm > 0), 4) AS median_fwhm, round(avg(points_per_ev), 4) AS mean_resolution, count(*) FILTER (hr) AS n_hr, count(*) FILTER (suspected_shift) AS n_shifted,
count(*) FILTER (suitable) AS n_suitable, round(count(*) FILTER (suitable) / count(*), 6) AS suitable_rate FROM qf""")
def quality_summary(spark, sf):
    q = ql.spectrum_quality(labelled(recorded_points(spark, sf)), schemas.region_defs(spark), KEYS)
    s = ql.quality_summary(q)
    return s.select("n_spectra", "n_hr", "n_shifted", "n_suitable", rnd("mean_snr", 4).alias("mean_snr"),
                    rnd("median_snr", 4).alias("median_snr"), rnd("median_fwhm", 4).alias("median_fwhm"), rnd("mean_resolution", 4).alias("mean_resolution"),
                    rnd("suitable_rate", 6).alias("suitable_rate"))


@query("quality_flag_counts", f"""WITH RECURSIVE {ASSESS_SQL}
SELECT region, quality_flag, count(*) AS n FROM qf GROUP BY 1, 2""")
def quality_flag_counts(spark, sf):
    q = ql.spectrum_quality(labelled(recorded_points(spark, sf)), schemas.region_defs(spark), KEYS)
    return q.groupBy("region", "quality_flag").agg(F.count("*").alias("n"))


# ---- grids ------------------------------------------------------------------

@query("grid_common_range", f"""WITH {PTS}, r AS (SELECT sample, region, instrument, sweep, min(energy) AS lo, max(energy) AS hi FROM pts GROUP BY 1, 2, 3, 4)
SELECT region, round(CASE WHEN max(lo) < min(hi) THEN max(lo) ELSE min(lo) END, 4) AS grid_lo, round(CASE WHEN max(lo) < min(hi) THEN min(hi) ELSE max(hi) END, 4) AS grid_hi, max(lo) < min(hi) AS overlap FROM r GROUP BY region""")
def grid_common_range(spark, sf):
    s = labelled(rg.spectrum_stats(recorded_points(spark, sf), KEYS))
    c = rs.common_range(s, ["region"])
    return c.select("region", rnd("grid_lo", 4).alias("grid_lo"), rnd("grid_hi", 4).alias("grid_hi"), "overlap")


@query("grid_combine", f"""WITH {PTS}, own AS (SELECT instrument, sweep, region, layer, i, energy, intensity, lead(energy) OVER w AS e1, lead(intensity) OVER w AS y1, abs(energy - lag(energy) OVER w) AS d FROM pts WINDOW w AS (PARTITION BY instrument, sweep ORDER BY i)),
st AS (SELECT instrument, sweep, region, coalesce(median(d), 0) AS step, min(energy) AS lo, max(energy) AS hi FROM own GROUP BY 1, 2, 3),
sc AS (SELECT instrument, max(lo) AS glo, min(hi) AS ghi, min_by(step, sweep) AS s0 FROM st GROUP BY 1 HAVING max(lo) < min(hi)),
sd AS (SELECT instrument, glo, ghi, CASE WHEN s0 = 0 THEN 1e-1 ELSE s0 END AS s FROM sc),
gr AS (SELECT instrument, glo, s, unnest(range(CAST(ceil((ghi - glo) / s + 5e-1) AS BIGINT))) AS g FROM sd),
tg AS (SELECT st.instrument, st.sweep, g, glo + g * s AS x, lo, hi FROM gr JOIN st USING (instrument)),
en AS (SELECT instrument, sweep, min_by(intensity, i) AS yf, max_by(intensity, i) AS yl FROM pts GROUP BY 1, 2),
va AS (SELECT t.instrument, t.sweep, t.g, t.x, CASE WHEN t.x <= t.lo THEN yf WHEN t.x >= t.hi THEN yl ELSE o.intensity + (o.y1 - o.intensity) * (t.x - o.energy) / (o.e1 - o.energy) END AS v
  FROM tg t JOIN en USING (instrument, sweep) LEFT JOIN own o ON o.instrument = t.instrument AND o.sweep = t.sweep AND o.energy <= t.x AND t.x < o.e1)
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, CAST(g AS INTEGER) AS g, round(x, 4) + 0e0 AS grid_energy, round(v, 4) + 0e0 AS value FROM va""")
def grid_combine(spark, sf):
    c = rs.combine_on_grid(packed(spark, sf), ["instrument"], KEYS, ["sweep"])
    return c.select(*KEYS, "g", rnd("grid_energy", 4).alias("grid_energy"), rnd("value", 4).alias("value"))


@query("grid_energy_axis", f"""WITH {DEFS_SQL}, {PTS}, n AS (SELECT region, instrument, sweep, count(*) AS n FROM pts GROUP BY 1, 2, 3)
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, CAST(k AS INTEGER) AS k, round(CASE WHEN n > 1 THEN e_min + k * (e_max - e_min) / (n - 1) ELSE e_min END, 6) + 0e0 AS energy FROM (SELECT *, unnest(range(n)) AS k FROM n JOIN defs USING (region))""")
def grid_energy_axis(spark, sf):
    s = labelled(rg.spectrum_stats(recorded_points(spark, sf), KEYS).select(*KEYS, "n"))
    d = s.join(F.broadcast(schemas.region_defs(spark).select("region", "e_min", "e_max")), "region")
    a = rs.linear_axis(F.col("e_min"), F.col("e_max"), F.col("n").cast("int"))
    return d.select(*KEYS, F.posexplode(a).alias("k", "energy")).select(*KEYS, "k", rnd("energy", 6).alias("energy"))


@query("grid_onto_first_axis", f"""WITH {PTS}, own AS (SELECT instrument, sweep, i, energy, intensity, lead(energy) OVER w AS e1, lead(intensity) OVER w AS y1 FROM pts WINDOW w AS (PARTITION BY instrument, sweep ORDER BY i)),
ax AS (SELECT instrument, i AS k, energy AS x FROM pts WHERE sweep = 0), en AS (SELECT instrument, sweep, min(energy) AS lo, max(energy) AS hi, min_by(intensity, i) AS yf, max_by(intensity, i) AS yl FROM pts GROUP BY 1, 2)
SELECT e.instrument, CAST(e.sweep AS BIGINT) AS sweep, a.k, round(a.x, 4) + 0e0 AS energy, round(CASE WHEN a.x <= lo THEN yf WHEN a.x >= hi THEN yl ELSE o.intensity + (o.y1 - o.intensity) * (a.x - o.energy) / (o.e1 - o.energy) END, 4) + 0e0 AS value
FROM en e JOIN ax a USING (instrument) LEFT JOIN own o ON o.instrument = e.instrument AND o.sweep = e.sweep AND o.energy <= a.x AND a.x < o.e1""")
def grid_onto_first_axis(spark, sf):
    p = packed(spark, sf)
    axis = p.groupBy("instrument").agg(F.min_by("energy", "sweep").alias("axis"))
    from lumenfold.session import join_stats
    d = join_stats(p, axis, ["instrument"]).withColumn("v", rs.interpolate(F.col("energy"), F.col("intensity"), F.col("axis")))
    z = d.select(*KEYS, F.posexplode(F.arrays_zip("axis", "v")).alias("k", "z"))
    return z.select(*KEYS, "k", rnd("z.axis", 4).alias("energy"), rnd("z.v", 4).alias("value"))
