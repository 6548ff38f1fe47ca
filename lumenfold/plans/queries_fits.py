"""Queries that calibrate and fit recorded spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenfold.functions import scalars as sc
from lumenfold.functions.scalars import rnd
from lumenfold.operators import calibrate as cal
from lumenfold.operators import decompose as dc
from lumenfold.operators import fit as ft
from lumenfold.operators import maps as mp
from lumenfold.operators import points as pt
from lumenfold.plans.bindings import KEYS, PTS, REGIONS, TYPICAL, labelled, map_spectra, recorded_points
from lumenfold.plans.queries_maps import AXIS, BASIS
from lumenfold.plans.queries_spectra import CONVERGED_SQL, SMOOTH_SQL, peaks_sql
from lumenfold.plans.registry import query


def packed(spark, sf):
    return labelled(pt.pack(recorded_points(spark, sf), KEYS))


# ---- calibration ------------------------------------------------------------

def calibration_sql(lo: str, hi: str, target: str) -> str:
    """CTEs ending in ct(sample, n_spectra, peak, shift, status)."""
    return f"""rp AS (SELECT * EXCLUDE (i), row_number() OVER (PARTITION BY instrument, sweep ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY instrument, sweep) AS nn FROM allpts WHERE energy BETWEEN {lo} AND {hi}),
pts AS (SELECT * FROM rp WHERE nn >= 20), {SMOOTH_SQL}, {peaks_sql('sy', 'y')},
mx AS (SELECT s.instrument, s.sweep, any_value(s.sample) AS sample, max(s.y) AS top, max(p.intensity) AS lm FROM sy s JOIN pts p USING (instrument, sweep, i) GROUP BY 1, 2),
k AS (SELECT pk.*, sample, lm, row_number() OVER (PARTITION BY instrument, sweep ORDER BY prom DESC, i) AS rn FROM pk JOIN mx USING (instrument, sweep) WHERE prom >= greatest(1e-6, 1e-1 * top) AND top > 0),
cd AS (SELECT k.sample, k.instrument, k.sweep, k.lm, p.energy AS peak FROM k JOIN pts p ON p.instrument = k.instrument AND p.sweep = k.sweep AND p.i = k.i WHERE rn = 1),
be AS (SELECT sample, peak FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY lm DESC, instrument, sweep) AS rn FROM cd) WHERE rn = 1),
fi AS (SELECT sample, count(*) AS n_spectra FROM (SELECT DISTINCT sample, instrument, sweep FROM allpts) GROUP BY 1),
ct AS (SELECT fi.sample, n_spectra, peak, round({target} - peak, 4) AS shift, CASE WHEN peak IS NULL THEN 'peak_not_found' WHEN abs({target} - peak) > 5 THEN 'exceeds_limit' ELSE 'applied' END AS status FROM fi LEFT JOIN be USING (sample))"""


ALL = PTS.replace("\npts AS", "\nallpts AS")


@query("calibration_carbon", f"WITH {ALL}, {calibration_sql('280', '295', '2848e-1')} SELECT sample, n_spectra, round(peak, 4) + 0e0 AS peak_ev, shift + 0e0 AS attempted_shift_ev, status FROM ct")
def calibration_carbon(spark, sf):
    t = cal.calibration_table(packed(spark, sf), ["sample"], KEYS)
    return t.select("sample", "n_spectra", rnd("peak_ev", 4).alias("peak_ev"), rnd("attempted_shift_ev", 4).alias("attempted_shift_ev"), "status")


@query("calibration_applied", f"""WITH {ALL}, {calibration_sql('280', '295', '2848e-1')} SELECT a.instrument, CAST(a.sweep AS BIGINT) AS sweep, round(min(a.energy) + (CASE WHEN any_value(status) = 'applied' THEN any_value(shift) ELSE 0 END), 3) + 0e0 AS e_lo, count(*) AS n, any_value(status) AS status FROM allpts a JOIN ct USING (sample) GROUP BY 1, 2""")
def calibration_applied(spark, sf):
    t = cal.calibration_table(packed(spark, sf), ["sample"], KEYS)
    p = cal.apply_shift(labelled(recorded_points(spark, sf)), t, ["sample"])
    return p.groupBy(*KEYS).agg(rnd(F.min("energy"), 3).alias("e_lo"), F.count("*").alias("n"), F.max("status").alias("status"))


@query("calibration_metallic", f"WITH {ALL}, {calibration_sql('96', '108', '993e-1')} SELECT sample, n_spectra, round(peak, 4) + 0e0 AS peak_ev, shift + 0e0 AS attempted_shift_ev, status FROM ct")
def calibration_metallic(spark, sf):
    t = cal.calibrate(packed(spark, sf), "metallic_reference", ["sample"], KEYS, line="Si2p")
    return t.select("sample", "n_spectra", rnd("peak_ev", 4).alias("peak_ev"), rnd("attempted_shift_ev", 4).alias("attempted_shift_ev"), "status")


@query("calibration_known_peak", f"WITH {ALL}, {calibration_sql('680', '695', '6875e-1')} SELECT sample, n_spectra, round(peak, 4) + 0e0 AS peak_ev, shift + 0e0 AS attempted_shift_ev, status FROM ct")
def calibration_known_peak(spark, sf):
    t = cal.calibrate(packed(spark, sf), "known_peak", ["sample"], KEYS, line="F1s", known_ev=687.5)
    return t.select("sample", "n_spectra", rnd("peak_ev", 4).alias("peak_ev"), rnd("attempted_shift_ev", 4).alias("attempted_shift_ev"), "status")


@query("calibration_disabled", "SELECT 'S' || (user_id // 5) AS sample, 'disabled' AS status, 0e0 AS applied_shift_ev FROM events GROUP BY 1")
def calibration_disabled(spark, sf):
    t = cal.calibrate(packed(spark, sf), "disable", ["sample"], KEYS)
    return t.select("sample", "status", "applied_shift_ev")


@query("calibration_fermi_edge")
def calibration_fermi_edge(spark, sf):
    """Each sweep becomes an edge at a position that depends on its recording, with the recorded noise on top."""
    edge = (F.pmod("instrument", F.lit(7)) - 3) * 0.1
    p = recorded_points(spark, sf).withColumn("energy", (F.col("i") - 31.5) * 0.03)
    y = sc.fermi_dirac(F.col("energy"), F.lit(100.0), edge, F.lit(0.08), F.lit(5.0)) + 0.002 * F.col("raw")
    d = labelled(pt.pack(p.withColumn("intensity", y), KEYS))
    t = cal.calibrate(d, "fermi_edge", ["sample"], KEYS)
    return t.select("sample", "n_spectra", "peak_ev", "applied_shift_ev", "status")


# ---- templates --------------------------------------------------------------

def templates() -> list[ft.RegionTemplate]:
    """One two-line template per region, wide enough for the recorded shifts."""
    out = []
    for r, e in zip(REGIONS, TYPICAL):
        out += ft.parse_template({"template_name": f"{r}_two_lines", "regions": [{
            "element": r, "fit_range_ev": [e - 12, e + 12], "fwhm_constraint": {"type": "tolerance", "tol": 0.1},
            "components": [
                {"name": "main", "amplitude": {"initial": 80, "min": 0, "max": 500}, "binding_energy": {"initial": e, "min": e - 8, "max": e + 8},
                 "fwhm": {"initial": 1.4, "min": 0.8, "max": 2.2}, "pseudo_voigt_mix": {"initial": 0.1, "min": 0.0, "max": 0.5}},
                {"name": "minor", "amplitude": {"initial": 10, "min": 0, "max": 500}, "binding_energy": {"initial": e + 1.5, "min": e - 7, "max": e + 9},
                 "fwhm": {"initial": 1.4, "min": 0.8, "max": 2.2, "is_constrained": True, "constraint_to": "main"},
                 "pseudo_voigt_mix": {"initial": 0.1, "min": 0.0, "max": 0.5, "is_constrained": True, "constraint_to": "main"}}]}]})
    return out


@query("fit_templates")
def fit_templates(spark, sf):
    return ft.fit_templates(packed(spark, sf), templates(), KEYS, min_points=20)


PARAMS = """par AS (SELECT DISTINCT instrument, sweep, component, amplitude, energy0 + d AS center_ev, fwhm AS fwhm_ev, eta AS eta_mix FROM (SELECT instrument, sweep, energy AS energy0 FROM pts WHERE i = 24),
(VALUES ('main', 90e0, 0e0, 14e-1, 1e-1), ('minor', 20e0, 12e-1, 16e-1, 3e-1), ('trace', 1e-1, -1e0, 1e0, 2e-1)) AS v(component, amplitude, d, fwhm, eta)),
cu AS (SELECT p.instrument, p.sweep, p.i, p.energy, p.intensity, component, amplitude * (eta_mix / (1 + pow((energy - center_ev) / (fwhm_ev / 2), 2)) + (1 - eta_mix) * exp(-pow(energy - center_ev, 2) / (2 * pow(fwhm_ev / (2 * sqrt(2 * ln(2e0))), 2)))) AS curve FROM pts p JOIN par USING (instrument, sweep))"""


def fixed_parameters(spark, sf):
    """Three lines per spectrum around its channel 24."""
    p = recorded_points(spark, sf)
    lines = F.array(*[F.struct(F.lit(n).alias("component"), F.lit(a).alias("amplitude"), F.lit(d).alias("d"), F.lit(w).alias("fwhm_ev"), F.lit(m).alias("eta_mix"))
                      for n, a, d, w, m in (("main", 90.0, 0.0, 1.4, 0.1), ("minor", 20.0, 1.2, 1.6, 0.3), ("trace", 0.1, -1.0, 1.0, 0.2))])
    par = p.filter("i = 24").select(*KEYS, "energy", F.explode(lines).alias("l")).select(
        *KEYS, "l.component", "l.amplitude", (F.col("energy") + F.col("l.d")).alias("center_ev"), "l.fwhm_ev", "l.eta_mix")
    return p, par


@query("fit_evaluation", f"""WITH {PTS}, {PARAMS}, sg AS (SELECT *, (energy - lag(energy) OVER w) * (curve + lag(curve) OVER w) / 2 AS s FROM cu WINDOW w AS (PARTITION BY instrument, sweep, component ORDER BY i)),
ar AS (SELECT instrument, sweep, component, abs(coalesce(sum(s), 0)) AS area FROM sg GROUP BY 1, 2, 3), sh AS (SELECT *, area / sum(area) OVER (PARTITION BY instrument, sweep) * 100 AS pct FROM ar),
fi AS (SELECT instrument, sweep, i, any_value(intensity) AS y, sum(curve) AS f FROM cu GROUP BY 1, 2, 3), r AS (SELECT instrument, sweep, 1 - sum(pow(y - f, 2)) / (var_pop(y) * count(*)) AS r2 FROM fi GROUP BY 1, 2)
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, component, round(area, 4) + 0e0 AS area_counts, round(pct, 4) + 0e0 AS area_percent, round(r2, 5) + 0e0 AS r_squared FROM sh JOIN r USING (instrument, sweep) WHERE pct >= 2""")
def fit_evaluation(spark, sf):
    p, par = fixed_parameters(spark, sf)
    e = ft.evaluate_fit(p, par, KEYS, y="intensity")
    return e.select(*KEYS, "component", rnd("area_counts", 4).alias("area_counts"), rnd("area_percent", 4).alias("area_percent"), rnd("r_squared", 5).alias("r_squared"))


@query("fit_residuals", f"WITH {PTS}, {PARAMS} SELECT instrument, CAST(sweep AS BIGINT) AS sweep, i, round(any_value(intensity) - sum(curve), 5) + 0e0 AS residual FROM cu GROUP BY 1, 2, 3")
def fit_residuals(spark, sf):
    p, par = fixed_parameters(spark, sf)
    return ft.fit_residuals(p, par, KEYS, "intensity").select(*KEYS, "i", rnd("residual", 5).alias("residual"))


@query("fit_compatibility", f"""WITH {PTS}, s0 AS (SELECT *, count(*) OVER (PARTITION BY instrument, sweep) AS n FROM pts), s1 AS (SELECT *, ([{','.join(f'{e - 2:e}' for e in TYPICAL)}])[list_position([{','.join(f"'{r}'" for r in REGIONS)}], region)] AS a FROM s0),
s2 AS (SELECT instrument, sweep, region, count(*) AS n, stddev_pop(CASE WHEN i < greatest(5, n // 10) THEN intensity END) AS noise, max(intensity) - min(intensity) AS span, min(energy) AS e0, max(energy) AS e1, any_value(a) AS a, count(*) FILTER (energy BETWEEN a AND a + 4) AS m,
max(intensity) FILTER (energy BETWEEN a AND a + 4) - min(intensity) FILTER (energy BETWEEN a AND a + 4) AS loc FROM s1 GROUP BY 1, 2, 3)
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, region, n, round(CASE WHEN noise > 0 THEN span / noise ELSE 0 END, 4) + 0e0 AS snr, a >= e0 AND a + 4 <= e1 AS energy_covered, coalesce(m >= 10 AND loc > 15e-1 * noise, FALSE) AS peaks_detectable, n >= 20 AND a >= e0 AND a + 4 <= e1 AS passed FROM s2""")
def fit_compatibility(spark, sf):
    spans = {r: (e - 2.0, e - 2.0 + 4.0) for r, e in zip(REGIONS, TYPICAL)}
    c = ft.compatibility(labelled(recorded_points(spark, sf)), spans, KEYS)
    return c.select(*KEYS, "region", "n", rnd("snr", 4).alias("snr"), "energy_covered", "peaks_detectable", "passed")


@query("fit_template_choice", """SELECT DISTINCT p_name, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'fixed_v1' WHEN 'blue' THEN 'BLUE' ELSE CASE WHEN contains('SMALL_LARGE_V2', upper(split_part(p_name, ' ', 1))) THEN 'small_large_v2' ELSE '-' END END AS template FROM part""")
def fit_template_choice(spark, sf):
    from lumenfold.plans.bindings import table
    p = table(spark, sf, "part").select("p_name").distinct()
    t = ft.choose_template(F.split("p_name", " ")[0], ["BLUE", "small_large_v2"], {"red": "fixed_v1"})
    return p.select("p_name", F.coalesce(t, F.lit("-")).alias("template"))


@query("fit_free_against_template")
def fit_free_against_template(spark, sf):
    p = packed(spark, sf)
    free = p.withColumn("free", ft.fit_free(F.col("energy"), F.col("intensity"), 2)).filter(F.col("free.centers").isNotNull())
    return ft.compare_fits(ft.fit_templates(p, templates(), KEYS, min_points=20), free, KEYS)


@query("fit_average_spectrum")
def fit_average_spectrum(spark, sf):
    mean = np.array(mp.channel_moments(map_spectra(spark, sf)).first()["mean"])
    theta = ft.fit_gaussians(np.array(AXIS), mean, BASIS)
    rows = [(k + 1, *(float(v) for v in theta[3 * k:3 * k + 3]), float(theta[-1])) for k in range(len(BASIS))]
    return spark.createDataFrame(rows, "line int, amplitude double, center_ev double, sigma_ev double, shift_ev double")


@query("fit_pixel_map")
def fit_pixel_map(spark, sf):
    """Average fit, per-pixel baseline, pixel fits on the fixed lines."""
    m = map_spectra(spark, sf)
    mean = np.array(mp.channel_moments(m).first()["mean"])
    theta = ft.fit_gaussians(np.array(AXIS), mean, BASIS)
    base = dc.als_baseline(F.col("intensity"))
    d = m.withColumn("_b", base).withColumn("intensity", F.zip_with("intensity", "_b", lambda v, b: v - b)).drop("_b")
    n = len(BASIS)
    return dc.fit_pixels(d, AXIS, [float(theta[3 * k + 1]) for k in range(n)], [float(theta[3 * k + 2]) for k in range(n)], refine=False) \
        .select("vec_id", "amplitudes", "shift", "mse")


@query("fit_pixel_pipeline")
def fit_pixel_pipeline(spark, sf):
    from lumenfold.plans.pipelines import run_pixel_fits
    peaks = ft.initial_peaks([t for t in templates() if t.region == "C1s"], "c1s")
    r = run_pixel_fits(map_spectra(spark, sf), AXIS, peaks)
    return r.pixels.select("vec_id", "amplitudes", "shift", "mse", "scores", "amounts")


@query("fit_map_components")
def fit_map_components(spark, sf):
    """Decompose a map, fit the component spectra with a template, label them and give their shares."""
    m = map_spectra(spark, sf)
    f = dc.fit_mcr(m, 3)
    rows = [(k, "C1s", AXIS, [float(v) for v in s]) for k, s in enumerate(f.spectra)]
    d = spark.createDataFrame(rows, "component_id int, region string, energy array<double>, intensity array<double>")
    t = [x for x in templates() if x.region == "C1s"]
    fits = ft.fit_templates(d, t, ["component_id"])
    pts = pt.unpack(d).withColumnRenamed("intensity", "corrected")
    areas = ft.evaluate_fit(pts, fits.filter("status in ('ok', 'not_converged')"), ["component_id"])
    lab = ft.label_components(fits, areas, ["component_id"])
    total = lab.agg(F.sum("total_area").alias("_t"))
    return lab.crossJoin(F.broadcast(total)).select(
        "component_id", "label", "total_area", "r_squared", F.when(F.col("_t") > 0, F.col("total_area") / F.col("_t") * 100).alias("percent"))


@query("fit_line_shapes", f"""WITH {PTS} SELECT instrument, CAST(sweep AS BIGINT) AS sweep, i, round(raw * (3e-1 / (1 + pow((i - 203e-1) / 4e0, 2)) + 7e-1 * exp(-pow(i - 203e-1, 2) / (2 * pow(8e0 / (2 * sqrt(2 * ln(2e0))), 2)))), 9) + 0e0 AS voigt,
round(2e0 * exp(-5e-1 * pow((i - 20 - 5e-1) / 3e0, 2)) + 1e0 * exp(-5e-1 * pow((i - 40 - 5e-1) / 5e0, 2)), 6) + 0e0 AS gauss, round(10e0 / (exp((i - 30) / 2e0) + 1) + 1, 6) + 0e0 AS edge FROM pts""")
def fit_line_shapes(spark, sf):
    i = F.col("i").cast("double")
    return recorded_points(spark, sf).select(
        *KEYS, "i", rnd(sc.pseudo_voigt(i, F.col("raw"), F.lit(20.3), F.lit(8.0), F.lit(0.3)), 9).alias("voigt"),
        rnd(sc.gaussian_sum(i, [2.0, 1.0], [20.0, 40.0], [3.0, 5.0], F.lit(0.5)), 6).alias("gauss"),
        rnd(sc.fermi_dirac(i, F.lit(10.0), F.lit(30.0), F.lit(2.0), F.lit(1.0)), 6).alias("edge"))


@query("run_spectra_to_composition", f"""WITH RECURSIVE {PTS}{CONVERGED_SQL}, sg AS (SELECT instrument, sweep, any_value(sample) AS sample, any_value(region) AS region, any_value(layer) AS layer, count(*) AS n, 0 AS z FROM sh GROUP BY 1, 2),
s1 AS (SELECT *, (energy - lag(energy) OVER w) * (intensity - b + lag(intensity - b) OVER w) / 2 AS s FROM sh WINDOW w AS (PARTITION BY instrument, sweep ORDER BY i)), ar AS (SELECT instrument, sweep, abs(coalesce(sum(s), 0)) AS area FROM s1 GROUP BY 1, 2),
f(region, f) AS (VALUES ('C1s', 6631e-3), ('O1s', 16007e-3), ('F1s', 22267e-3), ('N1s', 22814e-3), ('Si2p', 19281e-3)), nm AS (SELECT sample, layer, region, area / f AS q FROM sg JOIN ar USING (instrument, sweep) JOIN f USING (region))
SELECT sample, layer, region, round(CASE WHEN sum(q) OVER w > 0 THEN q / sum(q) OVER w * 100 ELSE 0 END, 4) + 0e0 AS atomic_percent FROM nm WINDOW w AS (PARTITION BY sample, layer)""")
def run_spectra_to_composition(spark, sf):
    """Spectra -> background -> area -> sensitivity factor -> atomic percent, in one plan."""
    from lumenfold.operators.background import background
    from lumenfold.operators.quant import atomic_percent
    from lumenfold.schemas import rsf_table
    p = background(recorded_points(spark, sf), KEYS, "shirley")
    area = labelled(pt.trapezoid(p, KEYS, y="corrected"))
    pct = atomic_percent(area, rsf_table(spark), factor="corrected_rsf")
    return pct.select("sample", "layer", "region", rnd("atomic_percent", 4).alias("atomic_percent"))
