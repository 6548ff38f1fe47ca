import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import background as bg
from lumenfold.operators import correlate as co
from lumenfold.operators import decompose as dc
from lumenfold.operators import maps as mp
from lumenfold.operators import fit as ft
from lumenfold.operators import smooth as sm
from lumenfold.operators.peaks import find_peaks
from lumenfold.operators.resample import interpolate


def voigt(x, a, c, w, m):
    t = x - c
    return a * (m / (1 + (t / (w / 2)) ** 2) + (1 - m) * np.exp(-t**2 / (2 * (w / 2.3548200450309493) ** 2)))


def test_nnls_matches_brute_force():
    rng = np.random.default_rng(0)
    b = rng.random((4, 12))
    x = rng.normal(size=(30, 12))
    c = dc.nnls_rows(x, b)
    for r in range(30):
        best = (x[r] ** 2).sum()
        for k in range(1, 5):
            for on in itertools.combinations(range(4), k):
                s = np.linalg.lstsq(b[list(on)].T, x[r], rcond=None)[0]
                if (s >= 0).all():
                    best = min(best, ((x[r] - s @ b[list(on)]) ** 2).sum())
        assert np.isclose(((x[r] - c[r] @ b) ** 2).sum(), best)
    assert np.allclose(dc.nnls_rows(x, np.vstack([b, np.zeros((6, 12))]))[:, :4] @ b, c @ b, atol=1e-5)


def test_als_baseline_matches_dense_solve():
    rng = np.random.default_rng(1)
    y = rng.random((5, 40)) + np.linspace(0, 3, 40)
    d = np.diff(np.eye(40), 2, axis=0)
    for r, got in enumerate(dc.als_batch(y, 100.0, 0.01, 10)):
        w = np.ones(40)
        for _ in range(10):
            b = np.linalg.solve(np.diag(w) + 100.0 * d.T @ d, w * y[r])
            w = 0.01 * (y[r] > b) + 0.99 * (y[r] < b)
        assert np.allclose(got, b, atol=1e-8)


def test_shirley_stays_below_and_converges():
    x = np.linspace(280, 292, 90)
    y = voigt(x, 50, 285, 1.5, 0.2) + 20 / (1 + np.exp(-(x - 285) * 3)) + 5
    b = bg.shirley_batch(x[None], y[None])[0]
    assert (b <= y + 1e-12).all()
    assert np.isclose(b[0], y[:7].mean(), atol=0.2) and np.isclose(b[-1], min(y[-1], y[-7:].mean()), atol=0.2)


def test_tougaard_against_loops():
    x = np.sort(np.random.default_rng(2).random(15) * 20)
    y = np.random.default_rng(3).random(15)
    for last in (False, True):
        got = bg.tougaard_curve(x, y, 2866.0, 1643.0, last)
        for i in range(15):
            end = i + 1 if last else i
            t = x[i] - x[:end]
            want = np.trapezoid(y[:end] * 2866.0 * t / (1643.0 + t * t) ** 2, x[:end]) if end > 1 else 0.0
            assert np.isclose(got[i], want)


def test_savgol_keeps_a_parabola(spark):
    y = [0.5 * k * k - 3 * k + 2 for k in range(25)]
    d = spark.createDataFrame([(y,)], "y array<double>").select(sm.savgol(F.col("y"), 7, 2, 20).alias("s")).first()
    assert np.allclose(d["s"], y)
    short = spark.createDataFrame([([1.0, 5.0, 2.0],)], "y array<double>").select(sm.savgol(F.col("y")).alias("s")).first()
    assert short["s"] == [1.0, 5.0, 2.0]


def test_peaks_plateau_and_edges(spark):
    y = [5.0, 1.0, 3.0, 3.0, 3.0, 2.0, 4.0, 0.0, 9.0]
    p = find_peaks(spark.createDataFrame([(y,)], "intensity array<double>")).first()["peaks"]
    assert [(r["i"], r["prominence"]) for r in p] == [(3, 1.0), (6, 3.0)]
    for flat in ([], [1.0], [2.0, 2.0, 2.0, 2.0], [1.0, 2.0]):
        assert find_peaks(spark.createDataFrame([(flat,)], "intensity array<double>")).first()["peaks"] == []


def test_interpolate_matches_numpy(spark):
    x, y = [1.0, 2.0, 4.0, 7.0], [0.0, 3.0, -1.0, 2.0]
    g = [0.0, 1.0, 1.5, 2.0, 3.9, 4.0, 6.0, 7.0, 9.0]
    d = spark.createDataFrame([(x, y, g)], "x array<double>, y array<double>, g array<double>")
    assert np.allclose(d.select(interpolate(F.col("x"), F.col("y"), F.col("g")).alias("v")).first()["v"], np.interp(g, x, y))


def test_p_value(spark):
    assert np.isclose(co.incomplete_beta(4.0, 0.5, 1 - 0.25), 0.14111, atol=1e-4)
    d = spark.createDataFrame([(0.5, 10), (0.0, 30), (0.9, 2)], "r double, n long").select(co.two_sided_p("r", "n").alias("p"))
    p = [r["p"] for r in d.collect()]
    assert np.isclose(p[0], 0.14111, atol=1e-4) and np.isclose(p[1], 1.0) and (p[2] is None or np.isnan(p[2]))


def low_rank(k, n=400, p=48, seed=0):
    rng = np.random.default_rng(seed)
    e = np.linspace(0, 1, p)
    s = np.stack([np.exp(-0.5 * ((e - (j + 0.7) / k) / 0.07) ** 2) for j in range(k)])
    c = rng.dirichlet(np.full(k, 0.4), size=n) * rng.uniform(1, 5, size=(n, 1))
    return c, s, c @ s


@pytest.mark.parametrize("k", [2, 3])
def test_factorisations_recover_low_rank(spark, k):
    _, s, x = low_rank(k)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, intensity array<double>").repartition(3)
    for f in (dc.fit_mcr(d, k), dc.fit_nmf(d, k, iterations=60)):
        assert f.r2 > 0.995 and (f.spectra >= 0).all()
        unit = f.spectra / np.linalg.norm(f.spectra, axis=1, keepdims=True)
        assert ((unit @ (s / np.linalg.norm(s, axis=1, keepdims=True)).T).max(0) > 0.98).all()


def test_pca_matches_svd(spark):
    x = np.random.default_rng(5).normal(size=(200, 10)) @ np.diag(np.arange(1, 11))
    d = spark.createDataFrame([(v.tolist(),) for v in x], "intensity array<double>").repartition(4)
    pca = dc.fit_pca(d, 3)
    u, w, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(pca.ratio, (w**2 / (w**2).sum())[:3])
    assert np.allclose(np.abs(pca.axes.T), np.abs(vt[:3]), atol=1e-8)


def test_component_count():
    assert dc.component_count([0.9, 0.06, 0.02], 0.95) == 2
    assert dc.component_count([0.99, 0.01], 0.95) == 2
    assert dc.component_count([0.3, 0.2, 0.1], 0.95) == 3  # never reached: the most there is
    assert dc.component_count([0.9, 0.06, 0.02], 0.95, closure=True) == 3


def test_pixel_fit_finds_shift(spark):
    e = np.linspace(280, 292, 64)
    y = 3.0 * np.exp(-0.5 * ((e - 284.13) / 1.0) ** 2) + 1.5 * np.exp(-0.5 * ((e - 288.63) / 1.2) ** 2)
    d = spark.createDataFrame([(y.tolist(),)], "intensity array<double>")
    r = dc.fit_pixels(d, e.tolist(), [284.0, 288.5], [1.0, 1.2]).first()
    assert np.isclose(r["shift"], 0.13, atol=2e-3) and np.allclose(r["amplitudes"], [3.0, 1.5], atol=0.02)


def template(**region):
    line = {"amplitude": {"initial": 40, "min": 0, "max": 400}, "fwhm": {"initial": 1.5, "min": 0.8, "max": 2.5},
            "pseudo_voigt_mix": {"initial": 0.3, "min": 0.0, "max": 0.9}}
    comps = [{"name": "a", "binding_energy": {"initial": 284.5, "min": 283, "max": 286}, **line},
             {"name": "b", "binding_energy": {"initial": 287.2, "min": 286, "max": 289}, **line},
             {"name": "off", "enabled": False}]
    return {"template_name": "t", "regions": [{"element": "C1s", "fit_range_ev": [292, 279], "components": comps, **region}]}


def fit_one(spark, raw, truth, noise=0.0):
    x = np.round(np.arange(279, 292, 0.1), 4)
    y = sum(voigt(x, *p) for p in truth) + noise * np.random.default_rng(0).normal(size=len(x)) + 3.0
    d = spark.createDataFrame([(1, "C1s", x.tolist(), y.tolist())], "id long, region string, energy array<double>, intensity array<double>")
    return {r["component"]: r for r in ft.fit_templates(d, ft.parse_template(raw), ["id"]).collect()}


def test_template_fit_recovers_parameters(spark):
    f = fit_one(spark, template(), [(100, 284.8, 1.3, 0.2), (40, 287.5, 1.6, 0.4)], 0.2)
    assert set(f) == {"a", "b"} and f["a"]["r_squared"] > 0.995
    assert abs(f["a"]["center_ev"] - 284.8) < 0.03 and abs(f["b"]["center_ev"] - 287.5) < 0.06
    assert abs(f["a"]["amplitude"] - 100) < 6 and abs(f["a"]["fwhm_ev"] - 1.3) < 0.12


def test_template_constraints(spark):
    raw = template(fwhm_constraint={"type": "uniform"})
    c = raw["regions"][0]["components"]
    c[1] = {**c[1], "amplitude": {"is_constrained": True, "constraint_to": "a", "constraint_ratio": 0.5},
            "pseudo_voigt_mix": {"is_constrained": True, "constraint_to": "a", "initial": 0.2, "min": 0.1, "max": 0.6}}
    f = fit_one(spark, raw, [(80, 284.6, 1.4, 0.3), (40, 287.4, 1.4, 0.3)])
    assert np.isclose(f["b"]["amplitude"], 0.5 * f["a"]["amplitude"])
    assert np.isclose(f["b"]["fwhm_ev"], f["a"]["fwhm_ev"]) and np.isclose(f["b"]["eta_mix"], f["a"]["eta_mix"])
    tol = template(fwhm_constraint={"type": "tolerance", "tol": 0.05})
    tol["regions"][0]["components"][1]["fwhm"] = {"initial": 1.4, "min": 0.9, "max": 2.2, "is_constrained": True, "constraint_to": "a"}
    f = fit_one(spark, tol, [(80, 284.6, 1.2, 0.3), (60, 287.4, 2.2, 0.3)])
    assert f["b"]["fwhm_ev"] / f["a"]["fwhm_ev"] <= 1.05 / 0.95 + 1e-9


def test_template_errors():
    raw = template()
    raw["regions"][0]["components"][1]["pseudo_voigt_mix"] = {"min": 0.95, "max": 1.0, "is_constrained": True, "constraint_to": "a"}
    with pytest.raises(ValueError):
        ft.compile_template(ft.parse_template(raw)[0])
    with pytest.raises(ValueError):
        ft.parse_template({"regions": [{"element": "x"}]})


def test_fit_statuses(spark):
    d = spark.createDataFrame([(1, "O1s", [1.0] * 9, [1.0] * 9), (2, "C1s", [284.0, 285.0], [1.0, 2.0]), (3, None, [], [])],
                              "id long, region string, energy array<double>, intensity array<double>")
    got = {r["id"]: r["status"] for r in ft.fit_templates(d, ft.parse_template(template()), ["id"]).collect()}
    assert got == {1: "no_template", 2: "too_few_points", 3: "no_template"}


def test_fermi_edge(spark):
    e = np.linspace(-1.2, 1.2, 80)
    y = 50 / (np.exp((e - 0.21) / 0.07) + 1) + 4
    d = spark.createDataFrame([(e.tolist(), y.tolist()), ([0.0], [1.0])], "e array<double>, y array<double>")
    r = [x["f"] for x in d.select(ft.fit_edge(F.col("e"), F.col("y")).alias("f")).collect()]
    assert np.isclose(r[0]["edge_ev"], 0.21, atol=1e-4) and (r[1]["edge_ev"] is None or np.isnan(r[1]["edge_ev"]))


def test_average_fit():
    e = np.linspace(280, 292, 64)
    y = 3 * np.exp(-0.5 * ((e - 284.2) / 0.9) ** 2) + 2 * np.exp(-0.5 * ((e - 288.1) / 1.1) ** 2)
    t = ft.fit_gaussians(e, y, [(284.0, 1.0), (288.3, 1.0)])
    assert np.allclose([t[1] + t[6], t[4] + t[6]], [284.2, 288.1], atol=1e-3) and np.allclose([t[2], t[5]], [0.9, 1.1], atol=1e-3)


def test_even_axes_by_convolution_equal_all_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 64, 301):
        x = np.stack([280 + 0.1 * np.arange(n), 10 + 0.25 * np.arange(n), np.sort(rng.random(n)) * 20])
        y = rng.random((3, n)) * 100
        for last in (True, False):
            got = bg.tougaard_batch(x, y, 2866.0, 1643.0, last)
            t = x[:, :, None] - x[:, None, :]
            g = y[:, None, :] * 2866.0 * t / (1643.0 + t * t) ** 2
            seg = np.diff(x, axis=1)[:, None, :] / 2 * (g[:, :, :-1] + g[:, :, 1:])
            assert np.allclose(got, (seg * np.tri(n, n - 1, -1 if last else -2)).sum(2), rtol=1e-10, atol=1e-9)


def test_correlation_lags_equal_sums():
    rng = np.random.default_rng(4)
    for p in (2, 5, 64):
        x, r = rng.normal(size=(6, p)), rng.normal(size=p)
        want = [[sum(v[i] * r[i - lag] for i in range(p) if 0 <= i - lag < p) for lag in range(-(p - 1), p)] for v in x]
        assert np.allclose(mp.correlation_lags(x, r), want, atol=1e-10)


def shirley_as_written(x, y, max_steps=100, tol=1e-6):
    """The background in plain floats, every sum from its first term to its last, as in the SQL."""
    n = len(y)
    m = max(1, min(7, n // 5))
    left, right = sum_in_order(y[:m]) / m, sum_in_order(y[n - m:]) / m
    b = [left + (right - left) * j / (n - 1) for j in range(n)]
    for _ in range(max_steps):
        seg = [(x[j + 1] - x[j]) * ((y[j] - b[j]) + (y[j + 1] - b[j + 1])) / 2 for j in range(n - 1)]
        s = [sum_in_order(seg[j:]) for j in range(n)]
        new = [right + (left - right) * v / (s[0] + 1e-15) for v in s]
        change = sum((p - q) ** 2 for p, q in zip(new, b)) ** 0.5 / (sum(q * q for q in b) ** 0.5 + 1e-15)
        b = new
        if change < tol:
            break
    return [min(p, q) for p, q in zip(b, y)]


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total


def test_shirley_of_a_curve_without_net_peak_keeps_the_last_digits():
    x = np.array([286.9, 287.0, 287.1, 287.2, 287.3])
    y = np.array([4.930546262790251, 1.127437982056861, 0.3133859994828204, 7.2557491118182895, 15.735592013947283])
    b = bg.shirley_batch(x[None], y[None])[0]
    assert b.tolist() == shirley_as_written(x.tolist(), y.tolist()) and round((y - b).max() / ((y - b).std() + 1e-10), 4) == 0.0001


def test_areas_that_are_only_rounding_noise_have_the_written_digits():
    """Shares of such areas are shares of the noise, so the background has to add in the written order."""
    rng = np.random.default_rng(4)
    for n in (3, 4, 5, 7):
        x, y = np.round(687.0 + 0.1 * np.arange(n), 4), rng.random((100, n)) * 20.0
        found = bg.shirley_batch(np.repeat(x[None], 100, 0), y)
        assert [r.tolist() for r in found] == [shirley_as_written(x.tolist(), r.tolist(), 100) for r in y]


def test_memory_of_fits_does_not_grow_with_the_batch(monkeypatch):
    import tracemalloc
    rng = np.random.default_rng(8)
    n = 6000
    x = np.tile(np.linspace(-1.0, 1.0, 64), (n, 1))
    y = 100.0 / (np.exp((x - rng.normal(0.0, 0.2, (n, 1))) / 0.08) + 1.0) + 5.0 + rng.normal(0.0, 0.2, x.shape)
    start, lo, hi = (np.tile(v, (n, 1)) for v in ([0.0, 0.1, 95.0, 5.0], [-1.0, 0.01, -np.inf, -np.inf], [1.0, 5.0, np.inf, np.inf]))
    ended = np.zeros(n, dtype=bool)
    tracemalloc.start()
    theta, ss = ft.bounded_lm(ft.edge_model(), start, lo, hi, x, y, np.ones_like(x), steps=6, ended=ended)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    monkeypatch.setattr(ft, "SLICE_BYTES", 1 << 40)
    whole = np.zeros(n, dtype=bool)
    want, sw = ft.bounded_lm(ft.edge_model(), start, lo, hi, x, y, np.ones_like(x), steps=6, ended=whole)
    assert np.array_equal(theta, want) and np.array_equal(ss, sw) and np.array_equal(ended, whole)
