import numpy as np
from pyspark.sql import functions as F

from lumenfold.operators import correlate as co
from lumenfold.operators import decompose as dc
from lumenfold.operators import fit as ft
from lumenfold.plans.pipelines import run_map
from tests.test_kernels import voigt


def test_forest_and_permutation_importance(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random(400), rng.random(400)
    y = 3 * a + 0.05 * rng.normal(size=400)
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(a, b, y))], "sample long, a double, b double, y double")
    train, test = co.split_by_hash(d, "sample")
    assert train.count() + test.count() == 400 and 40 < test.count() < 120
    assert sorted(test.repartition(7).collect()) == sorted(co.split_by_hash(d.repartition(5), "sample")[1].collect())
    model = co.fit_forest(train, ["a", "b"], "y", trees=20, depth=5)
    top = co.importances(model, ["a", "b"]).collect()
    assert top[0]["feature"] == "a" and top[0]["importance"] > 0.8
    p = {r["feature"]: r for r in co.permutation_importance(model, test, ["a", "b"], "y", repeats=3).collect()}
    assert p["a"]["importance_mean"] > 0.5 > abs(p["b"]["importance_mean"]) and p["a"]["importance_std"] >= 0


def test_a_forest_in_waves(spark, monkeypatch):
    rng = np.random.default_rng(0)
    a, b = rng.random(400), rng.random(400)
    y = 3 * a + 0.05 * rng.normal(size=400)
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(a, b, y))], "sample long, a double, b double, y double")
    train, test = co.split_by_hash(d, "sample")
    whole = {r["feature"]: r["importance"] for r in co.importances(co.fit_forest(train, ["a", "b"], "y", trees=6, depth=5), ["a", "b"]).collect()}
    one = {r["feature"]: r["importance"] for r in co.importances_in_waves(co.forest_waves(train, ["a", "b"], "y", 6, 5), ["a", "b"]).collect()}
    assert all(abs(one[f] - v) < 0.05 for f, v in whole.items())
    monkeypatch.setattr(co, "WAVE_NODES", 4 * train.count())
    models = list(co.forest_waves(train, ["a", "b"], "y", 5, 5))
    assert [m.getNumTrees for m in models] == [2, 2, 1]
    cells = co.permuted(test, ["a", "b"], "y", repeats=2)
    assert cells.count() == 5 * test.count()
    p = {r["feature"]: r for r in co.permutation_loss(co.predict_in_waves(models, cells), ["a", "b"], "y").collect()}
    assert p["a"]["importance_mean"] > 0.5 > abs(p["b"]["importance_mean"])
    x = cells.where("_f is null").select("features", "y")
    want = sorted(sum(t.predict(r["features"]) for m in models for t in m.trees) / 5 for r in x.collect())
    assert np.allclose(sorted(r["prediction"] for r in co.predict_in_waves(models, x).collect()), want)


def test_cluster_separates_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(g * 50 + k, g, (10.0 * np.eye(3)[g] + 0.1 * rng.normal(size=3)).tolist()) for g in range(3) for k in range(50)]
    d = spark.createDataFrame(rows, "id long, truth int, scores array<double>")
    pairs = dc.cluster(d, k=3, seed=0).groupBy("truth", "cluster").count().collect()
    assert len(pairs) == 3 and all(r["count"] == 50 for r in pairs)


def test_free_fit_finds_two_peaks(spark):
    x = np.arange(280, 292, 0.1)
    y = voigt(x, 100, 284.8, 1.3, 0.2) + voigt(x, 60, 288.2, 1.5, 0.2) + 4 + 0.5 * x
    d = spark.createDataFrame([(1, x.tolist(), y.tolist()), (2, [1.0], [1.0])], "id long, energy array<double>, intensity array<double>")
    r = {v["id"]: v["free"] for v in d.select("id", ft.fit_free(F.col("energy"), F.col("intensity"), 2).alias("free")).collect()}
    assert np.allclose(r[1]["centers"], [284.8, 288.2], atol=0.05) and r[1]["r_squared"] > 0.999
    assert r[2]["centers"] is None


def test_failed_components_keep_a_row(spark):
    fits = spark.createDataFrame([(0, "a", "ok"), (1, None, "too_few_points")], "cid int, component string, status string")
    areas = spark.createDataFrame([(0, "a", 5.0, 0.9), (0, "b", 7.0, 0.9)], "cid int, component string, area_counts double, r_squared double")
    got = {r["cid"]: r for r in ft.label_components(fits, areas, ["cid"]).collect()}
    assert got[0]["label"] == "b" and got[0]["total_area"] == 12.0
    assert got[1]["label"].endswith("FitFailed") and got[1]["total_area"] == 0.0


def test_map_run_on_two_phases(spark):
    e = 280.0 + 0.1875 * np.arange(64)
    s = np.stack([voigt(e, 100, 284.8, 1.4, 0.2), voigt(e, 80, 289.0, 1.6, 0.2)])
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        dark, left = k % 30 == 0, k % 2 == 0
        c = np.array([0.9, 0.1]) if left else np.array([0.2, 0.8])
        v = np.zeros(64) if dark else np.maximum(c @ s * rng.uniform(0.8, 1.2) + 0.2 * rng.normal(size=64), 0)
        rows.append((k, k // 20, k % 20, v.tolist()))
    d = spark.createDataFrame(rows, "vec_id long, y int, x int, intensity array<double>").repartition(3)
    run = run_map(d, e.tolist(), "C1s", n_clusters=3)
    px = {r["vec_id"]: r for r in run.pixels.collect()}
    run.release()
    assert len(px) == 300 and run.factorisation.r2 > 0.98
    assert not any(px[k]["mask"] for k in range(0, 300, 30)) and sum(r["mask"] for r in px.values()) == 290
    kinds = [{px[k]["cluster"] for k in range(300) if k % 30 and k % 2 == p} for p in (0, 1)]
    assert len(kinds[0]) == 1 and len(kinds[1]) == 1 and kinds[0] != kinds[1]
