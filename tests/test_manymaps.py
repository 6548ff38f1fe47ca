"""Many maps at once against one map at a time, numpy and the conditions of optimality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import manymaps as mm
from lumenfold.operators import maps as mp
from lumenfold.operators import nnls
from lumenfold.plans import pipelines


def brute_nnls(x, b):
    best, value = np.zeros(len(b)), 0.0
    for bits in range(1, 1 << len(b)):
        on = [j for j in range(len(b)) if bits >> j & 1]
        c = np.linalg.lstsq(b[on].T, x, rcond=None)[0]
        v = ((x - c @ b[on]) ** 2).sum() - (x * x).sum()
        if (c >= 0).all() and v < value:
            best, value = np.zeros(len(b)), v
            best[on] = c
    return best


@pytest.mark.parametrize("k", [1, 2, 5, 8])
def test_nnls_against_all_supports(k):
    rng = np.random.default_rng(k)
    b = np.abs(rng.standard_normal((k, 20)))
    x = 2 * rng.standard_normal((40, 20)) + 0.5 * b.sum(0)
    want = np.stack([brute_nnls(v, b) for v in x])
    assert np.allclose(nnls.nnls_rows(x, b), want, atol=1e-9)
    assert np.allclose(nnls.nnls_each(x, np.repeat(b[None], 40, 0)), want, atol=1e-9)
    assert np.allclose(np.stack([nnls._one_by_one(b @ b.T, b @ v) for v in x]), want, atol=1e-9)


@pytest.mark.parametrize("k", [9, 10, 20, 40])
def test_nnls_of_many_overlapping_lines_is_optimal(k):
    rng = np.random.default_rng(k)
    c = np.arange(128.0)
    b = np.stack([np.exp(-0.5 * ((c - 5 - j * 118 / (k - 1)) / 10) ** 2) for j in range(k)])
    x = (np.abs(rng.standard_normal((100, k))) * (rng.random((100, k)) < 0.5)) @ b
    for noise in (0.0, 0.05):
        y = x + noise * rng.standard_normal(x.shape)
        assert nnls.kkt_residual(nnls.nnls_rows(y, b), y, b).max() < (1e-9 if k <= 20 else 1e-6)  # 40 lines are alike to the last digit
    few = y[:20]
    assert nnls.kkt_residual(nnls.nnls_each(few, np.repeat(b[None], 20, 0)), few, b).max() < (1e-9 if k <= 20 else 1e-6)


def test_nnls_odd_rows():
    b = np.stack([np.ones(4), 2 * np.ones(4), np.zeros(4)])
    got = nnls.nnls_rows(np.array([[1.0, 1, 1, 1], [0, 0, 0, 0], [-1, -1, -1, -1]]), b)
    assert np.allclose(got @ b, [[1] * 4, [0] * 4, [0] * 4], atol=1e-6) and (got >= 0).all()
    assert nnls.nnls_rows(np.zeros((0, 4)), b).shape == (0, 3) and nnls.nnls_each(np.zeros((0, 4)), np.zeros((0, 3, 4))).shape == (0, 3)


def phases(spark, n=240, maps=4, channels=30):
    """Mixtures of two bands; map m has bands of its own."""
    rng = np.random.default_rng(0)
    c = np.arange(channels)
    rows = []
    for i in range(n):
        m = i % maps
        s = np.stack([np.exp(-0.5 * ((c - p) / 3) ** 2) for p in (6 + m, 20 + m)]) * 50
        w = np.array([1.0, 0.1]) if i % 8 < 4 else np.array([0.2, 1.5])
        rows.append((i, m, None if i == 17 else (w * rng.uniform(0.5, 1.5, 2) @ s + 0.01).tolist()))
    return spark.createDataFrame(rows, "vec_id long, m int, intensity array<double>").repartition(5)


def fits(blocks):
    pca = mm.fit_pca(blocks, 2)
    nmf = mm.fit_nmf(blocks, 2, iterations=4)
    mcr = mm.fit_mcr(blocks, {m: np.abs(a.axes[:, :2].T) for m, a in pca.items()}, iterations=4)
    return pca, nmf, mcr, mm.fit_kmeans(blocks, 2, steps=4)


def test_maps_in_one_task_over_passes_and_alone_agree(spark, monkeypatch):
    d = phases(spark)
    blocks = mm.pack(d, ["m"])
    assert blocks.sizes == {f'{{"m":{m}}}': (59 if m == 1 else 60, 30) for m in range(4)}
    local = fits(blocks)
    monkeypatch.setattr(mm, "LOCAL_BYTES", 0)
    passes = fits(blocks)
    monkeypatch.setattr(mm, "DRIVER_BYTES", 0)
    summed = fits(blocks)
    for m in range(4):
        alone = mm.pack(d.where(F.col("m") == m))
        single = fits(alone) if m == 1 else None
        alone.release()
        for other, key in ((passes, f'{{"m":{m}}}'), (summed, f'{{"m":{m}}}'), (single, mm.ALL))[:3 if m == 1 else 2]:
            mine = [x[f'{{"m":{m}}}'] for x in local]
            p, n, r, k = (x[key] for x in other)
            assert np.allclose(p.axes, mine[0].axes, atol=1e-7) and np.allclose(p.variance, mine[0].variance) and p.n == mine[0].n
            assert np.allclose(n.spectra, mine[1].spectra, rtol=1e-4, atol=1e-4) and abs(n.r2 - mine[1].r2) < 1e-6 and mine[1].r2 > 0.95
            assert np.allclose(r.spectra, mine[2].spectra, rtol=1e-4, atol=1e-4)
            assert np.allclose(k, mine[3], atol=1e-6)
    blocks.release()


def test_ten_maps_take_no_more_jobs_than_one(spark, monkeypatch):
    monkeypatch.setattr(mm, "LOCAL_BYTES", 0)
    d = phases(spark, 200, 10)
    tracker = spark.sparkContext.statusTracker()

    def jobs(maps):
        blocks = mm.pack(d, maps)
        group = f"jobs-{len(maps)}"
        spark.sparkContext.setJobGroup(group, group)
        for m in (mm.fit_nmf(blocks, 2, iterations=4, tol=-1.0), mm.fit_kmeans(blocks, 2, steps=3)):
            assert len(m) == (10 if maps else 1)
        spark.sparkContext.setJobGroup("none", "none")
        blocks.release()
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(["m"]) <= jobs([]) + 1


def test_wide_spectra_by_projection(spark, monkeypatch):
    """More channels than second moments are kept for: a low-rank map gives the same variances, and 20,000 channels fit."""
    rng = np.random.default_rng(4)
    rank, p = 5, 200
    x = rng.standard_normal((150, rank)) @ (rng.standard_normal((rank, p)) * np.array([9, 5, 3, 2, 1])[:, None]) + 7
    d = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, m int, intensity array<double>").repartition(3)
    blocks = mm.pack(d, ["m"])
    want = mm.fit_pca(blocks, 4)
    monkeypatch.setattr(mm, "MAX_CHANNELS", 100)
    for most in (1 << 25, 0):
        monkeypatch.setattr(mm, "LOCAL_BYTES", most)
        for m, a in mm.fit_pca(blocks, 4).items():
            assert np.allclose(a.variance, want[m].variance, rtol=1e-8) and np.allclose(a.ratio, want[m].ratio, rtol=1e-8)
            assert np.allclose(a.axes, want[m].axes, atol=1e-6) and np.allclose(np.abs(a.leading.T @ want[m].leading), np.eye(4), atol=1e-6)
    blocks.release()
    monkeypatch.undo()
    wide = d.select("id", F.expr("flatten(array_repeat(intensity, 100))").alias("intensity"))
    blocks = mm.pack(wide)
    got = mm.fit_pca(blocks, 3)[mm.ALL]
    blocks.release()
    centred = x - x.mean(0)
    assert len(got.mean) == 20_000 and np.allclose(got.variance, 100 * np.linalg.svd(centred)[1][:3] ** 2 / 149, rtol=1e-8)


def test_runs_over_maps_in_waves(spark, monkeypatch):
    d = phases(spark).withColumn("intensity", F.coalesce("intensity", F.array_repeat(F.lit(0.0), 30))).withColumn("y", F.lit(0)).withColumn("x", F.col("vec_id"))
    axis = list(range(30))
    run = pipelines.run_maps(d, axis, "none", ["m"], n_clusters=2)
    once = {r["vec_id"]: r for r in run.pixels.collect()}
    parts = {(r["m"], r["component"]): r for r in run.components.collect()}
    run.release()
    assert len(once) == 240 and {m for m, _ in parts} == {0, 1, 2, 3} and all(r["status"] == "masked" and r["r2"] > 0.99 for r in parts.values())
    assert not once[17]["mask"] and sum(r["mask"] for r in once.values()) == 239
    monkeypatch.setattr(mm, "WAVE_BYTES", 8 * 30 * 50 * 2)
    waved = pipelines.run_maps(d, axis, "none", ["m"], n_clusters=2)
    assert mm.waves(d, ["m"], 30 * 41) == 2
    for r in waved.pixels.collect():
        assert r["cluster"] == once[r["vec_id"]]["cluster"] and np.allclose(r["amounts"], once[r["vec_id"]]["amounts"], rtol=1e-6, atol=1e-9)
    assert waved.components.count() == len(parts) and waved.variability.count() == 4 and waved.clusters.count() == 8
    quiet = pipelines.run_maps(d.withColumn("intensity", F.transform("intensity", lambda v: v * 0.001)), axis, "none", ["m"], n_clusters=2, force=False, low_counts=0.0)
    assert quiet.components.count() == 0 and {r["amounts"] for r in quiet.pixels.collect()} == {None}


def test_single_pixels_in_their_cluster(spark):
    d = spark.createDataFrame([(1, 0, 0, [1.0]), (2, 0, 1, [2.0]), (3, 1, 0, [5.0]), (4, 1, 1, [7.0]), (5, 1, 1, [7.5])], "vec_id long, m int, label int, intensity array<double>")
    got = {r["vec_id"]: r["silhouette"] for r in mp.silhouette(d, "label", maps=["m"]).collect()}
    assert got[1] == got[2] == got[3] == 0.0 and got[4] == 1 - 0.25 / 4 and abs(got[5] - (1 - 0.25 / 6.25)) < 1e-12
    assert {(r["m"], r["label"]): r["percent"] for r in mp.cluster_sizes(d, "label", ["m"]).collect()}[0, 1] == 50.0
