"""Sizes, names and ties beyond what the registered queries meet."""

import numpy as np
from pyspark.sql import functions as F

from lumenfold.operators import decompose as dc
from lumenfold.operators import maps as mp
from lumenfold.operators import quant as qn
from lumenfold.operators.ordering import unique_names, with_ordinal
from lumenfold.sources import text as tx


def files(spark, *texts):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    return d.withColumn("lines", F.split("text", "\n"))


def test_a_long_block_is_read_and_a_wrong_count_is_reported(spark):
    def block(count, n):
        return f"C 1s/7\npass energy 20\n3\n{count}\n" + "\n".join(f"{k}.5 {2 * k}" for k in range(n)) + "\n"

    got = {r["id"]: r for r in tx.parse_blocks(files(spark, block(12_000, 12_000), block(5, 5), block(9, 7))).collect()}
    assert [len(got[k]["energy"]) for k in range(3)] == [12_000, 5, 0]
    assert [got[k]["status"] for k in range(3)] == ["ok", "ok", "count_mismatch"]
    assert got[0]["intensity"][-1] == 2 * 11_999


def test_header_dimensions_after_a_long_comment(spark):
    d = files(spark, "\n".join(["# remark"] * 200 + ["nx: 12", "ny = 7"]))
    assert d.select(tx.header_dims(F.col("lines")).alias("d")).first()["d"].asDict() == {"nx": 12, "ny": 7}


def test_unlisted_components_and_regions_stay(spark):
    rows = [("s", "C1s", "a", 1.0), ("s", "C1s", "new", 2.0), ("t", "X9z", "a", 4.0)]
    d = spark.createDataFrame(rows, "sample string, region string, component string, v double")
    got = {r["sample"]: r.asDict() for r in qn.component_features(d, [("C1s", "a")], "v").collect()}
    assert got["s"] == {"sample": "s", "C1s_a_perc": 1.0, "C1s_new_perc": 2.0, "X9z_a_perc": 0.0} and got["t"]["X9z_a_perc"] == 4.0
    p = d.withColumn("component_atomic_percent", F.col("v"))
    t = {r["label"]: r.asDict() for r in qn.chemistry_table(p, "C", ["a"], F.col("sample")).collect()}
    assert t["s"]["total"] == 3.0


def test_ranks_of_a_hot_null_key_and_of_tied_positions(spark):
    rows = [(None, 5, k) for k in range(200)] + [("a", 1, k) for k in range(3)] + [("b", k % 2, k) for k in range(100)]
    d = spark.createDataFrame(rows, "key string, pos int, tie int").repartition(7)
    got = {(r["key"], r["tie"]): r["k"] for r in with_ordinal(d, "key", F.col("pos"), ["tie"], hot_rows=20).collect()}
    assert all(got[None, k] == k for k in range(200)) and all(got["a", k] == k for k in range(3))
    assert all(got["b", k] == (k // 2 if k % 2 == 0 else 50 + k // 2) for k in range(100))
    many = spark.createDataFrame([("x", k) for k in range(150)] + [("y", 0)], "name string, o int").repartition(5)
    names = {(r["name"], r["o"]): r["unique_name"] for r in unique_names(many, "name", ["o"], hot_rows=20).collect()}
    assert names["x", 0] == "x" and names["x", 149] == "x_150" and names["y", 0] == "y"


def test_silhouette_counts_every_pixel(spark):
    rng = np.random.default_rng(3)
    n = 6000
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + 3 * np.eye(3, 4)[label]
    d = spark.createDataFrame([(i, int(a), [float(v) for v in r]) for i, (a, r) in enumerate(zip(label, x, strict=True))],
                              "vec_id long, label int, intensity array<double>")
    got = {r["vec_id"]: r["silhouette"] for r in mp.silhouette(d, "label").collect()}
    assert len(got) == n
    sq = ((x[:40, None, :] - x[None, :, :]) ** 2).sum(2)
    for i in range(40):
        means = [sq[i][label == c].sum() / ((label == c).sum() - (c == label[i])) for c in range(3)]
        a, b = means[label[i]], min(m for c, m in enumerate(means) if c != label[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_euclidean_silhouette_of_more_pixels_than_a_sample(spark):
    rng = np.random.default_rng(6)
    n = 5200
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + np.eye(3, 4)[label]
    rows = [(i, int(a) if i else None, [float(v) for v in r]) for i, (a, r) in enumerate(zip(label, x, strict=True))]
    d = spark.createDataFrame(rows, "vec_id long, label int, intensity array<double>")
    got = {r["vec_id"]: r["silhouette"] for r in mp.sampled_silhouette(d, "label", sample=None).collect()}
    assert len(got) == n and got[0] == 0.0
    inside = [np.flatnonzero(label[1:] == c) + 1 for c in range(3)]
    for i in (1, 2, 3, 2600, 5199):
        away = np.sqrt(((x[i] - x) ** 2).sum(1))
        means = [away[at].sum() / (len(at) - (c == label[i])) for c, at in enumerate(inside)]
        a, b = means[label[i]], min(m for c, m in enumerate(means) if c != label[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-6
    assert mp.sampled_silhouette(d, "label", sample=40).count() == 40


def test_least_squares_of_many_components():
    rng = np.random.default_rng(5)
    basis = rng.random((10, 30))
    c = np.maximum(rng.normal(size=(50, 10)), 0)
    assert np.allclose(dc.nnls_rows(c @ basis, basis), c, atol=1e-6)


def test_quantiles_and_masks_keep_to_their_map(spark):
    from lumenfold.operators import images as im
    from lumenfold.operators import species as sp
    from lumenfold.operators.ordering import grouped_quantile
    rows = [(m, k // 5, k % 5, 1000.0 * m + k) for m in range(3) for k in range(10)]
    d = spark.createDataFrame(rows, "map_id int, y int, x int, value double").repartition(3)
    for hot in (10 ** 6, 4):
        q = {r["map_id"]: r["quantile"] for r in grouped_quantile(d, ["map_id"], "value", 0.75, hot_rows=hot).collect()}
        assert q == {m: 1000.0 * m + 6.75 for m in range(3)}
    on = {r["map_id"]: r["n"] for r in im.threshold_mask(d, ["map_id"], "percentile", 90.0).where("mask").groupBy("map_id").agg(F.count("*").alias("n")).collect()}
    assert on == {0: 1, 1: 1, 2: 1}
    roi = {r["map_id"]: r for r in im.roi_statistics(d.withColumn("mask", F.col("x") < 4), maps=["map_id"]).collect()}
    assert [roi[m]["median"] - 1000.0 * m for m in range(3)] == [4.0] * 3 and roi[1]["area"] == 8
    bad = {r["map_id"]: r["n_problem"] for r in sp.problem_pixels(d.withColumn("mse", F.col("value") - 1000.0 * F.col("map_id")), factor=1.5, maps=["map_id"]).collect()}
    assert bad == {0: 3, 1: 3, 2: 3}
    kept = mp.score_mask(d, "value", 0.5, maps=["map_id"]).where("mask").groupBy("map_id").count().collect()
    assert sorted(tuple(r) for r in kept) == [(m, 5) for m in range(3)]


def test_tasks_of_component_sums_do_not_grow_with_the_table(spark, monkeypatch):
    from lumenfold.plans import bindings
    monkeypatch.setattr(bindings, "TASK_ROWS", 1000)
    c = bindings.components(spark, "/root/testdata/sf0.01")
    rows = bindings.table(spark, "/root/testdata/sf0.01", "lineitem").count()
    assert rows >= 50_000 and c.rdd.getNumPartitions() >= rows // 1000
    assert c.agg(F.sum("area")).first()[0] > 0


def test_shuffles_of_component_sums_stay_below_the_number_that_holds_rows(spark, monkeypatch):
    from lumenfold.plans import bindings
    monkeypatch.setattr(bindings, "TASK_ROWS", 100)
    assert [bindings.parts_for(spark.range(n)) for n in (15_000, 30_000, 80_000, 120_001)] == [150, 200, 200, 301]


def test_total_shares_need_no_sums_by_sample_and_layer(spark):
    from lumenfold.plans import catalog

    d = catalog.QUERIES["quant_component_total_share"](spark, "/root/testdata/sf0.001")
    assert "layer" not in d._jdf.queryExecution().executedPlan().toString()
    assert abs(sum(r["share"] for r in d.collect()) - 100) < 1e-4
