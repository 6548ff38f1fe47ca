"""Ten maps at once, the pixels of each label being one: fits against known truth and against SQL by map."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import scalars as sc
from lumenfold.functions.scalars import rnd
from lumenfold.operators import decompose as dc
from lumenfold.operators import manymaps as mm
from lumenfold.operators import maps as mp
from lumenfold.operators.points import materialise
from lumenfold.plans.bindings import MAP, map_spectra
from lumenfold.plans.pipelines import run_maps, run_pixel_fits
from lumenfold.plans.queries_known import SPECIES, planted_lines, planted_species
from lumenfold.plans.queries_maps import AXIS, BASIS
from lumenfold.plans.registry import query

KEY = ["label"]


@query("maps_principal_axes", f"""WITH {MAP}, t AS (SELECT label, sum(s) AS total FROM (SELECT label, c, var_samp(v) AS s FROM mp GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT label, count(*) AS n, var_samp(CAST(vec_id % 13 AS DOUBLE)) AS planted FROM embeddings GROUP BY 1)
SELECT label, n, round(total, 6) + 0e0 AS total, round(planted, 6) + 0e0 AS planted, round(coalesce(planted / nullif(planted, 0), 0), 6) + 0e0 AS ratio FROM t JOIN p USING (label)""")
def maps_principal_axes(spark, sf):
    """All variances of the recorded maps, and the first one of maps that vary along one direction of their own."""
    m = map_spectra(spark, sf)
    along = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: F.when(c % 10 == F.col("label"), 1.0 / F.sqrt(F.when(F.col("label") < 4, 7.0).otherwise(6.0)))
                        .otherwise(0.0) * F.pmod("vec_id", F.lit(13)) + c)
    recorded, planted = mm.pack(m, KEY), mm.pack(m.withColumn("intensity", along), KEY)
    first = mm.fit_pca(planted, 2)
    rows = [(k, a.n, float(a.variance.sum()), float(first[k].variance[0]), float(first[k].ratio[0])) for k, a in mm.fit_pca(recorded, 64).items()]
    recorded.release()
    planted.release()
    d = spark.createDataFrame(rows, "m string, n long, total double, planted double, ratio double")
    return d.select(F.get_json_object("m", "$.label").cast("int").alias("label"), "n", *[rnd(c, 6).alias(c) for c in ("total", "planted", "ratio")])


@query("maps_kmeans", """WITH g AS (SELECT vec_id % 10 AS m, label % 4 AS g, count(*) AS size, min(vec_id) AS first_id FROM embeddings GROUP BY 1, 2)
SELECT vec_id, size, first_id FROM embeddings JOIN g ON label % 4 = g AND vec_id % 10 = m""")
def maps_kmeans(spark, sf):
    """Groups of each of ten maps, with the recorded values as spread."""
    g = F.pmod("label", F.lit(4))
    m = map_spectra(spark, sf).withColumn("m", F.pmod("vec_id", F.lit(10)))
    d = m.withColumn("scores", F.array(*[F.when(g == k, 50.0).otherwise(0.0) + F.get("intensity", F.lit(k)) for k in range(4)]))
    blocks = mm.pack(d, ["m"], "scores")
    c = mm.cluster(d, mm.fit_kmeans(blocks, 4), ["m"]).select("vec_id", "m", "cluster")
    blocks.release()
    sizes = c.groupBy("m", "cluster").agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id"))
    return c.join(F.broadcast(sizes), ["m", "cluster"]).select("vec_id", "size", "first_id")  # forty rows


def areas(pixels, components):
    """Areas of both channel ranges in the model: amounts times the component spectra of the pixel's map."""
    low, high = (sc.array_sum(F.slice("spectrum", k, 32)) for k in (1, 33))
    sums = components.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("component", low.alias("low"), high.alias("high")))).alias("_s"))
    d = pixels.join(F.broadcast(sums), KEY)  # ten maps

    def area(n):
        return rnd(sc.array_sum(F.zip_with("amounts", "_s", lambda a, s: a * s[n])), 0).alias(n)

    return d.select("vec_id", area("low"), area("high"))


def as_rows(spark, models):
    rows = [(m, i + 1, [float(v) for v in s]) for m, f in models.items() for i, s in enumerate(f.spectra)]
    d = spark.createDataFrame(rows, "m string, component int, spectrum array<double>")
    return d.withColumn("label", F.get_json_object("m", "$.label").cast("int"))


@query("maps_nmf", SPECIES)
def maps_nmf(spark, sf):
    m = planted_species(spark, sf)
    blocks = mm.pack(m, KEY)
    models = mm.fit_nmf(blocks, 2)
    blocks.release()
    return areas(m.withColumn("amounts", mm.concentrations(F.col("intensity"), models, KEY, exact=True)), as_rows(spark, models))


@query("maps_run", SPECIES)
def maps_run(spark, sf):
    """The whole map run over ten maps; two species in each."""
    r = run_maps(planted_species(spark, sf), AXIS, "none", KEY)
    return areas(r.pixels, r.components)


@query("maps_pixel_fits", """SELECT label, count(*) AS n, CAST(1 AS INTEGER) AS line, 284e0 AS center_ev, 1e0 AS sigma_ev, round(avg(1 + 1e-1 * (vec_id % 13)), 4) + 0e0 AS amplitude FROM embeddings GROUP BY 1
UNION ALL SELECT label, count(*), 2, 2885e-1, 12e-1, round(5e-1 + 2e-1 * label, 4) + 0e0 FROM embeddings GROUP BY 1""")
def maps_pixel_fits(spark, sf):
    """Average lines of ten maps, as the pixel fits of each map use them."""
    r = run_pixel_fits(planted_lines(spark, sf, F.lit(0.0)), AXIS, BASIS, n_nmf=2, nmf_iterations=20, maps=KEY)
    rows = [(m, k + 1, *(float(v) for v in t[3 * k:3 * k + 3]), float(t[-1])) for m, t in r.average.items() for k in range(len(BASIS))]
    lines = spark.createDataFrame(rows, "m string, line int, a double, c double, w double, s double").withColumn("label", F.get_json_object("m", "$.label").cast("int"))
    n = r.pixels.where("size(amplitudes) = 2").groupBy("label").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(lines), "label").select("label", "n", "line", rnd(F.col("c") + F.col("s"), 3).alias("center_ev"),
                                                      rnd("w", 3).alias("sigma_ev"), rnd("a", 4).alias("amplitude"))


@query("maps_silhouette", f"""WITH {MAP}, g AS (SELECT vec_id % 10 AS m, label, c, avg(v) AS mean, avg(v * v) AS sq FROM mp GROUP BY 1, 2, 3),
n AS (SELECT vec_id % 10 AS m, label, count(*) AS n FROM embeddings GROUP BY 1, 2),
d AS (SELECT mp.vec_id, mp.label AS own, g.label AS other, sum((v - mean) * (v - mean) + sq - mean * mean) AS d FROM mp JOIN g ON mp.vec_id % 10 = g.m AND mp.c = g.c GROUP BY 1, 2, 3),
s AS (SELECT d.vec_id, max(n.n) FILTER (own = other) AS n, max(d * n.n / nullif(n.n - 1, 0)) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM d JOIN n ON d.vec_id % 10 = n.m AND n.label = d.other GROUP BY 1)
SELECT vec_id, round(coalesce(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 0), 5) + 0e0 AS silhouette FROM s""")
def maps_silhouette(spark, sf):
    m = map_spectra(spark, sf).withColumn("m", F.pmod("vec_id", F.lit(10)))
    return mp.silhouette(m, "label", maps=["m"]).select("vec_id", rnd("silhouette", 5).alias("silhouette"))


@query("maps_summary", f"""WITH {MAP}, t AS (SELECT vec_id, label, sum(v) AS s, count(*) AS k FROM mp GROUP BY 1, 2)
SELECT label, count(*) AS n_pixels, CAST(max(k) AS INTEGER) AS n_energy, count(*) FILTER (s > 0) AS n_nonzero, round(avg(s) FILTER (s > 0), 6) + 0e0 AS mean_area,
round(stddev_pop(s) FILTER (s > 0), 6) + 0e0 AS std_area, 'hyperspectral' AS kind, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) + 0e0 AS percent FROM t GROUP BY 1""")
def maps_summary(spark, sf):
    """Summary of each map, and its share of all pixels as the cluster sizes give it."""
    m = map_spectra(spark, sf)
    s = mp.map_summary(m, AXIS, maps=KEY).select("label", "n_pixels", "n_energy", "n_nonzero", rnd("mean_area", 6).alias("mean_area"), rnd("std_area", 6).alias("std_area"), "kind")
    return s.join(mp.cluster_sizes(m, "label").select("label", rnd("percent", 6).alias("percent")), "label")


def overlapping(k):
    """k Gaussian lines over 64 channels, each as wide as two neighbours are apart or wider."""
    return [[2.718281828459045 ** (-0.5 * ((c - 5 - j * 54.0 / (k - 1)) / 10.0) ** 2) for c in range(64)] for j in range(k)]


@query("known_nnls", """WITH k AS (SELECT unnest([10, 20]) AS k), j AS (SELECT k, unnest(range(k)) AS j FROM k), c AS (SELECT unnest(range(64)) AS c),
b AS (SELECT k, j, c, exp(-5e-1 * pow((c - 5 - j * 54e0 / (k - 1)) / 1e1, 2e0)) AS b FROM j, c),
y AS (SELECT vec_id, k, c, sum(CASE WHEN (vec_id + 3 * j) % 4 = 0 THEN 0 ELSE (vec_id * (j + 1)) % 11 END * b) AS y FROM embeddings, b GROUP BY 1, 2, 3)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(y), 3) + 0e0 AS area, round(sum(c * y), 2) + 0e0 AS moment FROM y GROUP BY 1, 2""")
def known_nnls(spark, sf):
    """Pixels made of 10 and of 20 overlapping lines: the non-negative model gives their area and first moment back."""
    out = None
    for k in (10, 20):
        basis = overlapping(k)
        lines = F.array(*[F.array(*[F.lit(v) for v in b]) for b in basis])
        amount = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when((F.col("vec_id") + 3 * j) % 4 == 0, 0.0).otherwise((F.col("vec_id") * (j + 1)) % 11).cast("double"))
        m = map_spectra(spark, sf).withColumn("a", amount).withColumn("intensity", F.aggregate(
            F.arrays_zip(F.col("a").alias("a"), lines.alias("b")), F.array_repeat(F.lit(0.0), 64), lambda s, z: F.zip_with(s, z["b"], lambda p, q: p + z["a"] * q)))
        m = materialise(m.select("vec_id", "intensity"), intensity=F.col("intensity"))
        fit = dc.project(F.col("intensity"), basis)
        area, moment = (F.array(*[F.lit(float(sum(v * c ** p for c, v in enumerate(b)))) for b in basis]) for p in (0, 1))
        d = m.select("vec_id", F.lit(k).alias("k"), fit.alias("c")).select("vec_id", "k", *[
            rnd(sc.array_sum(F.zip_with("c", w, lambda a, v: a * v)), digits).alias(n) for n, w, digits in (("area", area, 3), ("moment", moment, 2))])
        out = d if out is None else out.unionByName(d)
    return out
