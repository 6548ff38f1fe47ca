"""Fits and factorisations of curves that are built without noise from table values, against those values."""

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
from lumenfold.plans.bindings import KEYS, PTS, labelled, map_spectra, recorded_points
from lumenfold.plans.queries_maps import AXIS, BASIS
from lumenfold.plans.registry import query


@query("known_fermi_edge", f"""WITH {PTS}, f AS (SELECT instrument, sweep, any_value(sample) AS sample FROM pts GROUP BY 1, 2 HAVING count(*) = 64)
SELECT sample, count(*) AS n_spectra, round((arg_max(instrument, instrument % 5) % 7 - 3) * 1e-1, 3) + 0e0 AS peak_ev FROM f GROUP BY 1""")
def known_fermi_edge(spark, sf):
    """Edges at positions that depend on the recording; the recording with the highest step decides for its sample."""
    edge = (F.pmod("instrument", F.lit(7)) - 3) * 0.1
    p = recorded_points(spark, sf).withColumn("energy", (F.col("i") - 31.5) * 0.03)
    height = F.lit(100.0) + 20 * F.pmod("instrument", F.lit(5))
    y = height / (F.exp((F.col("energy") - edge) / 0.08) + 1) + 5.0
    d = labelled(pt.pack(p.withColumn("intensity", y), KEYS)).where(F.size("energy") == 64)
    t = cal.calibrate(d, "fermi_edge", ["sample"], KEYS)
    return t.select("sample", "n_spectra", rnd("peak_ev", 3).alias("peak_ev"))


def planted_lines(spark, sf, shift):
    """Pixels that are two Gaussian lines with amplitudes and a shift from the pixel's number and label."""
    m = map_spectra(spark, sf).withColumns({"p": 1 + 0.1 * F.pmod("vec_id", F.lit(13)), "q": 0.5 + 0.2 * F.col("label"), "s": shift})
    axis = F.array(*[F.lit(float(e)) for e in AXIS])
    (c1, w1), (c2, w2) = BASIS
    y = F.transform(axis, lambda e: F.col("p") * F.exp(-0.5 * F.pow((e - c1 - F.col("s")) / w1, 2.0))
                    + F.col("q") * F.exp(-0.5 * F.pow((e - c2 - F.col("s")) / w2, 2.0)))
    return m.withColumn("intensity", y)


@query("known_pixel_fit", """SELECT vec_id, round(1 + 1e-1 * (vec_id % 13), 2) + 0e0 AS a, round(5e-1 + 2e-1 * label, 2) + 0e0 AS b, round((vec_id % 41 - 20) * 1e-2, 2) + 0e0 AS shift FROM embeddings""")
def known_pixel_fit(spark, sf):
    m = planted_lines(spark, sf, (F.pmod("vec_id", F.lit(41)) - 20) * 0.01)
    f = dc.fit_pixels(m, AXIS, [c for c, _ in BASIS], [w for _, w in BASIS])
    return f.select("vec_id", rnd(F.get("amplitudes", F.lit(0)), 2).alias("a"), rnd(F.get("amplitudes", F.lit(1)), 2).alias("b"), rnd("shift", 2).alias("shift"))


@query("known_average_fit", """WITH m AS (SELECT avg(1 + 1e-1 * (vec_id % 13)) AS a, avg(5e-1 + 2e-1 * label) AS b FROM embeddings)
SELECT CAST(1 AS INTEGER) AS line, round(a, 4) + 0e0 AS amplitude, 284e0 AS center_ev, 1e0 AS sigma_ev FROM m UNION ALL SELECT 2, round(b, 4) + 0e0, 2885e-1, 12e-1 FROM m""")
def known_average_fit(spark, sf):
    mean = np.array(mp.channel_moments(planted_lines(spark, sf, F.lit(0.0))).first()["mean"])
    theta = ft.fit_gaussians(np.array(AXIS), mean, BASIS)
    rows = [(k + 1, *(float(v) for v in theta[3 * k:3 * k + 3]), float(theta[-1])) for k in range(len(BASIS))]
    d = spark.createDataFrame(rows, "line int, amplitude double, c double, w double, s double")
    return d.select("line", rnd("amplitude", 4).alias("amplitude"), rnd(F.col("c") + F.col("s"), 3).alias("center_ev"), rnd("w", 3).alias("sigma_ev"))


@query("known_kmeans", """WITH g AS (SELECT label % 4 AS g, count(*) AS size, min(vec_id) AS first_id FROM embeddings GROUP BY 1) SELECT vec_id, size, first_id FROM embeddings JOIN g ON label % 4 = g""")
def known_kmeans(spark, sf):
    """Four groups far apart, with the recorded values as spread: k-means has to find them."""
    m = map_spectra(spark, sf)
    g = F.pmod("label", F.lit(4))
    d = m.withColumn("scores", F.array(*[F.when(g == k, 50.0).otherwise(0.0) + F.get("intensity", F.lit(k)) for k in range(4)]))
    c = dc.cluster(d, k=4, seed=0).select("vec_id", "cluster")
    sizes = c.groupBy("cluster").agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id"))
    return c.join(F.broadcast(sizes), "cluster").select("vec_id", "size", "first_id")  # four rows


def planted_species(spark, sf):
    """Two species in separate channels, with pixels of each alone."""
    m = map_spectra(spark, sf)
    p = F.when(F.pmod("vec_id", F.lit(5)) == 0, 0.0).otherwise(1.0 + F.pmod("vec_id", F.lit(7)))
    q = F.when(F.pmod("vec_id", F.lit(5)) == 1, 0.0).otherwise(1.0 + F.col("label"))
    return m.withColumn("intensity", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: F.when(
        c < 32, p * (1 + F.pmod(c, F.lit(3)))).otherwise(q * (1 + F.pmod(c, F.lit(4))))))


SPECIES = """WITH s AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 + vec_id % 7 END AS p, CASE WHEN vec_id % 5 = 1 THEN 0 ELSE 1 + label END AS q FROM embeddings)
SELECT vec_id, round(p * 63, 0) + 0e0 AS low, round(q * 80, 0) + 0e0 AS high FROM s"""


def areas_of(m, f):
    """Areas of both channel ranges in the model: amounts times component spectra."""
    low, high = (F.array(*[F.lit(float(v)) for v in f.spectra[:, part].sum(axis=1)]) for part in (slice(0, 32), slice(32, 64)))
    d = m.withColumn("amounts", dc.concentrations(F.col("intensity"), f.spectra, exact=True))
    return d.select("vec_id", *[rnd(sc.array_sum(F.zip_with("amounts", w, lambda a, v: a * v)), 0).alias(n) for n, w in (("low", low), ("high", high))])


@query("known_nmf", SPECIES)
def known_nmf(spark, sf):
    m = planted_species(spark, sf)
    return areas_of(m, dc.fit_nmf(m, 2))


@query("known_mcr", SPECIES)
def known_mcr(spark, sf):
    m = planted_species(spark, sf)
    return areas_of(m, dc.fit_mcr(m, 2))
