"""Composed runs: from maps to clusters and components, and to fitted lines; any number of maps at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import fixed_values as fv
from lumenfold.functions.scalars import spectrum_entropy
from lumenfold.operators import decompose as dc
from lumenfold.operators import fit as ft
from lumenfold.operators import manymaps as mm
from lumenfold.operators import maps as mp
from lumenfold.operators import peaks as pk
from lumenfold.operators.matrix import Factorisation, PrincipalAxes
from lumenfold.session import join_stats, scratch_path

_COMPONENTS = "component int, spectrum array<double>, r2 double, iterations int, converged boolean, fallback boolean, status string"


@dataclass
class MapRun:
    """pixels: one row per pixel with entropy, mask, cluster and component amounts; the other tables have rows by map.

    components: the component spectra of each map with a status: `masked` (fitted inside the mask) or `all_pixels` (too
    few pixels inside it, so all were taken). Maps that were not decomposed have no row there and null amounts.
    factorisation, decomposed and status are those of a run over a single map (`not_wished`: no decomposition).
    """

    pixels: DataFrame
    variability: DataFrame
    clusters: DataFrame
    components: DataFrame
    factorisation: Factorisation | None = None
    decomposed: bool = False
    cached: list = field(default_factory=list)
    status: str = "not_wished"

    def release(self) -> None:
        """Free the cached tables once the results are written."""
        for df in self.cached:
            df.unpersist()


def run_map(spectra: DataFrame, axis: Sequence[float], region: str, low_counts: float = 2.0, reference: float | None = None,
            n_pca: int = 3, n_clusters: int = 4, focus: Sequence[int] | None = None, key: str = "vec_id",
            force: bool = True, max_components: int = 10) -> MapRun:
    """`run_maps` over the pixels of a single map."""
    return run_maps(spectra, axis, region, (), low_counts, reference, n_pca, n_clusters, focus, key, force, max_components)


def run_maps(spectra: DataFrame, axis: Sequence[float], region: str, maps: Sequence[str], low_counts: float = 2.0,
             reference: float | None = None, n_pca: int = 3, n_clusters: int = 4, focus: Sequence[int] | None = None,
             key: str = "vec_id", force: bool = True, max_components: int = 10) -> MapRun:
    """Variability, entropy, low-count mask, alignment, crop, channel mask, cluster validation, cluster mask, components.

    Every statistic, model and decision is that of a pixel's own map, named by the columns `maps`; all maps share the
    passes. `force` runs the decomposition even for maps where the automatic rule would not; a map has as many
    components as 95 % of its variance need, at most `max_components`. Tables with more maps than the driver can hold
    models of are run in waves of maps, whose results are written to the shared folder.
    """
    waves = mm.waves(spectra, maps, len(axis) * (3 * n_pca + 3 * max_components + n_clusters))
    if waves == 1:
        return _run(spectra, axis, region, list(maps), low_counts, reference, n_pca, n_clusters, focus, key, force, max_components)
    spark, folder = spectra.sparkSession, scratch_path(spectra.sparkSession, "maps")
    spectra.withColumn("_wave", F.pmod(F.xxhash64(*maps), F.lit(waves))).write.partitionBy("_wave").parquet(f"{folder}/input")
    schemas = {}
    for w in range(waves):
        part = spark.read.parquet(f"{folder}/input").where(F.col("_wave") == w).drop("_wave").select(*spectra.columns)
        run = _run(part, axis, region, list(maps), low_counts, reference, n_pca, n_clusters, focus, key, force, max_components)
        for name in ("pixels", "variability", "clusters", "components"):
            table = getattr(run, name)
            schemas[name] = table.schema
            table.write.mode("append").parquet(f"{folder}/{name}")
        run.release()
    return MapRun(*[spark.read.schema(s).parquet(f"{folder}/{name}") for name, s in schemas.items()], status="by_map")


def _run(spectra: DataFrame, axis: Sequence[float], region: str, maps: list[str], low_counts: float, reference: float | None,
         n_pca: int, n_clusters: int, focus: Sequence[int] | None, key: str, force: bool, max_components: int) -> MapRun:
    known = fv.REGION_DEFINITIONS.get(region)
    spread = mp.variability(spectra, maps)
    d = spectra.withColumn("entropy", spectrum_entropy(F.col("intensity")))
    d = d.withColumn("mask", mp.low_count_mask(F.col("intensity"), low_counts))
    d = d.withColumn("intensity", mp.zero_masked(F.col("mask"), F.col("intensity")))
    if reference is not None:
        d = mp.align_to(d, axis, reference)
    if known:
        d, axis = mp.crop(d, axis, known[3], known[4])
        if known[5] is not None:
            d = mp.channel_mask(d, known[5], maps)
    # read by several passes below; recomputed from the source should an executor be lost
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    every = mm.pack(d, maps)
    pca = mm.fit_pca(every, n_pca, change=mm.l1_rows)
    scored = d.withColumn("scores", mm.scores(F.col("intensity"), pca, maps, mm.l1_rows))
    blocks = mm.pack(scored, maps, "scores")
    labelled = mm.cluster(scored, mm.fit_kmeans(blocks, n_clusters), maps).persist(StorageLevel.MEMORY_AND_DISK)
    blocks.release()
    profiles = mp.cluster_profiles(labelled, "cluster", key, "scores", maps=maps)
    lo, hi = (known[3], known[4]) if known else (min(axis), max(axis))
    checked = pk.validate_mean_spectra(profiles.withColumnRenamed("mean_spectrum", "intensity"), axis, lo, hi)
    valid = checked.select(*maps, "cluster", "valid", "peak_ev", "size", "warnings").persist(StorageLevel.MEMORY_AND_DISK)
    cached = [d, labelled, valid]
    wanted = focus if focus is not None else (known[6] if known else None)
    keep = mp.cluster_mask(F.col("cluster"), wanted, n_clusters) if wanted else F.lit(True)
    labelled = join_stats(labelled, valid.select(*maps, "cluster", "valid"), [*maps, "cluster"], "left")
    labelled = labelled.withColumn("mask", F.col("mask") & F.coalesce("valid", F.lit(False)) & keep)
    chosen = set(every.sizes)
    if not force:
        e = mp.entropy_statistics(spectra, maps)
        stats = spread.join(e, maps) if maps else spread.crossJoin(F.broadcast(e))  # one row each
        rule = mp.worth_decomposing(F.col("mean_sigma"), F.col("max_sigma"), F.col("std"))
        chosen &= {r["m"] for r in stats.where(rule).select(mm.map_key(maps).alias("m")).collect()}
    models: dict[str, Factorisation] = {}
    status: dict[str, str] = {}
    if chosen:
        starts = {}
        for m, a in mm.fit_pca(every, max_components).items():
            if m in chosen:
                starts[m] = np.abs(a.axes[:, :dc.component_count(a.ratio, 0.95, most=max_components)].T)
        inside = mm.pack(labelled.filter("mask"), maps)
        found = mm.fit_mcr(inside, {m: s for m, s in starts.items() if m in inside.sizes}, strict=False)
        inside.release()
        status = {m: "masked" for m, f in found.items() if f is not None}
        rest = {m: s for m, s in starts.items() if m not in status}  # no pixel inside the mask, or too few
        again = mm.fit_mcr(every, rest, strict=False) if rest else {}
        status |= {m: "all_pixels" for m, f in again.items() if f is not None}
        models = {m: f for m, f in (found | again).items() if f is not None}
        if not maps and not models:
            raise ValueError("factorisation lost a component; use fewer components")
    every.release()
    out = labelled.withColumn("amounts", mm.concentrations(F.col("intensity"), models, maps)) if models else labelled
    if not models and maps:
        out = out.withColumn("amounts", F.lit(None).cast("array<double>"))
    one = models.get(mm.ALL) if not maps else None
    return MapRun(out.drop("scores", "valid"), spread, valid, _components(spectra, models, status, maps), one, bool(models),
                  cached, status.get(mm.ALL, "not_wished" if not models else "by_map"))


def _components(spectra: DataFrame, models: dict[str, Factorisation], status: dict[str, str], maps: list[str]) -> DataFrame:
    """One row for each component of each map, with the map's key columns."""
    rows = [(m, i + 1, [float(v) for v in s], float(f.r2), f.iterations, f.converged, f.fallback, status[m])
            for m, f in models.items() for i, s in enumerate(f.spectra)]
    table = spectra.sparkSession.createDataFrame(rows, f"map string, {_COMPONENTS}")
    names = [n.split()[0] for n in _COMPONENTS.split(", ")]
    kinds = spectra.select(*maps).schema
    return table.withColumn("map", F.from_json("map", kinds)).select(*[F.col("map")[c].alias(c) for c in maps], *names) if maps else table.select(*names)


@dataclass
class PixelFitRun:
    """pixels: amplitudes, shift, mse, PCA scores and NMF amounts per pixel; the others by the text of a map's key.

    average: the fitted mean spectrum, amplitude, centre and sigma of each line and a common shift.
    """

    pixels: DataFrame
    average: dict[str, np.ndarray]
    axes: dict[str, PrincipalAxes]
    factorisation: dict[str, Factorisation | None]
    cached: list = field(default_factory=list)

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def run_pixel_fits(spectra: DataFrame, axis: Sequence[float], peaks: Sequence[tuple[float, float]], n_pca: int = 3,
                   n_nmf: int = 3, nmf_iterations: int = 500, maps: Sequence[str] = ()) -> PixelFitRun:
    """Average fit, per-pixel baseline, pixel fits on the fixed lines; PCA and NMF on the raw spectra; all by map.

    The mean curve of each map is fitted where Spark holds it; only the lines' parameters reach the driver.
    """
    if not peaks:
        raise ValueError("no initial peaks for this region")
    maps, e = list(maps), np.asarray(axis, float)
    d = spectra.persist(StorageLevel.MEMORY_AND_DISK)

    @F.pandas_udf("array<double>")
    def average(means: pd.Series) -> pd.Series:
        return pd.Series([ft.fit_gaussians(e, np.asarray(v, float), peaks) for v in means])

    means = mp.channel_moments(d, maps).select(mm.map_key(maps).alias("m"), average("mean").alias("theta"))
    theta = {r["m"]: np.asarray(r["theta"]) for r in means.collect()}
    blocks = mm.pack(d, maps)
    pca = mm.fit_pca(blocks, n_pca)
    blocks.release()
    raw = F.transform("intensity", lambda v: F.greatest(v, F.lit(0.0)))
    blocks = mm.pack(d.withColumn("intensity", raw), maps)
    nmf = mm.fit_nmf(blocks, n_nmf, nmf_iterations, strict=not maps)
    blocks.release()
    out = d.withColumn("scores", mm.scores(F.col("intensity"), pca, maps)).withColumn(
        "amounts", mm.concentrations(raw, nmf, maps, exact=True)).withColumn("_base", dc.als_baseline(F.col("intensity")))
    out = out.withColumn("net", F.zip_with("intensity", "_base", lambda v, b: v - b)).drop("_base")
    lines = {m: ([float(t[3 * k + 1]) for k in range(len(peaks))], [float(t[3 * k + 2]) for k in range(len(peaks))]) for m, t in theta.items()}
    fitted = dc.fit_pixels_by_map(out, axis, lines, maps, column="net")
    return PixelFitRun(fitted.drop("net"), theta, pca, nmf, [d])
