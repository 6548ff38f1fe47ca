"""From decomposed components and fitted peaks to species maps and their shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.ordering import exact_quantile, grouped_quantile
from lumenfold.session import join_stats


def peak_shares(peaks: DataFrame) -> DataFrame:
    """Peaks with area > 0: percent of all areas and fraction within their component (a table of a few rows)."""
    p = peaks.withColumn("_inside", F.sum("area").over(Window.partitionBy("component"))).filter(F.col("area") > 0)
    total = p.agg(F.sum("area").alias("_total"))
    return p.crossJoin(F.broadcast(total)).withColumn("percent", F.col("area") / F.col("_total") * 100.0).withColumn(
        "fraction", F.when(F.col("_inside") > 0, F.col("area") / F.col("_inside")).otherwise(0.0)).drop("_inside", "_total")


def species_table(peaks: DataFrame) -> DataFrame:
    """One row per species; parent -1 when it was merged from several components."""
    return peak_shares(peaks).groupBy("name").agg(
        F.sum("percent").alias("atomic_percent"), F.sum("area").alias("area"), F.avg("center").alias("center_ev"),
        F.avg("fwhm").alias("fwhm_ev"),
        F.when(F.count("*") == 1, F.min("component")).otherwise(-1).alias("parent"))


def species_maps(conc: DataFrame, peaks: DataFrame, pixel: Sequence[str]) -> DataFrame:
    """conc (pixel, component, value) x peaks -> (pixel, name, value).

    Each peak's map is scaled so that its mean over positive pixels is the peak's percent; same names add up.
    The scale needs one aggregate per component; the maps themselves are one more pass.
    """
    mean = conc.groupBy("component").agg(F.avg(F.when(F.col("value") > 0, F.col("value"))).alias("_mean"))
    shares = peak_shares(peaks).select("component", "name", "percent", "fraction")
    # the fraction cancels against the mean of the scaled map wherever both are positive
    factor = F.when((F.col("_mean") > 0) & (F.col("fraction") > 0), F.col("percent") / F.col("_mean")).otherwise(F.col("fraction"))
    scaled = shares.join(mean, "component").withColumn("_f", factor).groupBy("component", "name").agg(F.sum("_f").alias("_f"))
    per_component = scaled.groupBy("component").agg(F.collect_list(F.struct("name", "_f")).alias("_species"))
    d = join_stats(conc, per_component, ["component"]).withColumn("_s", F.explode("_species"))
    return d.groupBy(*pixel, F.col("_s.name").alias("name")).agg(F.sum(F.col("value") * F.col("_s._f")).alias("value"))


def scaled_component_maps(conc: DataFrame, percents: DataFrame) -> DataFrame:
    """Scale each component map so that its mean over positive pixels is the given percent; unscaled without one."""
    mean = conc.groupBy("component").agg(F.avg(F.when(F.col("value") > 0, F.col("value"))).alias("_mean"))
    f = mean.join(percents, "component", "left").select(
        "component", F.when(F.col("_mean") > 0, F.col("percent") / F.col("_mean")).alias("_f"))
    return join_stats(conc, f, ["component"]).withColumn("value", F.col("value") * F.coalesce("_f", F.lit(1.0))).drop("_f")


def dominant_species(maps: DataFrame, pixel: Sequence[str], order: str = "ord", signal: float = 0.01) -> DataFrame:
    """Species with the largest share per pixel (lowest order number on ties), its share and the total signal."""
    v = F.greatest(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)), F.lit(float("-inf")))
    g = maps.withColumn("_v", v).groupBy(*pixel).agg(
        F.sum("_v").alias("total"), F.max_by("name", F.struct("_v", -F.col(order))).alias("species"), F.max("_v").alias("_top"))
    share = F.col("_top") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
    return g.select(*pixel, "species", share.alias("share"), "total", (F.col("total") > signal).alias("has_signal"))


def cluster_indicator(pixels: DataFrame, label: str, pixel: Sequence[str], offset: int = 0) -> DataFrame:
    """Cluster membership as extra component maps with the cluster size as value."""
    sizes = pixels.groupBy(label).agg(F.count("*").cast("double").alias("value"))
    d = join_stats(pixels.select(*pixel, label), sizes, [label])
    return d.select(*pixel, (F.col(label) + offset).cast("int").alias("component"), "value")


def problem_pixels(metrics: DataFrame, mse: str = "mse", factor: float = 3.0, maps: Sequence[str] = ()) -> DataFrame:
    """How many pixels fit worse than `factor` times the exact median of their map, and the mean mse, for each map."""
    if maps:
        limits = grouped_quantile(metrics, maps, mse, 0.5, "_median")
        rows = join_stats(metrics, limits, list(maps), "left").withColumn("_limit", F.col("_median") * factor)
    else:
        median = exact_quantile(metrics, mse, 0.5)
        rows = metrics.withColumn("_limit", F.lit(None if median is None else median * factor).cast("double"))
    return rows.groupBy(*maps).agg(F.count("*").alias("n_pixels"), F.count_if(F.col(mse) > F.col("_limit")).alias("n_problem"),
                                   F.avg(mse).alias("mean_mse"))
