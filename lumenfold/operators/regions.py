"""Validity, scan types, region detection and extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.peaks import interval_join


def spectrum_stats(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One aggregate that most gates share."""
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("energy").alias("e_lo"), F.max("energy").alias("e_hi"),
        F.min("intensity").alias("y_lo"), F.max("intensity").alias("y_hi"), F.avg("intensity").alias("y_mean"),
        F.stddev_pop("intensity").alias("y_std"), F.count_if(F.col("intensity") == 0).alias("n_zero"),
        F.count_if(F.col("energy").isNull() | F.isnan("energy")).alias("n_bad_energy"))


def is_valid(allow_zero: bool = False) -> Column:
    """Predicate over spectrum_stats."""
    ok = (F.col("n") >= 2) & F.col("e_lo").between(0, 1500) & F.col("e_hi").between(0, 1500)
    if not allow_zero:
        ok = ok & (F.col("n_zero") < F.col("n"))
    ratio = F.when(F.col("y_std") > 0, F.col("y_mean") / F.col("y_std")).otherwise(0.0)
    return ok & ((F.col("y_mean") <= 0) | (ratio >= 0.1))


def scan_type(span: Column, n: Column, pass_energy: Column, survey_ev: float = 100.0, narrow_ev: float = 50.0,
              narrow_resolution: float = 4.0, survey_pass: float = 100.0, narrow_pass: float = 50.0) -> Column:
    """survey / narrow / auto, from pass energy when known, else from span and point density."""
    density = F.when(span > 0, n / span).otherwise(0.0)
    by_pass = (F.when(pass_energy >= survey_pass, "survey")
               .when((pass_energy <= narrow_pass) & (span < narrow_ev), "narrow").otherwise("auto"))
    by_span = (F.when(span > survey_ev, "survey")
               .when((span < narrow_ev) & (density > narrow_resolution), "narrow").otherwise("auto"))
    return F.when(pass_energy.isNotNull(), by_pass).otherwise(by_span)


def detect_regions(points: DataFrame, defs: DataFrame, keys: Sequence[str], min_intensity: float = 10.0,
                   hr_resolution: float = 4.0) -> DataFrame:
    """Regions present per spectrum. `points` carries scan_type and all_zero per spectrum."""
    hit = interval_join(points, defs.select(F.col("region").alias("detected"), "e_min", "e_max"),
                        "energy", "e_min", "e_max")
    g = hit.groupBy(*keys, "scan_type", "all_zero", "detected", "e_min", "e_max").agg(
        F.count("*").alias("n_points"), F.max("intensity").alias("max_intensity"))
    density = F.col("n_points") / (F.col("e_max") - F.col("e_min"))
    present = (
        F.when(F.col("scan_type") == "survey", F.col("all_zero") | (F.col("max_intensity") > min_intensity))
        .when(F.col("scan_type") == "narrow", (density > hr_resolution) & (F.col("max_intensity") > min_intensity))
        .otherwise(False))
    return g.filter(present).select(*keys, "detected", "n_points", "max_intensity")


def extract_regions(points: DataFrame, wanted: DataFrame, keys: Sequence[str], padding: float = 2.0,
                    min_points: int = 5) -> DataFrame:
    """Points inside each wanted region, padded except for survey scans; fewer than 5 points drop the region.

    `wanted` has keys, region, e_min, e_max, scan_type: one row per spectrum and region.
    """
    pad = F.when(F.col("scan_type") == "survey", 0.0).otherwise(padding)
    hit = points.join(wanted.withColumn("_pad", pad), list(keys)).filter(
        F.col("energy").between(F.col("e_min") - F.col("_pad"), F.col("e_max") + F.col("_pad")))
    from lumenfold.operators.points import whole
    g = whole([*keys, "region"])
    span = F.max("energy").over(g) - F.min("energy").over(g)
    return (
        hit.withColumn("n_points", F.count("*").over(g))
        .withColumn("resolution", F.when(span > 0, F.col("n_points") / span))
        .filter(F.col("n_points") >= min_points)
        .drop("_pad", "e_min", "e_max")
    )


def chosen_region(label: Column, known: Column, detected: Column) -> Column:
    """A recognised label wins over detection."""
    return F.when(known, label).otherwise(detected)


def kinetic_to_binding(points: DataFrame, photon_ev: float, scale: str = "energy_scale") -> DataFrame:
    """Convert rows whose scale column says kinetic, drop negative binding energies."""
    be = F.when(F.col(scale) == "kinetic", F.lit(photon_ev) - F.col("energy")).otherwise(F.col("energy"))
    return points.withColumn("energy", be).filter(F.col("energy") >= 0)
