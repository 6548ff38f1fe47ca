"""Local maxima, prominence, nearest-state and interval joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.points import materialise

def find_peaks(packed: DataFrame, y: str = "intensity", out: str = "peaks") -> DataFrame:
    """Add ARRAY<STRUCT<i, height, prominence>> of inner local maxima (plateaus count once, at their middle)."""
    a = F.col(y)
    n = F.size(a)
    inner = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))

    def plateau_end(k: Column) -> Column:
        """Last index of the run of equal values that starts at k."""
        run = F.aggregate(
            F.sequence(k, n - 1), F.struct(k.alias("r"), F.lit(True).alias("go")),
            lambda s, j: F.struct(
                F.when(s["go"] & (F.get(a, j) == F.get(a, k)), j).otherwise(s["r"]).alias("r"),
                (s["go"] & (F.get(a, j) == F.get(a, k))).alias("go")))
        return run["r"]

    rises = F.filter(inner, lambda k: F.get(a, k) > F.get(a, k - 1))
    runs = F.transform(rises, lambda k: F.struct(
        k.alias("a"), F.when(F.get(a, k + 1) != F.get(a, k), k).otherwise(plateau_end(k)).alias("b")))
    tops = F.filter(runs, lambda r: (r["b"] < n - 1) & (F.get(a, r["b"] + 1) < F.get(a, r["b"])))
    mids = F.transform(tops, lambda r: F.floor((r["a"] + r["b"]) / 2).cast("int"))

    def base(path: Column, k: Column) -> Column:
        walk = F.aggregate(
            path, F.struct(F.get(a, k).alias("m"), F.lit(True).alias("go")),
            lambda s, j: F.when(s["go"] & (F.get(a, j) <= F.get(a, k)),
                                F.struct(F.least(s["m"], F.get(a, j)).alias("m"), F.lit(True).alias("go")))
            .otherwise(F.struct(s["m"].alias("m"), F.lit(False).alias("go"))))
        return walk["m"]

    peaks = F.transform(mids, lambda k: F.struct(
        k.alias("i"), F.get(a, k).alias("height"),
        (F.get(a, k) - F.greatest(base(F.sequence(k - 1, F.lit(0)), k), base(F.sequence(k + 1, n - 1), k)))
        .alias("prominence")))
    none = F.array().cast("array<struct<i:int,height:double,prominence:double>>")
    return materialise(packed, **{out: F.when(n >= 3, peaks).otherwise(none)})


def dominant_peak(peaks: Column, threshold: Column) -> Column:
    """Most prominent peak at or above the threshold, the first one on ties; NULL when there is none."""
    kept = F.filter(peaks, lambda p: p["prominence"] >= threshold)
    best = F.array_max(F.transform(kept, lambda p: F.struct(
        p["prominence"].alias("prominence"), (-p["i"]).alias("m"), p["height"].alias("height"))))
    return F.when(F.size(kept) > 0, F.struct(
        (-best["m"]).alias("i"), best["height"].alias("height"), best["prominence"].alias("prominence")))


def interval_join(points: DataFrame, intervals: DataFrame, value: str, lo: str, hi: str, width: float = 4.0) -> DataFrame:
    """Point-in-interval inner join as an equi-join on cells of `width`, so no nested loop is planned.

    Only the intervals are copied, once per cell they touch; each point has one cell, so no pair appears twice.
    The interval side is a table of definitions and is broadcast by Spark itself when its size allows.
    """
    cells = intervals.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col(lo) / width).cast("bigint"), F.floor(F.col(hi) / width).cast("bigint"))))
    keyed = points.withColumn("_cell", F.floor(F.col(value) / width).cast("bigint"))
    return keyed.join(cells, "_cell").filter(F.col(value).between(F.col(lo), F.col(hi))).drop("_cell")


#: States that may be written into a plan as literals.
FEW_STATES = 500


def nearest_state(peaks: DataFrame, states: DataFrame, row_keys: Sequence[str], value: str = "energy",
                  centre: str = "state_ev", label: str = "state", tolerance: float = 1.0) -> DataFrame:
    """Label each peak with the closest state with |difference| < tolerance; `Unknown` when none is in reach.

    A NULL position means that no peak was found and gives `(no peak)`. Ties go to the smaller state energy. Up to
    FEW_STATES states become an array in the plan, so the peaks are neither joined nor shuffled.
    """
    few = states.select(F.col(centre).cast("double"), F.col(label).cast("string")).where(F.col(centre).isNotNull()).limit(FEW_STATES + 1).collect()
    if len(few) <= FEW_STATES:
        kind = "array<struct<c: double, l: string>>"
        known = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(s).alias("l")) for c, s in few]).cast(kind)
        gaps = F.transform(known, lambda s: F.struct(F.abs(F.col(value) - s["c"]).alias("gap"), s["c"].alias("c"), s["l"].alias("l")))
        best = F.array_min(F.filter(gaps, lambda g: g["gap"] < tolerance))
        found = peaks.withColumn("_p", best)
        name = F.when(F.col(value).isNull(), "(no peak)").otherwise(F.coalesce(F.col("_p.l"), F.lit("Unknown")))
        return found.withColumn(label, name).withColumn("gap", F.col("_p.gap")).drop("_p")
    width = float(tolerance)
    near = states.select(F.col(centre), F.col(label)).withColumn("_cell", F.explode(F.sequence(
        (F.floor(F.col(centre) / width) - 1).cast("bigint"), (F.floor(F.col(centre) / width) + 1).cast("bigint"))))
    keyed = peaks.withColumn("_cell", F.floor(F.col(value) / width).cast("bigint"))
    joined = keyed.join(near, "_cell", "left")
    gap = F.abs(F.col(value) - F.col(centre))
    pick = F.min(F.when(gap < tolerance, F.struct(gap.alias("gap"), F.col(centre).alias("c"), F.col(label).alias("l"))))
    rest = [c for c in peaks.columns if c not in row_keys]
    out = joined.groupBy(*row_keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest], pick.alias("_p"))
    name = F.when(F.col(value).isNull(), "(no peak)").otherwise(F.coalesce(F.col("_p.l"), F.lit("Unknown")))
    return out.withColumn(label, name).withColumn("gap", F.col("_p.gap")).drop("_p")


FWHM_PER_SIGMA = 2.0 * math.sqrt(2.0 * math.log(2.0))


def validate_mean_spectra(means: DataFrame, axis: Sequence[float], lo: float, hi: float, min_fwhm: float = 0.5,
                          y: str = "intensity") -> DataFrame:
    """Cluster mean spectra: only empty or dark ones are rejected; position and width just warn.

    The main peak is the highest local maximum with 5 % prominence, else with 1 %, else the highest channel.
    """
    top = F.array_max(y)
    d = find_peaks(means, y)

    def highest(share: float) -> Column:
        kept = F.filter("peaks", lambda p: p["prominence"] >= share * top)
        best = F.array_max(F.transform(kept, lambda p: F.struct(p["height"].alias("h"), (-p["i"]).alias("m"))))
        return -best["m"]

    at = F.coalesce(highest(0.05), highest(0.01), F.array_position(F.col(y), top).cast("int") - 1)
    energy = F.array(*[F.lit(float(e)) for e in axis])
    d = d.withColumn("_k", at).withColumn("valid", F.coalesce((F.size(y) > 0) & (top >= 1e-6), F.lit(False)))
    d = d.withColumn("peak_ev", F.get(energy, F.col("_k")))
    half = F.get(y, F.col("_k")) / 2.0
    n = F.size(y)
    # channels around the peak that stay above half its height
    left = F.aggregate(F.sequence(F.col("_k"), F.lit(0), F.lit(-1)), F.struct(F.col("_k").alias("i"), F.lit(True).alias("go")),
                       lambda s, j: F.struct(F.when(s["go"] & (F.get(y, j) >= half), j).otherwise(s["i"]).alias("i"),
                                             (s["go"] & (F.get(y, j) >= half)).alias("go")))["i"]
    right = F.aggregate(F.sequence(F.col("_k"), n - 1), F.struct(F.col("_k").alias("i"), F.lit(True).alias("go")),
                        lambda s, j: F.struct(F.when(s["go"] & (F.get(y, j) >= half), j).otherwise(s["i"]).alias("i"),
                                              (s["go"] & (F.get(y, j) >= half)).alias("go")))["i"]
    width = (F.get(energy, right) - F.get(energy, left)).cast("double")
    outside = ~F.col("peak_ev").between(lo, hi)
    return d.withColumn("fwhm_ev", F.abs(width)).withColumn("out_of_range", outside).withColumn(
        "warnings", F.array_compact(F.array(F.when(outside, "peak outside expected range"),
                                            F.when(F.abs(width) < min_fwhm, "narrow peak")))).drop("_k", "peaks")
