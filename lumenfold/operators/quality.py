"""Quality gates and per-spectrum quality metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.background import quadratic_coefficients, shirley, shirley_steps, solve_quadratic
from lumenfold.operators.ordering import exact_quantile
from lumenfold.operators.points import along, whole

ISSUE = "struct<level:string,category:string,message:string,value:double,threshold:double>"


@dataclass(frozen=True)
class Thresholds:
    """One explicit set of limits for every gate."""

    min_points: int = 10
    min_energy_range: float = 5.0
    snr_critical: float = 1.0
    snr_excellent: float = 10.0
    snr_good: float = 5.0
    snr_acceptable: float = 3.0
    snr_poor: float = 1.0
    hr_resolution: float = 5.0
    min_map_side: int = 2
    max_dead_fraction: float = 0.05
    peak_snr_poor: float = 2.0
    peak_snr_acceptable: float = 3.0
    peak_snr_good: float = 10.0
    peak_snr_excellent: float = 20.0
    fit_resolution: float = 3.0
    min_peak_to_baseline: float = 0.2
    max_relative_noise: float = 0.2
    max_shift_ev: float = 5.0
    min_file_bytes: int = 100
    max_file_bytes: int = 500_000_000


def issue(when: Column, level: str, category: str, message: str, value: Column | None = None,
          threshold: float | None = None) -> Column:
    v = value.cast("double") if value is not None else F.lit(None).cast("double")
    t = F.lit(float(threshold)) if threshold is not None else F.lit(None).cast("double")
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"),
                                 F.lit(message).alias("message"), v.alias("value"), t.alias("threshold")))


def issues_of(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def count_level(issues: Column, level: str) -> Column:
    return F.size(F.filter(issues, lambda x: x["level"] == level))


def universal_issues(t: Thresholds = Thresholds()) -> Column:
    """Rules over spectrum_stats that hold for any data."""
    snr, n, span = F.col("snr_gate"), F.col("n"), F.col("e_hi") - F.col("e_lo")
    return issues_of(
        issue(n == 0, "critical", "data", "no points", n, t.min_points),
        issue((n > 0) & (n < t.min_points), "critical", "data", "too few points", n, t.min_points),
        issue(span < t.min_energy_range, "warning", "energy", "narrow energy range", span, t.min_energy_range),
        issue(F.col("n_bad_energy") > 0, "critical", "energy", "energy axis not finite"),
        issue(snr < t.snr_critical, "critical", "snr", "signal to noise unusable", snr, t.snr_critical),
        issue((snr >= t.snr_critical) & (snr < t.snr_acceptable), "warning", "snr", "signal to noise low", snr,
              t.snr_acceptable),
    )


def spectrum_issues(t: Thresholds = Thresholds()) -> Column:
    """Further rules for single spectra."""
    flat = (F.col("y_hi") - F.col("y_lo")) / (F.col("y_mean") + 1e-10)
    return issues_of(
        issue(F.col("resolution") < t.hr_resolution, "info", "resolution", "survey-like resolution",
              F.col("resolution"), t.hr_resolution),
        issue(flat < 0.1, "warning", "peak", "flat spectrum"),
    )


def gate_snr() -> Column:
    return F.when(F.col("y_std") > 0, F.col("y_mean") / (F.col("y_std") + 1e-10)).otherwise(0.0)


def gate_flag(snr: Column, warnings: Column, critical: Column, t: Thresholds = Thresholds()) -> Column:
    return (
        F.when(critical > 0, "critical")
        .when((snr >= t.snr_excellent) & (warnings == 0), "excellent")
        .when((snr >= t.snr_good) & (warnings <= 1), "good")
        .when((snr >= t.snr_acceptable) & (warnings <= 2), "acceptable")
        .when(snr >= t.snr_poor, "poor")
        .otherwise("failed")
    )


def gate_spectra(stats: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Universal rules first; the single-spectrum rules only where nothing critical was found."""
    span = F.col("e_hi") - F.col("e_lo")
    df = (stats.withColumn("snr_gate", gate_snr())
          .withColumn("resolution", F.when(span > 0, F.col("n") / span).otherwise(0.0))
          .withColumn("_u", universal_issues(t)))
    df = df.withColumn("n_critical", count_level(F.col("_u"), "critical"))
    df = df.withColumn("issues", F.when(F.col("n_critical") > 0, F.col("_u"))
                       .otherwise(F.concat("_u", spectrum_issues(t)))).drop("_u")
    df = df.withColumn("n_warning", count_level(F.col("issues"), "warning"))
    df = df.withColumn("flag", gate_flag(F.col("snr_gate"), F.col("n_warning"), F.col("n_critical"), t))
    return df.withColumn("suitable", (F.col("resolution") >= t.hr_resolution)
                         & ~F.col("flag").isin("critical", "failed", "poor"))


def gate_map(pixels: DataFrame, maps: Sequence[str], value: str = "value", t: Thresholds = Thresholds()) -> DataFrame:
    """Map size and dead pixels (zero or not finite)."""
    v = F.col(value)
    dead = F.count_if((v == 0) | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    df = pixels.groupBy(*maps).agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"),
                                   F.count("*").alias("n_pixels"), dead.alias("n_dead"))
    df = df.withColumn("dead_fraction", F.col("n_dead") / F.col("n_pixels"))
    return df.withColumn("issues", issues_of(
        issue((F.col("nx") < t.min_map_side) | (F.col("ny") < t.min_map_side), "warning", "spatial", "small map",
              F.least("nx", "ny"), t.min_map_side),
        issue(F.col("dead_fraction") > t.max_dead_fraction, "warning", "spatial", "many dead pixels",
              F.col("dead_fraction"), t.max_dead_fraction)))


# Extensions that do not raise the format warning.
EXPECTED_EXTENSIONS = ("spe", "vgd", "npl", "csv", "xy", "vms")


def gate_files(files: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Rules on (path, length, header): header is the first 512 bytes of the file, as binary."""
    size = F.col("length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    # base64 of zero bytes only has 'A' and padding, so this needs no Python and no charset
    nulls = (F.length("header") > 0) & ~F.base64("header").rlike("[^A=\\s]")
    df = files.withColumn("extension", ext).withColumn("issues", issues_of(
        issue(size.isNull(), "critical", "file_access", "missing or empty file"),
        issue(size == 0, "critical", "file_size", "empty file"),
        issue((size > 0) & (size < t.min_file_bytes), "critical", "file_size", "file too small", size, t.min_file_bytes),
        issue(size > t.max_file_bytes, "warning", "file_size", "file very large", size, t.max_file_bytes),
        issue(~ext.isin(*EXPECTED_EXTENSIONS), "warning", "file_format", "unexpected extension"),
        issue(nulls, "critical", "file_corruption", "only null bytes"),
    ))
    return df.withColumn("accepted", count_level(F.col("issues"), "critical") == 0)


def modality(nx: Column, ny: Column, n_energy: Column, has_intensity: Column) -> Column:
    is_map = nx.isNotNull() & ny.isNotNull()
    return (F.when(is_map & (n_energy > 10), "hyperspectral_map").when(is_map, "map")
            .when(has_intensity, "spectrum").otherwise("unknown"))


# ---- per-spectrum metrics ---------------------------------------------------
#
# Each metric is a triple: columns added by windows over the spectrum, aggregates, and the values made from them.
# A single metric uses one triple; the full record chains all of them into one grouping with one shuffle.


def _baseline_columns(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = whole(keys)
    df = points.withColumns({"_hi": F.max("energy").over(g), "_lo": F.min("energy").over(g)})
    inside = F.col("energy") >= F.col("_hi") - (F.col("_hi") - F.col("_lo")) * 0.25
    df = df.withColumn("_in", inside).withColumn("_c", F.count_if("_in").over(g))
    df = df.withColumn("_use", (F.col("_c") < 5) | F.col("_in"))
    return df.withColumn("_u", F.when(F.col("_use"), F.col("energy") - F.avg(F.when(F.col("_use"), F.col("energy"))).over(g)))


def _baseline_aggregates() -> dict[str, Column]:
    u, y = F.col("_u"), F.when(F.col("_use"), F.col("intensity"))
    return {
        "_bn": F.count("*"), "_top": F.max("intensity"), "_mean": F.avg("intensity"), "_bm": F.avg(y), "_bs": F.stddev_pop(y),
        "_bmax": F.max(y), "_bmin": F.min(y), "_slope": F.regr_slope(y, u), "_us": F.stddev_pop(u), **quadratic_coefficients(u, y)}


def _baseline_values(detrend: str = "mean") -> dict[str, Column]:
    curve = F.abs(solve_quadratic({k: F.col(k) for k in [f"_q{i}" for i in range(5)] + ["_r0", "_r1", "_r2"]})[2])
    std = F.col("_bs")
    if detrend == "linear":
        s = F.col("_slope") * F.col("_us")
        std = F.sqrt(F.greatest(std * std - s * s, F.lit(0.0)))

    def value(c: Column) -> Column:
        return F.when(F.col("_bn") >= 10, c).otherwise(0.0)

    return {
        "n": F.col("_bn"), "snr_xps": value((F.col("_top") - F.col("_bm")) / (std + 1e-12)), "baseline_mean": value(F.col("_bm")),
        "baseline_std": value(std), "baseline_slope": value(F.coalesce(F.when(F.col("_q0") >= 3, F.col("_slope")), F.lit(0.0))),
        "baseline_curvature": value(F.coalesce(F.when(F.col("_q0") >= 5, curve), F.lit(0.0))),
        "noise_pk_pk": value(F.col("_bmax") - F.col("_bmin")), "relative_noise": value(std / (F.col("_mean") + 1e-10))}


def _resolution_columns(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.withColumn("_step", F.abs(F.col("energy") - F.lag("energy").over(along(keys))))


def _resolution_aggregates() -> dict[str, Column]:
    # the median is over the channels of one spectrum, a bounded number
    return {"_rn": F.count("*"), "_span": F.max("energy") - F.min("energy"), "_med": F.median("_step")}


def _resolution_values() -> dict[str, Column]:
    return {"points_per_ev": F.when(F.col("_span") > 0, F.col("_rn") / F.col("_span")).otherwise(0.0),
            "energy_step_ev": F.coalesce("_med", F.lit(0.0)), "energy_range": F.col("_span")}


def _peak_columns(points: DataFrame, keys: Sequence[str], steps: int | None) -> DataFrame:
    df = (shirley(points, keys) if steps is None else shirley_steps(points, keys, steps)).withColumn("_net", F.col("intensity") - F.col("background"))
    return df.withColumn("_h", F.max("_net").over(whole(keys)))


def _peak_aggregates() -> dict[str, Column]:
    above = F.when(F.col("_net") >= F.col("_h") / 2.0, F.col("energy"))
    return {"_ph": F.max("_h"), "_w": F.coalesce(F.max(above) - F.min(above), F.lit(0.0)),
            "_pb": F.max_by("background", F.struct("_net", (-F.col("i")).alias("m"))), "_ps": F.stddev_pop("_net")}


def _peak_values() -> dict[str, Column]:
    return {"peak_height": F.col("_ph"), "peak_fwhm": F.col("_w"), "peak_to_baseline": F.col("_ph") / (F.col("_pb") + 1e-10),
            "dynamic_range": F.col("_ph") / (F.col("_ps") + 1e-10)}


def _shift_aggregates() -> dict[str, Column]:
    return {"peak_ev": F.max_by("energy", F.struct("intensity", (-F.col("i")).alias("m")))}


def _with_shift(df: DataFrame, expected: DataFrame, t: Thresholds) -> DataFrame:
    d = df.join(expected.select("region", "typical_be"), "region", "left")
    shift = F.coalesce(F.col("peak_ev") - F.col("typical_be"), F.lit(0.0))
    return d.withColumn("shift_estimate_ev", shift).withColumn("suspected_shift", F.abs(shift) > t.max_shift_ev).drop("typical_be")


def _grouped(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    g = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return g.select(*keys, *[c.alias(n) for n, c in values.items()])


def baseline_metrics(points: DataFrame, keys: Sequence[str], detrend: str = "mean") -> DataFrame:
    """Level, spread, drift and noise of the top quarter of the energy range, and the peak SNR over it.

    `detrend="mean"` removes the mean before the spread is taken; `"linear"` removes the fitted line.
    """
    return _grouped(_baseline_columns(points, keys), keys, _baseline_aggregates(), _baseline_values(detrend))


def resolution_metrics(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points per eV and median energy step of one spectrum."""
    return _grouped(_resolution_columns(points, keys), keys, _resolution_aggregates(), _resolution_values())


def shift_check(points: DataFrame, expected: DataFrame, keys: Sequence[str], t: Thresholds = Thresholds()) -> DataFrame:
    """Distance of the highest point (the first on ties) from the region's expected energy."""
    top = points.groupBy(*keys, "region").agg(*[c.alias(n) for n, c in _shift_aggregates().items()])
    return _with_shift(top, expected, t).select(*keys, "region", "peak_ev", "shift_estimate_ev", "suspected_shift")


def peak_metrics(points: DataFrame, keys: Sequence[str], steps: int | None = None) -> DataFrame:
    """Height, width, peak-to-background and dynamic range after the Shirley background."""
    return _grouped(_peak_columns(points, keys, steps), keys, _peak_aggregates(), _peak_values())


def spectrum_quality(points: DataFrame, expected: DataFrame, keys: Sequence[str], t: Thresholds = Thresholds(),
                     steps: int | None = None) -> DataFrame:
    """The full quality record from one pass: all windows and the grouping share the spectrum's partitioning."""
    df = _peak_columns(_resolution_columns(_baseline_columns(points, keys), keys), keys, steps)
    aggregates = {**_baseline_aggregates(), **_resolution_aggregates(), **_peak_aggregates(), **_shift_aggregates()}
    values = {**_baseline_values(), **_resolution_values(), **_peak_values(), "peak_ev": F.col("peak_ev")}
    out = _grouped(df, [*keys, "region"], aggregates, values)
    return assess(_with_shift(out, expected, t), t)


def assess(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Flag, warnings and fit suitability from the joined metrics."""
    snr, res = F.col("snr_xps"), F.col("points_per_ev")
    hr = res >= t.hr_resolution
    warnings = F.array_compact(F.array(
        F.when(snr < t.peak_snr_poor, "very low snr").when(snr < t.peak_snr_acceptable, "low snr"),
        F.when(res < t.fit_resolution, "low resolution"),
        F.when(F.col("suspected_shift"), "suspected shift"),
        F.when(F.col("peak_to_baseline") < t.min_peak_to_baseline, "weak peak"),
        F.when(F.col("relative_noise") > t.max_relative_noise, "high noise")))
    df = metrics.withColumn("is_hr_scan", hr).withColumn("warnings", warnings)
    flag = (
        F.when((snr >= t.peak_snr_excellent) & hr & (F.size("warnings") == 0), "excellent")
        .when((snr >= t.peak_snr_good) & hr, "good")
        .when(snr >= t.peak_snr_acceptable, "acceptable")
        .when(snr >= t.peak_snr_poor, "poor").otherwise("suspicious"))
    return df.withColumn("quality_flag", flag).withColumn(
        "suitable_for_fitting", hr & (snr >= t.peak_snr_acceptable)
        & (F.col("peak_to_baseline") >= t.min_peak_to_baseline))


def quality_summary(q: DataFrame) -> DataFrame:
    """Batch totals; the median is exact and computed without gathering all spectra in one task."""
    # several passes over a few columns of what is the end of a long chain
    q = q.select("snr_xps", "points_per_ev", "peak_fwhm", "is_hr_scan", "suspected_shift", "suitable_for_fitting") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    median = exact_quantile(q, "snr_xps", 0.5)
    width = exact_quantile(q.filter(F.col("peak_fwhm") > 0), "peak_fwhm", 0.5)
    return q.agg(
        F.count("*").alias("n_spectra"), F.avg("snr_xps").alias("mean_snr"),
        F.avg("points_per_ev").alias("mean_resolution"), F.count_if("is_hr_scan").alias("n_hr"),
        F.count_if("suspected_shift").alias("n_shifted"), F.count_if("suitable_for_fitting").alias("n_suitable"),
    ).withColumn("median_snr", F.lit(median).cast("double")).withColumn("median_fwhm", F.lit(width).cast("double")).withColumn(
        "suitable_rate", F.when(F.col("n_spectra") > 0, F.col("n_suitable") / F.col("n_spectra")).otherwise(0.0))
