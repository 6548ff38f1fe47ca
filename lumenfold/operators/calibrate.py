"""Energy calibration: one shift per file from a reference peak, a metal line or a Fermi edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import fixed_values as fv
from lumenfold.operators.fit import fit_edge
from lumenfold.operators.peaks import dominant_peak, find_peaks
from lumenfold.operators.points import materialise
from lumenfold.operators.smooth import savgol
from lumenfold.session import join_stats


def reference_peaks(packed: DataFrame, lo: float, hi: float, min_points: int = 20, window: int = 7,
                    prominence: float = 0.10) -> DataFrame:
    """Per spectrum: dominant smoothed peak inside [lo, hi] and the raw maximum there; NULL peak when none."""
    inside = F.filter(F.arrays_zip("energy", "intensity"), lambda p: p["energy"].between(min(lo, hi), max(lo, hi)))
    d = materialise(packed, _a=inside)
    d = materialise(d, _z=F.when(F.size("_a") >= min_points, F.col("_a")))
    d = materialise(d, _x=F.col("_z")["energy"], _y=F.col("_z")["intensity"])
    d = find_peaks(materialise(d, _s=savgol(F.col("_y"), window, 2, window)), "_s", "_p")
    d = materialise(d, _t=F.array_max("_s"))
    peak = dominant_peak(F.col("_p"), F.greatest(F.lit(1e-6), F.lit(prominence) * F.col("_t")))
    d = materialise(d, _k=peak["i"])
    return d.withColumn("peak_ev", F.when(F.col("_t") > 0, F.get("_x", F.col("_k")))).withColumn("local_max", F.array_max("_y")) \
        .drop("_a", "_z", "_x", "_y", "_s", "_p", "_t", "_k")


def _status(spectra: DataFrame, file_keys: Sequence[str], target: float, limit: float) -> DataFrame:
    """Best candidate per file: one mergeable aggregate, so a file with very many spectra is combined before the shuffle."""
    found = F.when(F.col("peak_ev").isNotNull(), F.struct("local_max", "_tie"))
    d = spectra.groupBy(*file_keys).agg(F.count("*").alias("n_spectra"), F.max_by("peak_ev", found).alias("peak_ev"))
    d = d.withColumn("attempted_shift_ev", F.lit(target) - F.col("peak_ev"))
    status = (F.when(F.col("peak_ev").isNull(), "peak_not_found")
              .when(F.abs("attempted_shift_ev") > limit, "exceeds_limit").otherwise("applied"))
    d = d.withColumn("status", status)
    return d.withColumn("applied_shift_ev", F.when(F.col("status") == "applied", F.col("attempted_shift_ev")).otherwise(0.0))


def calibration_table(packed: DataFrame, file_keys: Sequence[str], spectrum_keys: Sequence[str], definitions: dict | None = None,
                      region: str = "C1s", target: float = fv.CARBON_TARGET_EV, limit: float = fv.MAX_SHIFT_EV,
                      enabled: bool = True) -> DataFrame:
    """One row per file: peak, attempted and applied shift, status."""
    definitions = fv.REGION_DEFINITIONS if definitions is None else definitions
    if not enabled or region not in definitions:
        files = packed.groupBy(*file_keys).agg(F.count("*").alias("n_spectra"))
        none = F.lit(None).cast("double")
        return files.withColumn("peak_ev", none).withColumn("attempted_shift_ev", none).withColumn(
            "status", F.lit("missing_reference" if enabled else "disabled")).withColumn("applied_shift_ev", F.lit(0.0))
    lo, hi = definitions[region][:2]
    found = reference_peaks(packed, lo, hi)
    # the first spectrum wins among equal maxima
    tie = F.struct(*[-F.col(k) for k in spectrum_keys])
    return _status(found.withColumn("_tie", tie), file_keys, target, limit)


def metallic_table(packed: DataFrame, file_keys: Sequence[str], spectrum_keys: Sequence[str], line: str = "Au4f",
                   known_ev: float | None = None, limit: float = fv.MAX_SHIFT_EV, reach: float = 10.0) -> DataFrame:
    """Same, against a metal line (or a user-given energy for any region)."""
    if known_ev is None and line not in fv.METALLIC_REFERENCES:
        return calibration_table(packed, file_keys, spectrum_keys, {}, line)
    target = fv.METALLIC_REFERENCES[line] if known_ev is None else known_ev
    span = fv.REGION_DEFINITIONS.get(line)
    lo, hi = span[:2] if span else (target - reach, target + reach)
    return calibration_table(packed, file_keys, spectrum_keys, {line: (lo, hi)}, line, target, limit)


def edge_table(packed: DataFrame, file_keys: Sequence[str], spectrum_keys: Sequence[str], window: float = 1.0,
               limit: float = fv.MAX_SHIFT_EV) -> DataFrame:
    """Fermi edge moved to 0 eV; the spectrum with the highest maximum in the window decides."""
    d = packed.withColumn("_e", fit_edge(F.col("energy"), F.col("intensity"), window))
    edge = F.nanvl(F.col("_e.edge_ev"), F.lit(None).cast("double"))
    d = d.withColumn("peak_ev", edge).withColumn("local_max", F.col("_e.top")).withColumn(
        "_tie", F.struct(*[-F.col(k) for k in spectrum_keys]))
    return _status(d, file_keys, 0.0, limit)


def apply_shift(points: DataFrame, table: DataFrame, file_keys: Sequence[str]) -> DataFrame:
    """Move every spectrum of a file; refused files keep their energies and carry the status."""
    return join_stats(points, table.select(*file_keys, "applied_shift_ev", "status"), list(file_keys)).withColumn(
        "energy", F.col("energy") + F.col("applied_shift_ev"))


def calibrate(packed: DataFrame, mode: str, file_keys: Sequence[str], spectrum_keys: Sequence[str], **options) -> DataFrame:
    """Calibration table by mode name."""
    if mode == "metallic_reference":
        return metallic_table(packed, file_keys, spectrum_keys, **options)
    if mode == "known_peak":
        return metallic_table(packed, file_keys, spectrum_keys, **options)
    if mode == "fermi_edge":
        return edge_table(packed, file_keys, spectrum_keys, **options)
    return calibration_table(packed, file_keys, spectrum_keys, enabled=mode != "disable", **options)
