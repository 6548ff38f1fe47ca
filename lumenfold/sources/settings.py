"""Small dimension tables from configuration documents (read once on the driver)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lumenfold import schemas


def read_yaml(path: str | Path) -> dict:
    import yaml
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def corrected_factors(raw: dict) -> dict[str, tuple[float, float]]:
    """region -> (factor, corrected factor); bad values are skipped and an empty table is an error."""
    out = {}
    for region, entry in (raw.get("rsf_values") or {}).items():
        try:
            value = float(entry["corrected_rsf"])
            if value > 0:
                out[region] = (float(entry.get("rsf", value)), value)
        except (TypeError, ValueError, KeyError):
            continue
    if not out:
        raise ValueError("no usable sensitivity factors")
    return out


def region_settings(raw: dict) -> dict[str, tuple]:
    """region -> (e_min, e_max, typical_be, a_min, a_max, mask threshold, focus clusters)."""
    out = {}
    for region, r in (raw.get("regions") or {}).items():
        lo, hi = sorted(float(v) for v in r["energy_range"])
        a = r.get("analysis_range") or (None, None)
        t = r.get("intensity_mask_threshold")
        out[region] = (lo, hi, r.get("typical_be"), a[0], a[1], None if t is None else float(t), r.get("focus_clusters"))
    return out


def rsf_from(spark: SparkSession, path: str) -> DataFrame:
    return schemas.rsf_table(spark, corrected_factors(read_yaml(path)))


def regions_from(spark: SparkSession, path: str) -> DataFrame:
    return schemas.region_defs(spark, region_settings(read_yaml(path)))
