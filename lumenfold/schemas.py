"""Table schemas and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lumenfold import fixed_values as fv

SPECTRA = ("spectrum_id string, sample string, region string, layer int, source_file string, source_format string, "
           "pass_energy double, depth_profile boolean, energy array<double>, intensity array<double>, "
           "metadata map<string,string>")
SPECTRUM_POINTS = "spectrum_id string, i int, energy double, intensity double"
MAPS = "map_id string, region string, x0 double, dx double, nx int, y0 double, dy double, ny int, energy array<double>"
MAP_SPECTRA = "map_id string, y int, x int, intensity array<double>"
MAP_PIXELS = "map_id string, y int, x int, value double"
FIT_RESULT = ("file string, sample string, layer int, region string, component string, center_ev double, "
              "fwhm_ev double, eta_mix double, total_area double, area_counts double, area_percent double, "
              "r_squared double, template string")
REGION_DEFS = ("region string, e_min double, e_max double, typical_be double, a_min double, a_max double, "
               "intensity_mask_threshold double, focus_clusters array<int>")
RSF = "region string, rsf double, corrected_rsf double"
PERFORMANCE = "sample string, cycle int, capacity_retention double, ce double"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def region_defs(spark: SparkSession, definitions: dict | None = None) -> DataFrame:
    rows = [(k, *v) for k, v in (definitions or fv.REGION_DEFINITIONS).items()]
    return spark.createDataFrame(rows, REGION_DEFS)


def rsf_table(spark: SparkSession, factors: dict | None = None) -> DataFrame:
    rows = [(k, *v) for k, v in (factors or fv.SENSITIVITY_FACTORS).items()]
    return spark.createDataFrame(rows, RSF)
