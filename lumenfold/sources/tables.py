"""Readers and cleaners for tabular inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import schemas
from lumenfold.functions.scalars import column_key, to_number


def clean_columns(df: DataFrame) -> DataFrame:
    """Column names without dashes, brackets and blanks."""
    return df.toDF(*[column_key(c) for c in df.columns])


def find_column(df: DataFrame, *prefixes: str) -> str:
    """First column whose name starts with one of the prefixes, without case; prefixes are tried in order."""
    for p in prefixes:
        for c in df.columns:
            if c.lower().startswith(p.lower()):
                return c
    raise ValueError(f"no column starts with {', '.join(prefixes)}")


# Input column (cleaned, lower case) -> library column of a performance table.
PERFORMANCE_COLUMNS = {"sample": "sample", "cycle": "cycle", "capacityretention": "capacity_retention", "ce": "ce",
                       "relectrolyte": "r_electrolyte", "rinterface": "r_interface", "rsei": "r_sei", "rct": "r_ct"}


def clean_performance(raw: DataFrame) -> DataFrame:
    """Rename, coerce numbers (bad text -> NULL) and derive the capacity fade."""
    df = clean_columns(raw)
    df = df.toDF(*[PERFORMANCE_COLUMNS.get(c.lower(), c) for c in df.columns])
    for c in df.columns:
        if c in PERFORMANCE_COLUMNS.values() and c != "sample":
            df = df.withColumn(c, to_number(F.col(c)))
    if "capacity_retention" in df.columns:
        df = df.withColumn("capacity_fade", 100.0 - F.col("capacity_retention"))
    return df


def read_performance(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return clean_performance(spark.read.option("header", True).csv(paths))


def read_fit_results(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Fit records as JSON arrays per file, in any folder depth; a missing layer is 1."""
    df = spark.read.schema(schemas.FIT_RESULT).option("multiLine", True).option("recursiveFileLookup", True).json(paths)
    df = df.withColumn("layer", F.coalesce("layer", F.lit(1)))
    return schemas.require_columns(df, "sample", "region", "component", "total_area", "area_percent")


def read_quality_report(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Quality records from text: bad numbers become 0."""
    raw = spark.read.option("header", True).csv(paths)
    numeric = [c for c in raw.columns if c not in ("sample_id", "region", "quality_flag", "warnings",
                                                   "suspected_shift", "is_hr_scan", "suitable_for_fitting")]
    df = raw
    for c in numeric:
        df = df.withColumn(c, F.coalesce(to_number(F.col(c)), F.lit(0.0)))
    for c in ("suspected_shift", "is_hr_scan", "suitable_for_fitting"):
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)))
    return df
