"""Writers; values are rounded here and nowhere before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int | dict[str, int] = 4) -> DataFrame:
    """Half-even rounding of double columns."""
    for f in df.schema.fields:
        if f.dataType.simpleString() == "double":
            d = digits.get(f.name) if isinstance(digits, dict) else digits
            if d is not None:
                df = df.withColumn(f.name, F.bround(f.name, d))
    return df


def write_spectra_csv(points: DataFrame, path: str, digits: int = 4, by: Sequence[str] = ("region",)) -> None:
    """Points as CSV in one folder per region; a spectrum's rows stay together and in order."""
    out = rounded(points, digits)
    out.repartition(*[F.col(c) for c in (*by, "spectrum_id")]).sortWithinPartitions(*by, "spectrum_id", "i") \
        .write.partitionBy(*by).option("header", True).mode("overwrite").csv(path)


def write_fit_results(rows: DataFrame, path: str, run_id: str) -> None:
    """Fit rows as JSON in folders by run, region and sample."""
    rounded(rows, {"area_percent": 1, "center_ev": 3, "fwhm_ev": 3, "eta_mix": 3}).withColumn("run_id", F.lit(run_id)) \
        .write.partitionBy("run_id", "region", "sample").mode("append").json(path)


def write_quality_report(quality: DataFrame, path: str) -> None:
    """Quality records as CSV; warnings become one text field."""
    text = F.when(F.size("warnings") > 0, F.array_join("warnings", "; ")).otherwise("None")
    rounded(quality, 4).withColumn("warnings", text).write.option("header", True).mode("overwrite").csv(path)


def write_map_products(long: DataFrame, path: str, by: Sequence[str] = ("product",)) -> None:
    """Long table (product, y, x, value): component, score, entropy, mask and label maps."""
    long.write.partitionBy(*by).mode("overwrite").parquet(path)


def append_run_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def matrix_view(long: DataFrame, nx: int, value: str = "value") -> DataFrame:
    """One row per y, one column per x; only for maps of a known, small width."""
    if nx > 5000:
        raise ValueError("map too wide for a matrix view")
    wide = long.groupBy("y").pivot("x", list(range(nx))).agg(F.first(value))
    return wide.toDF("y", *[f"x{k}" for k in range(nx)])
