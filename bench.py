"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINES = [
    "quant_atomic_percent", "quant_component_atomic_percent", "quant_component_features", "correlate_matrix",
    "performance_latest_cycle", "drift_report", "background_shirley", "background_shirley_converged", "background_tougaard",
    "smooth_savgol", "peaks_all", "quality_assessment", "grid_combine", "calibration_applied", "fit_templates",
    "run_spectra_to_composition", "map_variability", "map_pca_scores", "map_kmeans", "map_nnls_projection", "map_pixel_fit",
    "map_mcr", "image_segmentation", "map_pipeline", "source_parser_choice", "stream_quality",
]


def main() -> None:
    from lumenfold.plans.catalog import QUERIES
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    QUERIES["quant_atomic_percent"](spark, sf).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    out = {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
    if "map_pipeline" in times:
        pixels = spark.read.parquet(f"{sf}/embeddings.parquet").count()
        out["map_pixels_per_sec"] = round(pixels / times["map_pipeline"], 1)
        # the published figure is for 20 000 pixels of 64 channels: stack the table's pixels to that size
        from pyspark.sql import functions as F
        from lumenfold.plans.bindings import map_spectra
        from lumenfold.plans.pipelines import run_map
        from lumenfold.plans.queries_maps import AXIS
        from lumenfold.session import spread
        copies = -(-20_000 // pixels)
        big = map_spectra(spark, sf).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        big = spread(big.withColumn("vec_id", F.col("vec_id") + F.col("_c") * pixels).drop("_c"))
        start = time.perf_counter()
        run_map(big, AXIS, "C1s").pixels.write.format("noop").mode("overwrite").save()
        out["map_20k_pixels_sec"] = round(time.perf_counter() - start, 3)
        out["map_20k_pixels_per_sec"] = round(copies * pixels / out["map_20k_pixels_sec"], 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
