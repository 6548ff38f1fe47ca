"""Round trips: what the writers write is read back by the readers and compared with the tables it came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold import schemas
from lumenfold.functions.scalars import rnd
from lumenfold.plans.bindings import AREAS, KEYS, PTS, areas, labelled, recorded_points, table
from lumenfold.plans.registry import query
from lumenfold.session import scratch_path
from lumenfold.sources import settings as st
from lumenfold.sources import sinks as sk
from lumenfold.sources import tables as tb
from lumenfold.sources import text as tx


@query("io_spectra_csv", f"""WITH {PTS} SELECT instrument, CAST(sweep AS BIGINT) AS sweep, region, i, round(energy, 4) + 0e0 AS energy, round(raw, 2) + 0e0 AS intensity FROM pts""")
def io_spectra_csv(spark, sf):
    """Points as CSV by region, and back."""
    p = labelled(recorded_points(spark, sf)).withColumn("spectrum_id", F.concat_ws("_", *KEYS))
    path = scratch_path(spark, "spectra")
    sk.write_spectra_csv(p.select(*KEYS, "region", "spectrum_id", "i", "energy", rnd("raw", 2).alias("intensity")), path)
    back = spark.read.option("header", True).schema("instrument long, sweep long, spectrum_id string, i int, energy double, intensity double, region string").csv(path)
    return back.select(*KEYS, "region", "i", rnd("energy", 4).alias("energy"), rnd("intensity", 2).alias("intensity"))


@query("io_fit_results", f"""WITH {AREAS}, g AS (SELECT sample % 9 AS sample, layer, region, sum(area) AS area FROM areas GROUP BY 1, 2, 3), t AS (SELECT sample, layer, sum(area) AS t FROM g GROUP BY 1, 2)
SELECT CAST(sample AS VARCHAR) AS sample, CAST(layer AS INTEGER) AS layer, region, round(area, 2) + 0e0 AS total_area, round(area / t * 100, 1) + 0e0 AS area_percent, 'run7' AS run_id FROM g JOIN t USING (sample, layer)""")
def io_fit_results(spark, sf):
    """Fit rows as JSON by run, region and sample, and back."""
    a = areas(spark, sf).groupBy((F.col("sample") % 9).cast("string").alias("sample"), F.col("layer").cast("int").alias("layer"), "region").agg(F.sum("area").alias("area"))
    total = a.groupBy("sample", "layer").agg(F.sum("area").alias("t"))
    rows = a.join(total, ["sample", "layer"]).select("sample", "layer", "region", F.lit("all").alias("component"), rnd("area", 2).alias("total_area"),
                                                     (F.col("area") / F.col("t") * 100).alias("area_percent"))
    path = scratch_path(spark, "fits")
    sk.write_fit_results(rows, path, "run7")
    back = spark.read.schema("layer int, component string, total_area double, area_percent double, run_id string, region string, sample string").json(path)
    return back.select("sample", "layer", "region", rnd("total_area", 2).alias("total_area"), rnd("area_percent", 1).alias("area_percent"), "run_id")


@query("io_quality_report", """SELECT CAST(s_suppkey AS VARCHAR) AS sample_id, CASE WHEN s_suppkey % 5 = 0 THEN 0e0 ELSE round(s_acctbal, 4) + 0e0 END AS snr, s_suppkey % 2 = 0 AS suspected_shift,
CASE WHEN s_suppkey % 3 = 0 THEN 'low; shifted' WHEN s_suppkey % 3 = 1 THEN 'low' ELSE 'None' END AS warnings FROM supplier""")
def io_quality_report(spark, sf):
    """Quality records as CSV and back; numbers that are no numbers become 0."""
    k = F.col("s_suppkey")
    warnings = F.when(k % 3 == 0, F.array(F.lit("low"), F.lit("shifted"))).when(k % 3 == 1, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "supplier").select(k.cast("string").alias("sample_id"), F.lit("C1s").alias("region"),
                                               F.when(k % 5 == 0, "n/a").otherwise(rnd("s_acctbal", 4).cast("string")).alias("snr"),
                                               (k % 2 == 0).alias("suspected_shift"), warnings.alias("warnings"))
    path = scratch_path(spark, "quality")
    sk.write_quality_report(rows, path)
    return tb.read_quality_report(spark, path).select("sample_id", rnd("snr", 4).alias("snr"), "suspected_shift", "warnings")


@query("io_paths", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation")
def io_paths(spark, sf):
    """Text files in folders, found by folder and by glob at once and read once each."""
    path = scratch_path(spark, "texts")
    table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    files = tx.read_files(spark, [path, path], "*.txt")
    return files.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), F.trim(F.regexp_replace("text", "\n", "")).alias("n_name"))


@query("io_factor_table", """SELECT n_name AS region, n_nationkey + 5e-1 AS rsf FROM nation WHERE n_regionkey <> 3""")
def io_factor_table(spark, sf):
    """Sensitivity factors of a settings document; entries that are no positive numbers are left out."""
    entries = {r["n_name"]: {"rsf": 1.0, "corrected_rsf": "none" if r["n_regionkey"] == 3 else r["n_nationkey"] + 0.5} for r in table(spark, sf, "nation").collect()}
    return schemas.rsf_table(spark, st.corrected_factors({"rsf_values": entries})).select("region", F.col("corrected_rsf").alias("rsf"))


@query("io_region_table", """SELECT n_name AS region, n_nationkey + 0e0 AS e_min, n_nationkey + 10e0 AS e_max FROM nation""")
def io_region_table(spark, sf):
    """Energy ranges of a settings document, given in either order."""
    regions = {r["n_name"]: {"energy_range": [r["n_nationkey"] + 10, r["n_nationkey"]]} for r in table(spark, sf, "nation").collect()}
    return schemas.region_defs(spark, st.region_settings({"regions": regions})).select("region", "e_min", "e_max")


@query("io_column_by_prefix", "SELECT l_returnflag AS flag, round(sum(l_extendedprice), 2) + 0e0 AS total FROM lineitem GROUP BY 1")
def io_column_by_prefix(spark, sf):
    """Columns found by prefixes, tried in order and without case."""
    li = table(spark, sf, "lineitem")
    flag, price = tb.find_column(li, "flag", "L_RETURN"), tb.find_column(li, "L_EXT", "l_q")
    return li.groupBy(F.col(flag).alias("flag")).agg(rnd(F.sum(price), 2).alias("total"))
