"""Streaming monitors run over the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.scalars import rnd
from lumenfold.plans.registry import query
from lumenfold.streaming import monitors as mo

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, sf):
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


CLOSED = "cl AS (SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n, avg({v}) AS m, stddev_pop({v}) AS s FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))"


@query("stream_quality", f"""WITH {CLOSED.format(v='value')}, q AS (SELECT *, CASE WHEN s > 0 THEN m / (s + 1e-10) ELSE 0 END AS snr FROM cl)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, round(m, 6) + 0e0 AS mean, round(snr, 5) + 0e0 AS snr, CASE WHEN n < 10 OR snr < 1 THEN 'critical' WHEN snr >= 10 THEN 'excellent' WHEN snr >= 5 THEN 'good' WHEN snr >= 3 THEN 'acceptable' WHEN snr >= 1 THEN 'poor' ELSE 'failed' END AS flag FROM q""")
def stream_quality(spark, sf):
    out = mo.run_available(mo.quality_monitor(events(spark, sf), "ts", "event_type", "value"), "quality")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", rnd("mean", 6).alias("mean"),
                      rnd("snr", 5).alias("snr"), "flag")


@query("stream_drift", f"""WITH {CLOSED.format(v='2848e-1 + value / 1e2')}, d AS (SELECT *, m - 2848e-1 AS shift FROM cl)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS instrument, n, round(shift, 6) + 0e0 AS shift, round(last_value(CASE WHEN abs(shift) <= 5e-1 THEN shift END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) + 0e0 AS reference, abs(shift) > 5e-1 AS drifting FROM d""")
def stream_drift(spark, sf):
    s = events(spark, sf).withColumn("peak", 284.8 + F.col("value") / 100)
    windows = mo.follow_table(mo.peak_windows(s, "ts", "event_type", "peak", 284.8), "windows")
    out = mo.run_available(mo.drift_monitor(windows), "drift")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "instrument", "n", rnd("shift", 6).alias("shift"),
                      rnd("reference", 6).alias("reference"), "drifting")
