"""Streaming monitors: windowed quality metrics and drift against the last stable reference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.operators.quality import Thresholds, gate_flag
from lumenfold.session import scratch_path


def quality_monitor(stream: DataFrame, time: str, group: str, value: str, width: str = "1 hour", delay: str = "10 minutes",
                    t: Thresholds = Thresholds()) -> DataFrame:
    """Gate metrics per tumbling window and group. The aggregates are combined map-side, so a busy group does not
    send its rows to one task, and state holds one row per open window and group. In append mode a window comes out once
    the watermark has passed its end, so windows that are still open when a stream stops have no row."""
    g = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), group).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lowest"),
        F.max(value).alias("highest"))
    snr = F.when(F.col("std") > 0, F.col("mean") / (F.col("std") + 1e-10)).otherwise(0.0)
    critical = (F.col("n") < t.min_points).cast("int") + (snr < t.snr_critical).cast("int")
    warnings = ((snr >= t.snr_critical) & (snr < t.snr_acceptable)).cast("int")
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), group, "n", "mean", "std",
                    snr.alias("snr"), gate_flag(snr, warnings, critical, t).alias("flag"))


DRIFT = "instrument string, window_start timestamp, n long, shift double, reference double, drifting boolean"
DRIFT_STATE = "reference double, since timestamp"


def peak_windows(stream: DataFrame, time: str, instrument: str, peak: str, target: float, width: str = "1 hour",
                 delay: str = "10 minutes") -> DataFrame:
    """Distance of the mean peak from the target per instrument and closed window, aggregated map-side.

    Windows that are still open when the stream stops have no row, as append mode means.
    """
    windows = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), F.col(instrument).alias("instrument")).agg(
        F.count("*").alias("n"), F.avg(peak).alias("mean"))
    return windows.select(F.col("w.start").alias("window_start"), "instrument", "n", (F.col("mean") - F.lit(target)).alias("shift"))


def drift_monitor(windows: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Follow the window stream per instrument, keeping the last stable distance as reference.

    The input has one row per instrument and window (see peak_windows, written to a table in between), so even a
    dominant instrument sends few rows here, and state is one number per instrument.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.getOption if state.exists else None
        reference = known[0] if known else None
        since = known[1] if known else None
        new = pd.concat(list(batches)).sort_values("window_start")  # closed windows of one instrument in one trigger
        out = []
        for r in new.itertuples(index=False):
            drifting = abs(r.shift) > tolerance
            out.append((key[0], r.window_start, int(r.n), float(r.shift), reference, bool(drifting)))
            if not drifting:
                reference, since = float(r.shift), r.window_start.to_pydatetime()
        if reference is not None:
            state.update((reference, since))
        frame = pd.DataFrame(out, columns=["instrument", "window_start", "n", "shift", "reference", "drifting"])
        frame["reference"] = frame["reference"].astype(float)
        yield frame

    return windows.groupBy("instrument").applyInPandasWithState(follow, DRIFT, DRIFT_STATE, "append", GroupStateTimeout.NoTimeout)


def write_available(stream: DataFrame, name: str) -> str:
    """Process everything that is there now into a table under the shared folder; returns the table's folder."""
    out = scratch_path(stream.sparkSession, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/data"


def run_available(stream: DataFrame, name: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(write_available(stream, name))


def follow_table(stream: DataFrame, name: str) -> DataFrame:
    """Write a stream to a table and open that table as the next stream."""
    spark: SparkSession = stream.sparkSession
    return spark.readStream.schema(stream.schema).parquet(write_available(stream, name))
