"""Order-dependent numbering that holds when one key owns a large part of the rows, plus exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import scratch_path

HOT_ROWS = 1_000_000


def wallclock_micros(ts: str) -> Column:
    """Monotone microsecond number of a TIMESTAMP_NTZ or TIMESTAMP column, free of time-zone jumps."""
    c = F.col(ts)
    day = F.date_diff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    micro = (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint")
    return ((day * 24 + F.hour(c)) * 60 + F.minute(c)) * F.lit(60_000_000) + micro


def with_ordinal(df: DataFrame, key: str, position: Column, ties: Sequence[str], out: str = "k",
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """0-based rank of every row within `key`, ordered by `position` (an integer) and then `ties`; nulls are a key.

    Keys with few rows are ranked in one window. The rows of keys with more than `hot_rows` rows are dealt into ranges
    of (key, position, ties) of about that many rows and written to the shared folder; each range is ranked by itself
    and moved by the number of the key's rows in the ranges before it, so no task ever sorts a whole hot key, whatever
    it repeats.
    """
    df = df.withColumn("_pos", position)
    sizes = df.groupBy(key).count()
    total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    w = Window.partitionBy(key).orderBy("_pos", *ties)
    if (largest or 0) <= hot_rows:
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint")).drop("_pos")

    flags = sizes.where(F.col("count") > hot_rows).select(F.col(key).alias("_hot_key"))
    same = F.col(key).eqNullSafe(F.col("_hot_key"))
    cold = df.join(flags, same, "left_anti").withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    ranges = -(-total // hot_rows)
    hot = df.join(flags, same, "left_semi").repartitionByRange(int(ranges), key, "_pos", *ties)
    path = scratch_path(df.sparkSession, "ranks")
    hot.withColumn("_rank_s", F.spark_partition_id()).write.parquet(path)
    hot = df.sparkSession.read.parquet(path)
    ranked = hot.withColumn("_rank_r", F.row_number().over(Window.partitionBy(key, "_rank_s").orderBy("_pos", *ties)) - 1)
    counts = hot.groupBy(F.col(key).alias("_rank_key"), F.col("_rank_s").alias("_rank_part")).agg(F.count("*").alias("_rank_n"))
    before = Window.partitionBy("_rank_key").orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_rank_key", "_rank_part", F.coalesce(F.sum("_rank_n").over(before), F.lit(0)).alias("_rank_before"))
    ranked = ranked.join(counts, F.col(key).eqNullSafe(F.col("_rank_key")) & (F.col("_rank_s") == F.col("_rank_part")))
    ranked = ranked.withColumn(out, (F.col("_rank_r") + F.col("_rank_before")).cast("bigint")).select(*cold.columns)
    return cold.union(ranked).drop("_pos")


def exact_quantile(df: DataFrame, value: str, q: float, bins: int = 4096, small: int = 1_000_000) -> float | None:
    """Exact interpolated quantile of one column (numpy's default rule) with bounded memory per task.

    Each pass is one map-side combined histogram over the range that still holds the wanted ranks; when few
    enough distinct rows are left there, the built-in percentile finishes the job on those rows only.
    """
    v = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, lo, hi = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if n == 0:
        return None
    if n <= small:
        return v.agg(F.percentile("v", F.lit(q))).first()[0]
    rank = (n - 1) * q

    def order_statistic(k: int) -> float:
        a, b, skip, left = lo, hi, 0, n
        while left > small and b > a:
            step = (b - a) / bins
            if step == 0.0 or a + step == a:
                break
            slot = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(a)) / F.lit(step))).cast("int")
            part = v.filter((F.col("v") >= a) & (F.col("v") <= b))
            hist = (part.groupBy(slot.alias("s"))
                    .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                    .orderBy("s").collect())
            seen = skip
            for h in hist:
                if k < seen + h["n"]:
                    skip, left, a, b = seen, h["n"], h["lo"], h["hi"]
                    break
                seen += h["n"]
        if a == b:
            return a
        inside = v.filter((F.col("v") >= a) & (F.col("v") <= b))
        if left == 1:
            return a
        p = (k - skip) / (left - 1)
        return inside.agg(F.percentile("v", F.lit(p))).first()[0]

    below = order_statistic(int(rank))
    if rank == int(rank):
        return below
    above = order_statistic(int(rank) + 1)
    return below + (above - below) * (rank - int(rank))


def grouped_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "quantile",
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact interpolated quantile of a column for each key (numpy's default rule): one row per key that has a value.

    The values are ranked within the key, in ranges when a key has many rows, and the two that bound the quantile are
    picked; no task holds the values of a hot key.
    """
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull() & ~F.isnan(v)).select(F.struct(*[F.col(k) for k in keys] or [F.lit(0)]).alias("_key"), v.alias("_v"))
    ranked = with_ordinal(d, "_key", F.lit(0), ["_v"], "_rank", hot_rows)
    rank = (F.col("_n") - 1) * q
    sizes = d.groupBy("_key").agg(F.count("*").alias("_n")).select(F.col("_key").alias("_own"), rank.alias("_at"))
    low, high = F.floor("_at"), F.ceil("_at")
    bound = ranked.join(sizes, F.col("_key").eqNullSafe(F.col("_own"))).where((F.col("_rank") == low) | (F.col("_rank") == high))
    a, b = F.max(F.when(F.col("_rank") == low, F.col("_v"))), F.max(F.when(F.col("_rank") == high, F.col("_v")))
    found = bound.groupBy("_key", "_at").agg(a.alias("_a"), b.alias("_b"))
    return found.select(*[F.col(f"_key.{k}").alias(k) for k in keys], (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - low)).alias(out))


def unique_names(df: DataFrame, name: str, order: Sequence[str], out: str = "unique_name", scope: Sequence[str] = (),
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Second and later uses of a name get `_2`, `_3`, ... within `scope` (one export, so one set of columns).

    A name that is used very often is numbered in ranges of `order`, not in one task.
    """
    keyed = df.withColumn("_name", F.struct(*[F.col(c) for c in (*scope, name)]))
    numbered = with_ordinal(keyed, "_name", F.lit(0), order, "_use", hot_rows)
    again = F.concat(F.col(name), F.lit("_"), (F.col("_use") + 1).cast("string"))
    return numbered.withColumn(out, F.when(F.col("_use") == 0, F.col(name)).otherwise(again)).drop("_name", "_use")
