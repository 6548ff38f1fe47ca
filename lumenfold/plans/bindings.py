"""How the driver's tables are read as spectra, areas, maps and performance records.

A recording (`events.user_id`) is cut into sweeps of at most SWEEP channels, so a spectrum is bounded by
construction however many rows one recording holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.ordering import wallclock_micros, with_ordinal

SWEEP = 64
KEYS = ["instrument", "sweep"]
REGIONS = ["C1s", "O1s", "F1s", "N1s", "Si2p"]
TYPICAL = [284.8, 532.0, 688.0, 399.8, 99.3]
RSF_BINDING = {"AF": 0.314, "AO": 0.733, "NF": 1.0, "NO": 0.499, "RF": 0.368, "RO": 0.525}
MAP_WIDTH = 25


#: Rows that one task gets, about, where a shuffle is sized by its input.
TASK_ROWS = 1 << 19


#: Partitions up to which Spark writes a shuffle without holding the rows, and how many times TASK_ROWS a task may get to stay there.
UNHELD, STRETCH = 200, 4


def parts_for(df: DataFrame) -> int:
    """Partitions of at most about TASK_ROWS rows, so that the memory of a task does not grow with the table.

    With more than UNHELD of them, the tasks that read a table hold all rows of a file split as they shuffle them, which is more
    than a task of STRETCH times the rows needs; so their number stays there as long as that is enough.
    """
    rows, least = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return max(least, min(-(-rows // TASK_ROWS), max(UNHELD, -(-rows // (STRETCH * TASK_ROWS)))))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def recorded_points(spark: SparkSession, sf: str) -> DataFrame:
    """instrument, sweep, i, energy, intensity (peaked), raw."""
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    ranked = with_ordinal(ev, "user_id", wallclock_micros("ts"), ["event_id"])
    i = F.pmod("k", F.lit(SWEEP))
    sample = F.floor(F.col("user_id") / 5)
    typical = F.element_at(F.array(*[F.lit(t) for t in TYPICAL]), (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    shift = (F.pmod(sample * 7, F.lit(27)) - 13) * 0.5
    return ranked.select(
        F.col("user_id").alias("instrument"), F.floor(F.col("k") / SWEEP).alias("sweep"), i.cast("int").alias("i"),
        F.round(typical + shift + 0.1 * (i - 24), 4).alias("energy"),
        (0.1 * F.col("value") + 100.0 * F.exp(-0.5 * F.pow((i - 24) / 6.0, 2.0))).alias("intensity"),
        F.col("value").alias("raw"))


def sample_of() -> "F.Column":
    return F.concat(F.lit("S"), F.floor(F.col("instrument") / 5).cast("string"))


def region_of() -> "F.Column":
    return F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.pmod("instrument", F.lit(5)) + 1).cast("int"))


def labelled(df: DataFrame) -> DataFrame:
    """Add sample, region and layer, which follow from the instrument and sweep numbers."""
    return (df.withColumn("sample", sample_of()).withColumn("region", region_of())
            .withColumn("layer", (F.col("sweep") + 1).cast("int")))


_TYPICAL_SQL = "[" + ",".join(repr(t) for t in TYPICAL) + "]::DOUBLE[]"
_REGION_SQL = "[" + ",".join(f"'{r}'" for r in REGIONS) + "]"

PTS = f"""
ranked AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
pts AS (SELECT user_id AS instrument, k // {SWEEP} AS sweep, CAST(k % {SWEEP} AS INTEGER) AS i,
  'S' || (user_id // 5) AS sample, ({_REGION_SQL})[CAST(user_id % 5 AS INTEGER) + 1] AS region,
  CAST(k // {SWEEP} + 1 AS INTEGER) AS layer,
  round(({_TYPICAL_SQL})[CAST(user_id % 5 AS INTEGER) + 1] + (((user_id // 5) * 7) % 27 - 13) * 5e-1
        + 1e-1 * ((k % {SWEEP}) - 24), 4) AS energy,
  1e-1 * value + 1e2 * exp(-5e-1 * pow(((k % {SWEEP}) - 24) / 6e0, 2e0)) AS intensity, value AS raw FROM ranked)"""


# ---- peak areas from lineitem ----------------------------------------------

def areas(spark: SparkSession, sf: str) -> DataFrame:
    """sample, layer, region, area."""
    li = table(spark, sf, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("layer"),
                       F.concat("l_returnflag", "l_linestatus").alias("region"))
            .agg(F.sum("l_extendedprice").alias("area")))


def rsf(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RSF_BINDING.items()), "region string, rsf double")


def component_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """sample, layer, region, component and area of each line item, and the partitions of shuffles over them."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
                                             "l_partkey", "l_extendedprice")
    # line items hardly repeat a part, so sums ahead of the join would only hold all rows of a task in memory
    li = li.select(F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("layer"),
                   F.concat("l_returnflag", "l_linestatus").alias("region"), "l_partkey", F.col("l_extendedprice").alias("area"))
    n = parts_for(li)
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("component"))
    return li.repartition(n, "l_partkey").join(part.hint("shuffle_hash"), "l_partkey"), n


def components(spark: SparkSession, sf: str) -> DataFrame:
    """sample, layer, region, component, area."""
    named, n = component_rows(spark, sf)
    # the sums, and windows over the components of a region, share this shuffle
    return named.repartition(n, "sample", "layer", "region").groupBy("sample", "layer", "region", "component").agg(F.sum("area").alias("area"))


AREAS = """
areas AS (SELECT l_suppkey AS sample, l_linenumber AS layer, l_returnflag || l_linestatus AS region,
  sum(l_extendedprice) AS area FROM lineitem GROUP BY 1, 2, 3)"""
RSF = "rsf(region, rsf) AS (VALUES " + ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in RSF_BINDING.items()) + ")"
COMPONENTS = """
comps AS (SELECT l_suppkey AS sample, l_linenumber AS layer, l_returnflag || l_linestatus AS region,
  p_type AS component, sum(l_extendedprice) AS area FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4)"""


# ---- maps from embeddings ---------------------------------------------------

def map_spectra(spark: SparkSession, sf: str, clip: bool = True) -> DataFrame:
    """vec_id, y, x, label, intensity array<double> of 64 channels."""
    e = table(spark, sf, "embeddings")
    a = F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0)) if clip else v.cast("double"))
    return e.select("vec_id", F.floor(F.col("vec_id") / MAP_WIDTH).cast("int").alias("y"),
                    F.pmod("vec_id", F.lit(MAP_WIDTH)).cast("int").alias("x"), "label", a.alias("intensity"))


def map_points(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, y, x, label, c, v, energy."""
    m = map_spectra(spark, sf)
    return m.select("vec_id", "y", "x", "label", F.posexplode("intensity").alias("c", "v")) \
        .withColumn("energy", 280.0 + 0.1875 * F.col("c"))


def map_pixels(spark: SparkSession, sf: str, channel: int = 0) -> DataFrame:
    return map_spectra(spark, sf).select("y", "x", F.get("intensity", F.lit(channel)).alias("value"))


MAP = f"""
px AS (SELECT vec_id, CAST(vec_id // {MAP_WIDTH} AS INTEGER) AS y, CAST(vec_id % {MAP_WIDTH} AS INTEGER) AS x, label,
  list_transform(embedding, lambda v: greatest(CAST(v AS DOUBLE), 0e0)) AS a FROM embeddings),
mp AS (SELECT vec_id, y, x, label, unnest(range(len(a))) AS c, unnest(a) AS v FROM px)"""


# ---- performance by cycle from orders ---------------------------------------

def performance(spark: SparkSession, sf: str) -> DataFrame:
    """sample, ordinal, cycle (month number), retention (0..100), capacity fade."""
    o = table(spark, sf, "orders")
    cycle = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    retention = F.col("o_totalprice") / 5000.0
    return o.select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("ordinal"), cycle.alias("cycle"),
                    retention.alias("retention"), (100.0 - retention).alias("fade"), F.col("o_orderstatus").alias("status"))


PERF = """
perf AS (SELECT o_custkey AS sample, o_orderkey AS ordinal,
  CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS cycle,
  o_totalprice / 5e3 AS retention, 1e2 - o_totalprice / 5e3 AS fade, o_orderstatus AS status FROM orders)"""
