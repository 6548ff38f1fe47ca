"""Atomic percentages, component tables and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import join_stats, settled


def first_area(rows: DataFrame, keys: Sequence[str], area: str = "total_area", order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """First non-null area per key; all components of a region repeat the same total."""
    return rows.groupBy(*keys).agg(F.min_by(area, F.when(F.col(area).isNotNull(), F.struct(*order))).alias("area"))


def atomic_percent(areas: DataFrame, rsf: DataFrame, scope: Sequence[str] = ("sample", "layer"),
                   factor: str = "rsf") -> DataFrame:
    """(area / factor) as a share of its sum per scope, in percent; regions without a factor are left out.

    `areas` has one row per scope and region, so the window sees at most one row per region of the factor table.
    """
    norm = areas.join(rsf.select("region", F.col(factor).alias("_f")), "region") \
        .withColumn("_norm", F.col("area") / F.col("_f"))
    total = F.sum("_norm").over(Window.partitionBy(*scope))
    pct = F.when(total > 0, F.col("_norm") / total * 100.0).otherwise(0.0)
    return norm.withColumn("atomic_percent", pct).drop("_f", "_norm")


def missing_factors(areas: DataFrame, rsf: DataFrame) -> DataFrame:
    """Regions that have areas but no factor."""
    return areas.join(rsf.select("region"), "region", "left_anti").groupBy("region").agg(
        F.count("*").alias("n_rows"))


def all_names(df: DataFrame, name: str | Column, wanted: Sequence[str] | None = None) -> list[str]:
    """The wanted names in their order, then every other one that occurs, sorted: a pivot on them loses no row."""
    column = F.col(name) if isinstance(name, str) else name
    found = df.select(column.cast("string").alias("_n")).distinct().where("_n is not null").toArrow().column("_n").to_pylist()
    wanted = list(wanted or [])
    return wanted + sorted(set(found) - set(wanted))


def wide_by_region(pct: DataFrame, scope: Sequence[str], regions: Sequence[str] | None = None, value: str = "atomic_percent",
                   fill: float | None = None) -> DataFrame:
    """One column for each region; regions that are not listed follow those that are."""
    regions = all_names(pct, "region", regions)
    wide = pct.groupBy(*scope).pivot("region", list(regions)).agg(F.first(value))
    return wide if fill is None else wide.na.fill(fill, list(regions))


def long_by_region(wide: DataFrame, scope: Sequence[str], regions: Sequence[str], value: str = "atomic_percent") -> DataFrame:
    return wide.unpivot(list(scope), list(regions), "region", value).filter(F.col(value).isNotNull())


def component_share(comps: DataFrame, scope: Sequence[str], area: str = "area", out: str = "area_percent") -> DataFrame:
    """Share of a component in its region's area; the group holds one row per component."""
    total = F.sum(area).over(Window.partitionBy(*scope))
    return comps.withColumn(out, F.when(total > 0, F.col(area) / total * 100.0).otherwise(0.0))


def drop_minor(comps: DataFrame, scope: Sequence[str], share: float = 2.0) -> DataFrame:
    """Drop components below `share` percent of the total before dropping, then re-base the shares."""
    first = component_share(comps, scope, out="_pct")
    return component_share(first.filter(F.col("_pct") >= share).drop("_pct"), scope)


def component_atomic_percent(comps: DataFrame, element: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element percent times component share; unmatched components keep NULL."""
    return comps.join(element.select(*keys, "atomic_percent"), list(keys), "left").withColumn(
        "component_atomic_percent", F.col("atomic_percent") * F.col("area_percent") / 100.0)


def sanity_check(comp_pct: DataFrame, keys: Sequence[str], tolerance: float = 1.0) -> DataFrame:
    """Components of an element must add up to the element."""
    g = comp_pct.groupBy(*keys).agg(
        F.max("atomic_percent").alias("element_percent"), F.sum("component_atomic_percent").alias("sum_components"),
        F.count("*").alias("n_components"))
    d = F.col("sum_components") - F.col("element_percent")
    return g.withColumn("difference", d).withColumn("passed", F.abs(d) <= tolerance)


def value_column(df: DataFrame, preferred: str | None = None) -> str:
    """Preferred column, else component percent, else area share."""
    for name in (preferred, "component_atomic_percent", "area_percent"):
        if name and name in df.columns:
            return name
    raise ValueError("no value column for the component table")


def component_features(comps: DataFrame, names: Sequence[tuple[str, str]] | None, value: str, how: str = "sum",
                       normalise: bool = False) -> DataFrame:
    """Wide table (sample, R_C_perc...) over layers with missing components as 0; unlisted components follow the listed."""
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max}.get(how, F.sum)
    key = F.concat_ws("_", "region", "component", F.lit("perc"))
    long = settled(comps.groupBy("sample", key.alias("_k")).agg(agg(value).alias("_v")), "features")
    cols = all_names(long, "_k", [f"{r}_{c}_perc" for r, c in names or []])
    wide = long.groupBy("sample").pivot("_k", cols).agg(F.first("_v")).na.fill(0.0, cols)
    if normalise:
        total = sum((F.col(c) for c in cols), F.lit(0.0))
        wide = wide.withColumn("_t", F.when(total == 0, 1.0).otherwise(total))
        wide = wide.select("sample", *[(F.col(c) / F.col("_t") * 100.0).alias(c) for c in cols])
    return wide


def chemistry_table(comp_pct: DataFrame, prefix: str, components: Sequence[str] | None, label: Column) -> DataFrame:
    """Mean component percent per sample label over regions that start with a prefix, with the row total."""
    own = comp_pct.filter(F.col("region").startswith(prefix)).withColumn("label", label)
    long = settled(own.groupBy("label", "component").agg(F.avg("component_atomic_percent").alias("_v")), "chemistry")
    components = all_names(long, "component", components)
    wide = long.groupBy("label").pivot("component", list(components)).agg(F.first("_v")).na.fill(0.0, list(components))
    return wide.withColumn("total", sum((F.col(c) for c in components), F.lit(0.0)))


def last_value_table(rows: DataFrame, scope: Sequence[str], column: str, names: Sequence[str] | None, value: str,
                     order: Sequence[str]) -> DataFrame:
    """Matrix in which a later row overwrites an earlier one; absent cells are 0."""
    latest = settled(rows.groupBy(*scope, column).agg(F.max_by(value, F.struct(*order)).alias("_v")), "cells")
    names = all_names(latest, column, names)
    return latest.groupBy(*scope).pivot(column, list(names)).agg(F.first("_v")).na.fill(0.0, list(names))


def first_value_table(rows: DataFrame, scope: Sequence[str], column: str, names: Sequence[str] | None, value: str,
                      order: Sequence[str]) -> DataFrame:
    """Matrix in which the first row counts; absent cells are 0."""
    first = settled(rows.groupBy(*scope, column).agg(F.min_by(value, F.struct(*order)).alias("_v")), "cells")
    names = all_names(first, column, names)
    return first.groupBy(*scope).pivot(column, list(names)).agg(F.first("_v")).na.fill(0.0, list(names))


def completeness(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Non-null count, rate and mean per column, in long form from one aggregate."""
    one = wide.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"n_{c}") for c in names],
                   *[F.avg(c).alias(f"m_{c}") for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n_{c}").alias("n_present"), F.col(f"m_{c}").alias("mean"))
                     for c in names])
    return one.select("_n", F.explode(rows).alias("r")).select(
        "r.name", "r.n_present", "r.mean", (F.col("r.n_present") / F.col("_n")).alias("rate"))


def outliers(rows: DataFrame, groups: Sequence[str], value: str, limit: float = 3.0) -> DataFrame:
    """Rows whose distance from the group mean exceeds `limit` sample standard deviations."""
    stats = rows.groupBy(*groups).agg(F.avg(value).alias("group_mean"), F.stddev_samp(value).alias("group_std"))
    df = join_stats(rows, stats, list(groups))
    z = F.when(F.col("group_std") > 0, (F.col(value) - F.col("group_mean")) / F.col("group_std"))
    return df.withColumn("z_score", z).filter(F.abs("z_score") > limit)


def drift_report(peaks: DataFrame, groups: Sequence[str], ordinal: str, peak: str, target: str,
                 tolerance: float = 0.5, critical_ev: float = 5.0) -> DataFrame:
    """First sample whose reference peak leaves the stable range: one mergeable aggregate, no ordered scan."""
    shift = F.col(peak) - F.col(target)
    off = F.abs(shift) > tolerance
    g = peaks.groupBy(*groups).agg(
        F.count("*").alias("n_samples"), F.min(F.when(off, F.col(ordinal))).alias("drift_start"),
        F.min_by(shift, F.when(off, F.col(ordinal))).alias("magnitude"), F.count_if(off).alias("n_shifted"))
    return g.withColumn("severity", F.when(F.col("drift_start").isNull(), "none")
                        .when(F.abs("magnitude") > critical_ev, "critical").otherwise("warning"))


def latest_run(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of the newest 14-digit run tag; with run as a partition column only that folder is read."""
    newest = df.filter(F.col(run).rlike(r"^\d{14}$")).agg(F.max(run)).first()[0]
    return df.filter(F.col(run) == F.lit(newest))


def run_summary(log: DataFrame) -> DataFrame:
    """Status counts of a step log and the success rate."""
    return log.groupBy("step").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("n_success"),
        F.avg("duration").alias("mean_duration")).withColumn("success_rate", F.col("n_success") / F.col("n"))
