"""Common grids and linear interpolation of packed spectra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_range(ranges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Intersection of [e_lo, e_hi] over a scope, the union when the intersection is empty."""
    g = ranges.groupBy(*scope).agg(F.max("e_lo").alias("_a"), F.min("e_hi").alias("_b"),
                                   F.min("e_lo").alias("_c"), F.max("e_hi").alias("_d"))
    meets = F.col("_a") < F.col("_b")
    return g.select(*scope, F.when(meets, F.col("_a")).otherwise(F.col("_c")).alias("grid_lo"),
                    F.when(meets, F.col("_b")).otherwise(F.col("_d")).alias("grid_hi"), meets.alias("overlap"))


def grid(lo: Column, hi: Column, step: Column) -> Column:
    """lo, lo + step, ... up to half a step beyond hi."""
    n = F.ceil((hi - lo) / step + F.lit(0.5)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: lo + k * step)


def linear_axis(lo: float | Column, hi: float | Column, n: Column) -> Column:
    """n evenly spaced energies from lo to hi, both included."""
    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(2)) - 1),
                                     lambda i: lo + i * (hi - lo) / (n - 1))).otherwise(F.array(lo))


def interpolate(x: Column, y: Column, targets: Column) -> Column:
    """Piecewise linear values of a packed ascending curve at sorted or unsorted targets; ends are held.

    The bracketing channel is found by bisection inside the row, so cost is targets * log(channels).
    """
    n = F.size(x)

    def bracket(g: Column) -> Column:
        """Largest k with x[k] <= g, for x[0] <= g < x[n-1]."""
        found = F.aggregate(
            F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int")),
            F.struct(F.lit(0).alias("a"), (n - 1).alias("b")),
            lambda s, _: F.when(
                s["b"] - s["a"] <= 1, s).otherwise(F.when(
                    F.get(x, F.shiftright(s["a"] + s["b"], 1)) <= g,
                    F.struct(F.shiftright(s["a"] + s["b"], 1).alias("a"), s["b"].alias("b")))
                .otherwise(F.struct(s["a"].alias("a"), F.shiftright(s["a"] + s["b"], 1).alias("b")))))
        return found["a"]

    def value(g: Column, k: Column) -> Column:
        x0, x1, y0, y1 = F.get(x, k), F.get(x, k + 1), F.get(y, k), F.get(y, k + 1)
        return y0 + (y1 - y0) * (g - x0) / (x1 - x0)

    located = F.transform(targets, lambda g: F.struct(g.alias("g"), bracket(g).alias("k")))
    return F.transform(located, lambda t: F.when(t["g"] <= F.get(x, F.lit(0)), F.get(y, F.lit(0)))
                       .when(t["g"] >= F.get(x, n - 1), F.get(y, n - 1)).otherwise(value(t["g"], t["k"])))


def combine_on_grid(packed: DataFrame, scope: Sequence[str], keys: Sequence[str], order: Sequence[str],
                    step: float | None = None) -> DataFrame:
    """Spectra of a scope on one grid: shared energy range, step of the scope's first spectrum unless given.

    Result is long (scope, keys, g, grid_energy, value); pivot it with explicit names for a wide view.
    """
    x = F.col("energy")
    n = F.size(x)
    steps = F.transform(F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda v, k: F.abs(v - F.get(x, k)))
    sorted_steps = F.array_sort(steps)
    m = F.size(steps)
    median = F.when(m == 0, 0.0).otherwise(
        (F.get(sorted_steps, F.floor((m - 1) / 2).cast("int")) + F.get(sorted_steps, F.floor(m / 2).cast("int"))) / 2.0)
    own = packed.withColumn("_step", median).withColumn("e_lo", F.array_min(x)).withColumn("e_hi", F.array_max(x))
    first = own.groupBy(*scope).agg(F.min_by("_step", F.struct(*order)).alias("_first"),
                                    F.max("e_lo").alias("grid_lo"), F.min("e_hi").alias("grid_hi"))
    chosen = F.lit(float(step)) if step else F.when(F.col("_first") == 0, 0.1).otherwise(F.col("_first"))
    first = first.filter(F.col("grid_lo") < F.col("grid_hi")).withColumn("_step_ev", chosen)
    from lumenfold.session import join_stats
    own = join_stats(own.drop("_step", "e_lo", "e_hi"), first.drop("_first"), list(scope))
    targets = grid(F.col("grid_lo"), F.col("grid_hi"), F.col("_step_ev"))
    out = own.withColumn("_g", targets).withColumn("_v", interpolate(F.col("energy"), F.col("intensity"), F.col("_g")))
    z = out.select(*scope, *[k for k in keys if k not in scope], F.posexplode(F.arrays_zip("_g", "_v")).alias("g", "_z"))
    return z.select(*[c for c in z.columns if c != "_z"], F.col("_z._g").alias("grid_energy"), F.col("_z._v").alias("value"))
