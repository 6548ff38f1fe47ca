"""The two shapes of a spectrum: packed arrays and one row per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("spectrum_id",)


def along(keys: Sequence[str]) -> Window:
    """Points of one spectrum in channel order. A spectrum has a bounded number of channels."""
    return Window.partitionBy(*keys).orderBy("i")


def backwards(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc("i"))


def whole(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys)


def materialise(df: DataFrame, **columns: Column) -> DataFrame:
    """Add computed columns through a one-element generator.

    The optimizer pushes filters and merges projections by copying an expression into each place that uses it. For
    array functions that would repeat the work per element, so such columns go through a generator, which it
    does not look into. No shuffle and no Python is involved.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))


def pack(points: DataFrame, keys: Sequence[str] = KEYS, columns: Sequence[str] = ("energy", "intensity"),
         carry: Sequence[str] = ()) -> DataFrame:
    """Points -> one row per spectrum; arrays are ordered by channel index."""
    items = F.array_sort(F.collect_list(F.struct("i", *columns)))
    out = points.groupBy(*keys).agg(items.alias("_p"), *[F.first(c).alias(c) for c in carry])
    return materialise(out, **{c: F.col("_p")[c] for c in columns}).select(*keys, *carry, *columns)


def unpack(packed: DataFrame, columns: Sequence[str] = ("energy", "intensity")) -> DataFrame:
    """Packed -> points; inverse of pack."""
    rest = [c for c in packed.columns if c not in columns]
    z = packed.select(*rest, F.posexplode(F.arrays_zip(*[F.col(c) for c in columns])).alias("i", "_p"))
    return z.select(*rest, "i", *[F.col("_p")[c].alias(c) for c in columns])


def trapezoid(points: DataFrame, keys: Sequence[str], out: str = "area", x: str = "energy", y: str = "intensity",
              absolute: bool = True) -> DataFrame:
    """Area per spectrum; the sign of a descending axis is dropped."""
    w = along(keys)
    seg = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0
    area = F.coalesce(F.sum("_seg"), F.lit(0.0))
    return points.withColumn("_seg", seg).groupBy(*keys).agg((F.abs(area) if absolute else area).alias(out))


def roi(points: DataFrame, lo: float, hi: float) -> DataFrame:
    """Inclusive energy window; the bounds may come in either order."""
    return points.filter(F.col("energy").between(min(lo, hi), max(lo, hi)))


def array_trapezoid(x: Column, y: Column) -> Column:
    """Area of a packed curve."""
    n = F.size(x)
    return F.abs(F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0),
        lambda s, k: s + F.when(n > 1, (F.get(x, k) - F.get(x, k - 1)) * (F.get(y, k) + F.get(y, k - 1)) / 2.0)
        .otherwise(0.0)))
