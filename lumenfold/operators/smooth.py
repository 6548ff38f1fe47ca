"""Savitzky-Golay smoothing of packed spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def savgol_matrix(window: int, order: int) -> np.ndarray:
    """Row p holds the weights that evaluate the window's polynomial fit at its p-th point."""
    t = np.arange(window) - window // 2
    v = np.vander(t, order + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def savgol(y: Column, window: int = 7, order: int = 2, min_points: int = 20) -> Column:
    """Smoothed curve; edges come from the fit to the first and last window; short curves stay as they are."""
    if window % 2 == 0 or window <= order:
        raise ValueError("window must be odd and larger than the order")
    need = max(min_points, window, order + 2)
    table = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in savgol_matrix(window, order)])
    n = F.size(y)

    def at(k: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(k - window // 2, n - window))
        return F.aggregate(
            F.zip_with(F.get(table, k - start), F.slice(y, start + 1, F.lit(window)), lambda c, v: c * v),
            F.lit(0.0), lambda s, v: s + v)

    return F.when(n >= need, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(y)
