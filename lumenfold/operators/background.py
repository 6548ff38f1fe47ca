"""Backgrounds along the energy axis."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.fixed_values import TOUGAARD_B, TOUGAARD_C
from lumenfold.operators.points import backwards, whole


def integral_to_end(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str) -> DataFrame:
    """Trapezoid integral from each channel to the last one (0 on the last).

    The window runs backwards, so the integral is a running sum and not a sum over all later rows per row.
    """
    w = backwards(keys)
    seg = F.coalesce((F.lag(x).over(w) - F.col(x)) * (F.col(y) + F.lag(y).over(w)) / 2.0, F.lit(0.0))
    return df.withColumn("_seg", seg).withColumn(out, F.sum("_seg").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_seg")


def shirley_steps(points: DataFrame, keys: Sequence[str], steps: int = 5, out: str = "background",
                  clamp: bool = True) -> DataFrame:
    """Shirley background with a fixed number of steps on ascending energies.

    Every window runs backwards over the same partitioning, so the steps add no shuffle and no sort, and the
    integral is a running sum; a step costs two window operators.
    """
    w = backwards(keys)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    y, i = F.col("intensity"), F.col("i")
    df = points.withColumns({"_n": F.count("*").over(full), "_dx": F.lag("energy").over(w) - F.col("energy")})
    df = df.withColumn("_m", F.greatest(F.lit(1), F.least(F.lit(7), F.floor(F.col("_n") / 5))))
    df = df.withColumns({"_yl": F.avg(F.when(i < F.col("_m"), y)).over(full),
                         "_yr": F.avg(F.when(i >= F.col("_n") - F.col("_m"), y)).over(full)})
    line = F.when(F.col("_n") > 1, F.col("_yl") + (F.col("_yr") - F.col("_yl")) * i / (F.col("_n") - 1)).otherwise(F.col("_yl"))
    df = df.withColumn("_b", line)
    for _ in range(steps):
        df = df.withColumn("_d", y - F.col("_b"))
        df = df.withColumn("_seg", F.coalesce(F.col("_dx") * (F.col("_d") + F.lag("_d").over(w)) / 2.0, F.lit(0.0)))
        df = df.withColumns({"_s": F.sum("_seg").over(run), "_s0": F.sum("_seg").over(full)})
        df = df.withColumn("_b", F.col("_yr") + (F.col("_yl") - F.col("_yr")) / (F.col("_s0") + 1e-15) * F.col("_s"))
    b = F.least("_b", "intensity") if clamp else F.col("_b")
    return df.withColumn(out, b).drop("_n", "_dx", "_m", "_yl", "_yr", "_b", "_d", "_seg", "_s", "_s0")


def _batches_by_length(xs: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    lengths = xs.map(len).to_numpy()
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def _sums_to_end(seg: np.ndarray) -> np.ndarray:
    """Sum of each row's segments from every channel to the end, and 0 on the last channel.

    Curves of at most 256 channels are added from the channel upwards, in the order in which the sum is written, as the
    last digits decide whether a curve without a net peak has a height of zero. Longer ones take a running sum.
    """
    rows, n = seg.shape
    s = np.zeros((rows, n + 1))
    if n < 256:
        for k in range(n):
            s[:, :k + 1] += seg[:, k:k + 1]
    else:
        s[:, :-1] = np.cumsum(seg[:, ::-1], axis=1)[:, ::-1]
    return s


def shirley_batch(x: np.ndarray, y: np.ndarray, max_steps: int = 100, tol: float = 1e-6, clamp: bool = True) -> np.ndarray:
    """Converged Shirley background of many equally long ascending curves; each row stops by itself."""
    rows, n = y.shape
    m = max(1, min(7, n // 5))
    left, right = y[:, :m].mean(1, keepdims=True), y[:, -m:].mean(1, keepdims=True)
    b = left + (right - left) * np.arange(n) / max(n - 1, 1)
    dx = np.diff(x, axis=1)
    live = np.arange(rows)
    for _ in range(max_steps):
        d = y[live] - b[live]
        seg = dx[live] * (d[:, :-1] + d[:, 1:]) / 2.0
        s = _sums_to_end(seg)
        new = right[live] + (left[live] - right[live]) * s / (s[:, :1] + 1e-15)
        change = np.linalg.norm(new - b[live], axis=1) / (np.linalg.norm(b[live], axis=1) + 1e-15)
        b[live] = new
        live = live[~(change < tol)]
        if live.size == 0:
            break
    return np.minimum(b, y) if clamp else b


def shirley_packed(energy: Column, intensity: Column, max_steps: int = 100, tol: float = 1e-6,
                   clamp: bool = True) -> Column:
    """Converged Shirley background of a packed spectrum in any energy order, batched over an Arrow batch."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = [np.empty(0)] * len(xs)
        for n, rows in _batches_by_length(xs):
            if n == 0:
                continue
            x, y = np.stack(xs.iloc[rows].to_list()).astype(float), np.stack(ys.iloc[rows].to_list()).astype(float)
            order = np.argsort(x, axis=1, kind="stable")
            b = shirley_batch(np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1), max_steps, tol, clamp)
            back = np.empty_like(b)
            np.put_along_axis(back, order, b, 1)
            for r, v in zip(rows, back):
                out[r] = v
        return pd.Series(out)

    return run(energy, intensity)


def _loss(t: np.ndarray, b: float, c: float) -> np.ndarray:
    return b * t / (c + t * t) ** 2


def tougaard_even(step: np.ndarray, y: np.ndarray, b: float, c: float, include_last: bool) -> np.ndarray:
    """Loss integral of curves on even axes, one step a row: a convolution with the loss function, by FFT.

    The trapezoid rule takes half of the first and of the last value, and the loss at distance 0 is 0.
    """
    n = y.shape[1]
    loss = _loss(np.arange(n) * step[:, None], b, c)
    size = 1 << (2 * n - 1).bit_length()
    whole_sum = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(loss, size), size)[:, :n]
    ends = y[:, :1] * loss
    if not include_last:
        ends[:, 1:] += y[:, :-1] * loss[:, 1:2]
    out = step[:, None] * (whole_sum - ends / 2.0)
    out[:, :1 if include_last else 2] = 0.0
    return out


def tougaard_batch(x: np.ndarray, y: np.ndarray, b: float, c: float, include_last: bool) -> np.ndarray:
    """Loss integral below each channel of equally long ascending curves, a bounded number of them at a time.

    Even axes take a convolution, n log n in the channels; uneven ones all pairs of channels.
    """
    rows, n = y.shape
    out = np.zeros((rows, n))
    if n < 2:
        return out
    step = (x[:, -1] - x[:, 0]) / (n - 1)
    even = (step > 0) & (np.abs(np.diff(x, axis=1) - step[:, None]).max(axis=1) <= 1e-9 * step) & np.isfinite(y).all(axis=1)
    for at in np.array_split(np.flatnonzero(even), max(1, rows * n >> 20)):
        out[at] = tougaard_even(step[at], y[at], b, c, include_last)
    below = np.tri(n, n - 1, -1 if include_last else -2) if not even.all() else None
    size = max(1, (1 << 21) // max(n * n, 1))
    rest = np.flatnonzero(~even)
    for begin in range(0, len(rest), size):
        at = rest[begin:begin + size]
        xs, ys = x[at], y[at]
        g = ys[:, None, :] * _loss(xs[:, :, None] - xs[:, None, :], b, c)
        seg = np.diff(xs, axis=1)[:, None, :] / 2.0 * (g[:, :, :-1] + g[:, :, 1:])
        out[at] = (seg * below).sum(2)
    return out


def tougaard_curve(x: np.ndarray, y: np.ndarray, b: float, c: float, include_last: bool) -> np.ndarray:
    """Loss integral below each channel of one ascending curve."""
    return tougaard_batch(x[None, :], y[None, :], b, c, include_last)[0]


def tougaard_packed(energy: Column, intensity: Column, b: float = TOUGAARD_B, c: float = TOUGAARD_C,
                    include_last: bool = False) -> Column:
    """Universal cross-section loss integral below each channel of a packed ascending spectrum.

    It stays inside the row instead of emitting point pairs; spectra of equal length are worked out together, those on
    even axes as a convolution. By default the interval that ends in the channel itself is left out, as in
    the established results.
    """

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = [np.empty(0)] * len(xs)
        for n, rows in _batches_by_length(xs):
            if n:
                x, y = np.stack(xs.iloc[rows].to_list()).astype(float), np.stack(ys.iloc[rows].to_list()).astype(float)
                for r, v in zip(rows, tougaard_batch(x, y, b, c, include_last)):
                    out[r] = v
        return pd.Series(out)

    return run(energy, intensity)


def linear_background(points: DataFrame, keys: Sequence[str], out: str = "background") -> DataFrame:
    """Least-squares line over all points of the spectrum."""
    g = whole(keys)
    mx, my = F.avg("energy").over(g), F.avg("intensity").over(g)
    df = points.withColumn("_u", F.col("energy") - mx).withColumn("_my", my)
    df = df.withColumn("_suu", F.sum(F.col("_u") * F.col("_u")).over(g)) \
        .withColumn("_suy", F.sum(F.col("_u") * F.col("intensity")).over(g))
    slope = F.when(F.col("_suu") > 0, F.col("_suy") / F.col("_suu")).otherwise(F.lit(0.0))
    return df.withColumn(out, F.col("_my") + slope * F.col("_u")).drop("_u", "_my", "_suu", "_suy")


def quadratic_coefficients(u: Column, y: Column) -> dict[str, Column]:
    """Aggregates for a least-squares parabola in centred u; solve with `solve_quadratic`."""
    return {
        "_q0": F.count(y), "_q1": F.sum(u), "_q2": F.sum(u * u), "_q3": F.sum(u * u * u),
        "_q4": F.sum(u * u * u * u), "_r0": F.sum(y), "_r1": F.sum(u * y), "_r2": F.sum(u * u * y),
    }


def solve_quadratic(c: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(a0, a1, a2) of a0 + a1 u + a2 u^2 by Cramer's rule; NULL when the points do not fix a parabola."""
    s0, s1, s2, s3, s4 = (c[f"_q{k}"] for k in range(5))
    r0, r1, r2 = (c[f"_r{k}"] for k in range(3))

    def det(a, b, d, e, f, g, h, i, j):
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    whole_det = det(s0, s1, s2, s1, s2, s3, s2, s3, s4)
    safe = F.when(s0 >= 3, F.when(F.abs(whole_det) > 1e-12 * F.abs(s0 * s2 * s4), whole_det))
    return (
        det(r0, s1, s2, r1, s2, s3, r2, s3, s4) / safe,
        det(s0, r0, s2, s1, r1, s3, s2, r2, s4) / safe,
        det(s0, s1, r0, s1, s2, r1, s2, s3, r2) / safe,
    )


def polynomial_background(points: DataFrame, keys: Sequence[str], out: str = "background") -> DataFrame:
    """Least-squares parabola over all points; NULL when fewer than three channels fix it."""
    g = whole(keys)
    df = points.withColumn("_u", F.col("energy") - F.avg("energy").over(g))
    u, y = F.col("_u"), F.col("intensity")
    aggs = quadratic_coefficients(u, y)
    for name, c in aggs.items():
        df = df.withColumn(name, c.over(g))
    a0, a1, a2 = solve_quadratic({k: F.col(k) for k in aggs})
    return df.withColumn(out, a0 + a1 * u + a2 * u * u).drop("_u", *aggs)


def shirley(points: DataFrame, keys: Sequence[str], out: str = "background", clamp: bool = True, max_steps: int = 100,
            tol: float = 1e-6) -> DataFrame:
    """Converged Shirley background on points. A spectrum's points become one row of arrays and are laid out again.

    Both steps keep the spectrum's partitioning, so a shuffle by the keys before or after serves them all.
    """
    rest = [c for c in points.columns if c not in (*keys, "i")]
    g = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", *rest))).alias("_p"))
    g = g.withColumn("_b", shirley_packed(F.col("_p")["energy"], F.col("_p")["intensity"], max_steps, tol, clamp))
    z = g.select(*keys, F.explode(F.arrays_zip("_p", "_b")).alias("_z"))
    return z.select(*keys, *[F.col(f"_z._p.{c}").alias(c) for c in ("i", *rest)], F.col("_z._b").alias(out))


def background(points: DataFrame, keys: Sequence[str], method: str = "shirley", steps: int | None = None) -> DataFrame:
    """Dispatch by name and subtract; unknown names use Shirley, iterated until it stands still or for `steps` steps."""
    method = method.lower()
    if method == "linear":
        df = linear_background(points, keys)
    elif method == "polynomial":
        df = polynomial_background(points, keys)
    elif method == "tougaard":
        from lumenfold.operators.points import pack, unpack
        carry = [c for c in points.columns if c not in (*keys, "i", "energy", "intensity")]
        p = pack(points, keys, ("energy", "intensity", *carry))
        df = unpack(p.withColumn("background", tougaard_packed(F.col("energy"), F.col("intensity"))),
                    ("energy", "intensity", "background", *carry))
    else:
        df = shirley(points, keys) if steps is None else shirley_steps(points, keys, steps)
    return df.withColumn("corrected", F.col("intensity") - F.col("background"))
