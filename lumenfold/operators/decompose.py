"""Matrix methods on one map: PCA, k-means, NMF, alternating least squares, NNLS projection, baselines, pixel fits.

The fits are those of `manymaps` with a single map, whose pixels stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import manymaps as mm
from lumenfold.operators.matrix import Factorisation, PrincipalAxes, list_of, matrix_of, ols_clip
from lumenfold.operators.nnls import nnls_each, nnls_rows


@contextmanager
def _packed(spectra: DataFrame, column: str) -> Iterator[mm.Blocks]:
    blocks = mm.pack(spectra, (), column)
    try:
        if not blocks.sizes:
            raise ValueError("no spectra")
        yield blocks
    finally:
        blocks.release()


def fit_pca(spectra: DataFrame, k: int = 3, column: str = "intensity") -> PrincipalAxes:
    """Centred PCA; the largest loading of each axis is positive."""
    with _packed(spectra, column) as blocks:
        return mm.fit_pca(blocks, k)[mm.ALL]


def scree(spark, pca: PrincipalAxes) -> DataFrame:
    rows = [(i + 1, float(v), float(r), float(c)) for i, (v, r, c) in enumerate(zip(pca.variance, pca.ratio, np.cumsum(pca.ratio)))]
    return spark.createDataFrame(rows, "component int, variance double, ratio double, cumulative double")


def component_count(ratio: Sequence[float], threshold: float = 0.95, least: int = 2, most: int = 10, closure: bool = False) -> int:
    """First count whose cumulative ratio reaches the threshold; the maximum when it is never reached.

    `closure=True` adds one for mixtures whose fractions sum to a constant, which lose a rank by centring.
    """
    cum = np.cumsum(np.asarray(ratio)[:most])
    hit = np.flatnonzero(cum >= threshold)
    n = int(hit[0]) + 1 if hit.size else len(cum)
    return min(most, max(least, n) + (1 if closure else 0))


def per_row(column: Column, fn: Callable[[np.ndarray], np.ndarray]) -> Column:
    """ARRAY<DOUBLE> -> ARRAY<DOUBLE> by a function on the matrix of an Arrow batch."""

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array) -> pa.Array:
        return list_of(fn(matrix_of(xs)))

    return run(column.cast("array<double>"))


def pca_scores(column: Column, pca: PrincipalAxes) -> Column:
    mean, axes = pca.mean, pca.axes
    return per_row(column, lambda x: (x - mean) @ axes)


def cluster(scored: DataFrame, scores: str = "scores", k: int = 4, seed: int = 0, out: str = "cluster") -> DataFrame:
    with _packed(scored, scores) as blocks:
        return mm.cluster(scored, mm.fit_kmeans(blocks, k, seed), (), scores, out)


def project(column: Column, basis: np.ndarray) -> Column:
    """Non-negative coefficients of each pixel on a fixed basis (components x channels)."""
    b = np.asarray(basis, float)
    return per_row(column, lambda x: nnls_rows(x, b))


def fit_nmf(spectra: DataFrame, k: int, column: str = "intensity", iterations: int = 500, tol: float = 1e-6) -> Factorisation:
    """Non-negative factorisation; raises when a component is lost."""
    with _packed(spectra, column) as blocks:
        return mm.fit_nmf(blocks, k, iterations, tol)[mm.ALL]


def fit_mcr(spectra: DataFrame, k: int, column: str = "intensity", iterations: int = 50, tol: float = 1e-6,
            start: np.ndarray | None = None) -> Factorisation:
    """Alternating least squares with clipping, started from the absolute PCA loadings; NMF when it breaks down."""
    with _packed(spectra, column) as blocks:
        if start is None:
            start = np.abs(mm.fit_pca(blocks, k)[mm.ALL].axes.T)
        return mm.fit_mcr(blocks, {mm.ALL: start}, iterations, tol)[mm.ALL]


def concentrations(column: Column, spectra: np.ndarray, exact: bool = False) -> Column:
    s = np.asarray(spectra, float)
    return per_row(column, (lambda x: nnls_rows(x, s)) if exact else (lambda x: ols_clip(x, s)))


# ---- baselines and pixel fits -----------------------------------------------

def als_batch(y: np.ndarray, lam: float = 1e5, p: float = 0.01, steps: int = 10) -> np.ndarray:
    """Asymmetric least squares baseline of many rows: (W + lam D D') b = W y, solved as a five-band system."""
    rows, n = y.shape
    if n < 3:
        return y.copy()
    d = np.zeros(n)
    e1 = np.zeros(n - 1)
    e2 = np.full(n - 2, lam)
    for k in range(n - 2):  # second differences 1, -2, 1
        d[k:k + 3] += lam * np.array([1.0, 4.0, 1.0])
        e1[k:k + 2] += lam * -2.0
    w = np.ones_like(y)
    b = y.copy()
    for _ in range(steps):
        diag = np.empty_like(y)
        l1 = np.zeros((rows, n))
        l2 = np.zeros((rows, n))
        z = w * y
        for i in range(n):  # LDL' of the band, one column at a time for all rows
            v = d[i] + w[:, i]
            if i >= 1:
                v = v - l1[:, i - 1] ** 2 * diag[:, i - 1]
                z[:, i] -= l1[:, i - 1] * z[:, i - 1]
            if i >= 2:
                v = v - l2[:, i - 2] ** 2 * diag[:, i - 2]
                z[:, i] -= l2[:, i - 2] * z[:, i - 2]
            diag[:, i] = v
            if i < n - 1:
                c = e1[i]
                if i >= 1:
                    c = c - l1[:, i - 1] * l2[:, i - 1] * diag[:, i - 1]
                l1[:, i] = c / v
            if i < n - 2:
                l2[:, i] = e2[i] / v
        z = z / diag
        for i in range(n - 2, -1, -1):
            z[:, i] -= l1[:, i] * z[:, i + 1]
            if i < n - 2:
                z[:, i] -= l2[:, i] * z[:, i + 2]
        b = z
        w = p * (y > b) + (1 - p) * (y < b)
    return b


def als_baseline(column: Column, lam: float = 1e5, p: float = 0.01, steps: int = 10) -> Column:
    return per_row(column, lambda y: als_batch(y, lam, p, steps))


def gaussian_basis(axis: np.ndarray, centres: Sequence[float], sigmas: Sequence[float], shift: float) -> np.ndarray:
    return np.stack([np.exp(-0.5 * ((axis - c - shift) / (s + 1e-12)) ** 2) for c, s in zip(centres, sigmas)])


def fit_pixels(spectra: DataFrame, axis: Sequence[float], centres: Sequence[float], sigmas: Sequence[float],
               column: str = "intensity", reach: float = 0.5, step: float = 0.02, refine: bool = True) -> DataFrame:
    """Amplitudes >= 0 on fixed line shapes with one common shift: add amplitudes, shift and mse."""
    return fit_pixels_by_map(spectra, axis, {mm.ALL: (centres, sigmas)}, (), column, reach, step, refine)


def fit_pixels_by_map(spectra: DataFrame, axis: Sequence[float], lines: Mapping[str, tuple[Sequence[float], Sequence[float]]],
                      maps: Sequence[str] = (), column: str = "intensity", reach: float = 0.5, step: float = 0.02,
                      refine: bool = True) -> DataFrame:
    """The same with centres and widths of each map's own (by the text of its key); nulls for maps without lines.

    For a given shift the amplitudes are a small NNLS, so the shift is scanned on a lattice and refined by a parabola.
    """
    e = np.asarray(axis, float)
    lattice = np.round(np.arange(-round(reach / step), round(reach / step) + 1) * step, 10)

    def solve(x: np.ndarray, centres: Sequence[float], sigmas: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bank = [gaussian_basis(e, centres, sigmas, s) for s in lattice]
        fits = [nnls_rows(x, b) for b in bank]
        errors = np.stack([((x - c @ b) ** 2).mean(1) for c, b in zip(fits, bank)])
        best = errors.argmin(0)
        rows = np.arange(len(x))
        amps, shift, mse = np.stack(fits)[best, rows], lattice[best], errors[best, rows]
        if refine:
            inner = np.clip(best, 1, len(lattice) - 2)
            a, b, c = errors[inner - 1, rows], errors[inner, rows], errors[inner + 1, rows]
            curve = a - 2 * b + c
            move = np.where(curve > 0, 0.5 * (a - c) / np.where(curve > 0, curve, 1.0), 0.0)
            trial = np.clip(lattice[inner] + np.clip(move, -1, 1) * step, -reach, reach)
            bases = np.stack([gaussian_basis(e, centres, sigmas, s) for s in trial]) if len(x) else np.zeros((0, len(centres), len(e)))
            coef = nnls_each(x, bases)
            err = ((x - np.einsum("rk,rkn->rn", coef, bases)) ** 2).mean(1)
            better = err < mse
            amps[better], shift[better], mse[better] = coef[better], trial[better], err[better]
        return amps, shift, mse

    @F.pandas_udf("amplitudes array<double>, shift double, mse double")
    def run(keys: pd.Series, xs: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"amplitudes": [None] * len(xs), "shift": np.nan, "mse": np.nan})
        for key, at in keys.reset_index(drop=True).groupby(keys.to_numpy()).groups.items():
            if key in lines:
                amps, shift, mse = solve(np.stack(xs.iloc[at].to_list()).astype(float), *lines[key])
                out.loc[at, "shift"], out.loc[at, "mse"] = shift, mse
                for i, a in zip(at, amps):
                    out.at[i, "amplitudes"] = a
        return out

    d = spectra.withColumn("_f", run(mm.map_key(maps), F.col(column)))
    return d.withColumn("amplitudes", F.col("_f.amplitudes")).withColumn("shift", F.col("_f.shift")) \
        .withColumn("mse", F.col("_f.mse")).drop("_f")
