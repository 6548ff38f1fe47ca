"""Arrow lists as matrices, and the results of matrix methods."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa


def matrix_of(column: pa.Array) -> np.ndarray:
    """Arrow list column of equally long lists -> matrix without a copy per row."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def list_of(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, dtype=float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


@dataclass
class PrincipalAxes:
    mean: np.ndarray
    axes: np.ndarray  # channels x k
    variance: np.ndarray
    ratio: np.ndarray
    leading: np.ndarray = field(repr=False, default=None)  # channels x k, of the spectra as they are, not centred
    n: int = 0


@dataclass
class Factorisation:
    spectra: np.ndarray  # components x channels
    iterations: int
    residual: float
    r2: float
    converged: bool
    fallback: bool = False


def upward(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest entry of each is positive."""
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] if vectors.size else np.ones(vectors.shape[1])
    return vectors * np.where(top < 0, -1.0, 1.0)


def ols_clip(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Least squares amounts of the rows, negative ones set to 0."""
    g = s @ s.T
    return np.maximum(x @ s.T @ np.linalg.inv(g + 1e-12 * np.trace(g) * np.eye(len(s))), 0.0)
