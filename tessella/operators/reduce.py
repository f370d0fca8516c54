"""Dimensionality reduction: principal components over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.operators.blocks import summed
from tessella.operators.cluster import matrix

#: Dimensions up to which the whole covariance is summed up, 8 bytes for each pair of them in a task; more go by range finding.
GRAM_DIM = 2048
#: Directions beyond those wanted, and passes, of the range finder.
SPARE, POWERS = 12, 3


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray  # a row a component
    variances: np.ndarray
    ratios: np.ndarray

    @property
    def size(self) -> int:
        return len(self.components)


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return matrix(batch.column("features"))


def _moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    mean = x.mean(0)
    rest = x - mean
    return np.array(float(len(x))), mean, rest.T @ rest


def _add_moments(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Rows, means and sums of squares and products about the mean, of both."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.multiply.outer(gap, gap) * (a[0] * b[0] / n)


def pca_of(n: float, mean: np.ndarray, covariance: np.ndarray, k: int) -> Pca:
    """The components of a covariance; each has its largest loading positive, so signs are settled."""
    values, vectors = np.linalg.eigh(covariance)
    return _settled(n, mean, values[::-1], vectors[:, ::-1].T, float(np.trace(covariance)), k)


def _settled(n: float, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray, total: float, k: int) -> Pca:
    k = int(max(1, min(k, n - 1, len(values))))
    values, vectors = np.maximum(values[:k], 0.0), vectors[:k]
    vectors = vectors * np.where(vectors[np.arange(k), np.abs(vectors).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Pca(mean, vectors, values, values / total if total > 0 else np.zeros(k))


def fit_pca(df: DataFrame, dim: int, k: int, *, rows_of: Callable[[pa.RecordBatch], np.ndarray] = _features, gram_dim: int = GRAM_DIM, seed: int = 42) -> Pca:
    """The ``k`` first components over all rows of ``df``, whose batches ``rows_of`` turns into matrices of ``dim`` columns.

    Up to ``gram_dim`` dimensions from the covariance, which tasks sum up: one pass, exact.  With more, the
    range that the covariance has most variance in is found from random directions, by ``POWERS``
    passes over products of ``dim`` times ``k`` and a few numbers, and the components within it.
    """
    if dim <= gram_dim:
        found = summed(df, _moments, _add_moments, rows_of)
        if found is None:
            return Pca(np.zeros(dim), np.eye(dim)[:1], np.zeros(1), np.zeros(1))
        n, mean, m2 = found
        return pca_of(float(n), mean, m2 / max(1.0, float(n) - 1), k)
    plain = lambda x: (np.array(float(len(x))), x.sum(0), (x * x).sum(0))
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    n, total, squares = summed(df, plain, add, rows_of)
    mean, below = total / n, max(1.0, float(n) - 1)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, min(dim, k + SPARE))))[0]
    for _ in range(POWERS):
        at = basis
        (product,) = summed(df, lambda x, at=at: ((x - mean).T @ ((x - mean) @ at),), add, rows_of)
        basis = np.linalg.qr(product)[0]
    at = basis
    (small,) = summed(df, lambda x: (((x - mean) @ at).T @ ((x - mean) @ at) / below,), add, rows_of)
    values, vectors = np.linalg.eigh(small)
    return _settled(float(n), mean, values[::-1], (basis @ vectors[:, ::-1]).T, float((squares - n * mean * mean).sum() / below), k)


def project(df: DataFrame, pca: Pca, features: str = "features", *, kernel: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, fields: list[T.StructField] | None = None) -> DataFrame:
    """``df`` with its features replaced by centred projections; with ``kernel``, which makes ``fields`` and the features of a batch, its results."""
    schema = df.schema if kernel is None else T.StructType([*fields, T.StructField(features, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                batch = kernel(batch) if kernel else batch
                out = (matrix(batch.column(features)) - pca.mean) @ pca.components.T
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([flat if n == features else batch.column(n) for n in batch.schema.names], names=schema.names)

    return df.mapInArrow(run, schema)


def axis_drivers(component: np.ndarray, columns: list[str], top: int = 3) -> list[str]:
    """The source columns with the largest loadings, each once, with the sign before it."""
    out: dict[str, str] = {}
    for j in sorted(range(len(component)), key=lambda j: (-abs(component[j]), j)):
        out.setdefault(columns[j], ("+" if component[j] >= 0 else "−") + columns[j])
        if len(out) == top:
            break
    return list(out.values())


def plot_range(values: np.ndarray) -> tuple[float, float]:
    """What a scatter shows: all but half a percent at either end, and a margin of six percent."""
    if not len(values):
        return 0.0, 1.0
    x = np.sort(values)
    low, high = x[int((len(x) - 1) * 0.005)], x[int((len(x) - 1) * 0.995)]
    pad = (high - low) * 0.06 or 1.0
    return float(low - pad), float(high + pad)
