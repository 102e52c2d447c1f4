"""Distances between vectors, as columns and as numpy blocks."""

from __future__ import annotations

import importlib.util

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "euclidean", "sqeuclidean", "cosine")
#: Up to so many dimensions a distance is written out, which compiles to one stage.
UNROLLED = 64


def check_metric(name: str) -> str:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known are {', '.join(METRICS)}")
    return "l2" if name == "euclidean" else name


def _terms(a: Column, b: Column, dim: int | None, f) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    if dim and dim <= UNROLLED:
        total = f(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
        for k in range(1, dim):
            total = total + f(F.get(a, F.lit(k)), F.get(b, F.lit(k)))
        return total
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def l2_sq(a: Column, b: Column, dim: int | None = None) -> Column:
    return _terms(a, b, dim, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column, dim: int | None = None) -> Column:
    return F.sqrt(l2_sq(a, b, dim))


def cosine(a: Column, b: Column, dim: int | None = None) -> Column:
    """1 - cos; 1 where a norm is 0."""
    norms = F.sqrt(_terms(a, a, dim, lambda x, y: x * y)) * F.sqrt(_terms(b, b, dim, lambda x, y: x * y))
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - _terms(a, b, dim, lambda x, y: x * y) / norms)


def get_metric(name: str):
    """The column builder ``(a, b, dim)`` of a metric; ValueError for an unknown one."""
    return {"l2": l2, "sqeuclidean": l2_sq, "cosine": cosine}[check_metric(name)]


def distance(a: Column, b: Column, metric: str = "l2", dim: int | None = None) -> Column:
    return get_metric(metric)(a, b, dim)


def similarity(dist: Column, digits: int | None = None) -> Column:
    """1 / (1 + distance)."""
    score = 1 / (1 + dist)
    return score if digits is None else F.round(score, digits)


def block_sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two blocks by one matrix product, at least 0."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)


def block(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Ranking values of all rows of two blocks: squared for l2."""
    if metric != "cosine":
        return block_sq(a, b)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    norms = na[:, None] * nb
    return 1 - np.where(norms > 0, a @ b.T, 0) / np.where(norms > 0, norms, 1)


def rowwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances of corresponding rows."""
    if metric == "cosine":
        norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return np.where(norms > 0, 1 - (a * b).sum(1) / np.where(norms > 0, norms, 1), 1.0)
    d = ((a - b) ** 2).sum(1)
    return d if metric == "sqeuclidean" else np.sqrt(d)


def blocks_available() -> bool:
    """Whether compiled kernels run: numpy's products on Arrow batches; without them only column expressions do."""
    return all(importlib.util.find_spec(name) is not None for name in ("numpy", "pyarrow"))
