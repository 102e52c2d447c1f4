"""k-means: seeding on a bounded sample, iterations over all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.arrays import dense, dimension, usable

#: Vectors that k-means++ seeds from.
SEED_ROWS = 20_000
#: Vectors of at most so many bytes in all are iterated over in memory, more in passes.
LOCAL_BYTES = 64 << 20
#: Centres meet a batch in blocks of at most so many distances.
CELLS = 1 << 19


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Seeds drawn with probability as their squared distance to the nearest earlier one."""
    norms = (x**2).sum(1)
    least = 1e-12 * max(float(norms.max(initial=0.0)), 1e-300)  # below it a distance is rounding
    chosen, d = [int(rng.integers(len(x)))], np.full(len(x), np.inf)
    while True:
        new = norms - 2 * (x @ x[chosen[-1]]) + norms[chosen[-1]]
        d = np.minimum(d, np.where(new > least, new, 0))
        d[chosen[-1]] = 0
        if len(chosen) == k:
            return x[chosen]
        upto = np.cumsum(d)
        chosen.append(min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(x) - 1) if upto[-1] > 0 else int(rng.integers(len(x))))


@dataclass
class KMeans:
    """Lloyd's iterations from seeds by ``init``: ``k-means++``, ``first_k`` (the smallest ids) or a matrix.

    Each iteration is one pass for all runs: tasks add up their vectors by nearest
    centre (the lowest of equally near ones), the sums of a centre are combined, and
    only centres reach the driver. Vectors of at most ``LOCAL_BYTES`` are fetched once
    and added up there the same way. A centre without vectors moves to one of the vectors farthest from theirs,
    each to another. It ends when the centres move by at most ``tol`` in all (squared)
    or after ``max_iter``. Of ``n_init`` runs the one of least inertia is kept.
    """

    n_clusters: int
    max_iter: int = 100
    tol: float = 1e-4
    n_init: int = 3
    init: str | np.ndarray = "k-means++"
    seed: int = 0
    centers: np.ndarray | None = None
    inertia: float | None = None
    n_iter: int = 0

    counts: np.ndarray | None = None

    def fit(self, spark: SparkSession, df: DataFrame, dim: int | None = None) -> KMeans:
        dim = dim or dimension(df, "embedding")
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding"), dim))
        n = rows.count()
        if self.n_clusters > n:
            raise ValueError(f"{self.n_clusters} clusters of {n} vectors")
        data = Local(rows, dim) if 8 * n * (dim + 1) <= LOCAL_BYTES else Passes(spark, rows, dim)
        runs = self._seeds(data, rows, dim)
        steps, active = [0] * len(runs), list(range(len(runs)))
        while active := [r for r in active if steps[r] < self.max_iter]:
            for r, (sums, counts, _) in zip(active, data.sums([runs[r] for r in active])):
                new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], runs[r])
                if (empty := np.flatnonzero(counts == 0)).size:
                    far = data.farthest(runs[r], len(empty))
                    new[empty[: len(far)]] = far
                steps[r] += 1
                moved, runs[r] = ((new - runs[r]) ** 2).sum(), new
                if moved <= self.tol:
                    active = [other for other in active if other != r]
        last = data.sums(runs)
        best = min(range(len(runs)), key=lambda r: last[r][2])
        self.centers, self.counts, self.inertia, self.n_iter = runs[best], last[best][1].astype(np.int64), float(last[best][2]), steps[best]
        return self

    def _seeds(self, data: Local | Passes, rows: DataFrame, dim: int) -> list[np.ndarray]:
        if not isinstance(self.init, str):
            return [np.array(self.init, np.float64)]
        if self.init == "first_k":
            return [data.some(F.col("vec_id"), self.n_clusters)]
        if self.init != "k-means++":
            raise ValueError(f"unknown init {self.init!r}")
        x = data.some(F.xxhash64("vec_id", F.lit(self.seed)), max(SEED_ROWS, self.n_clusters))
        return [plus_plus(x, self.n_clusters, np.random.default_rng([self.seed, run])) for run in range(self.n_init)]

    def predict(self, spark: SparkSession, df: DataFrame) -> DataFrame:
        """``vec_id, cell, d2``; works on a stream of vectors too."""
        if self.centers is None:
            raise RuntimeError("fit before predict")
        return assign(spark, df, self.centers, self.centers.shape[1])

    def fit_predict(self, spark: SparkSession, df: DataFrame) -> DataFrame:
        return self.fit(spark, df).predict(spark, df)


def nearest_center(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the lowest of equal ones, and the squared distance."""
    cell, step = np.empty(len(x), np.int64), max(1, CELLS // len(centers))
    twice, norms = -2 * centers.T, (centers**2).sum(1)
    for at in range(0, len(x), step):
        d = x[at : at + step] @ twice
        d += norms
        d -= d.min(1, keepdims=True)
        cell[at : at + step] = (d <= 1e-12).argmax(1)
    return cell, ((x - centers[cell]) ** 2).sum(1)


def add_up(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Per centre the sum of its vectors, their number and their squared distances."""
    cell, d2 = nearest_center(x, centers)
    out = np.zeros((len(centers), x.shape[1] + 2))
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0]) if len(x) else np.zeros(0, np.int64)
    if len(x):
        out[cell[order][starts], :-2] = np.add.reduceat(x[order], starts, axis=0)
    out[:, -2] = np.bincount(cell, minlength=len(centers))
    out[:, -1] = np.bincount(cell, d2, len(centers))
    return out


def parted(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    return total[:, :-2], total[:, -2], total[:, -1].sum()


class Local:
    """Vectors few enough to be held by the driver."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim, self.held = rows, dim, None

    def _matrix(self) -> np.ndarray:
        if self.held is None:
            found = self.rows.toArrow().sort_by("vec_id")  # at most LOCAL_BYTES
            self.ids, self.held = found.column("vec_id").to_numpy(), _dense(found.column("embedding"), self.dim)
        return self.held

    def some(self, order: Column, n: int) -> np.ndarray:
        return _dense(self.rows.orderBy(order, "vec_id").limit(n).select("embedding").toArrow().column(0), self.dim)

    def sums(self, runs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        return [parted(add_up(self._matrix(), centers)) for centers in runs]

    def farthest(self, centers: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` vectors farthest from their centres, ties to the smaller id."""
        x = self._matrix()
        return x[np.lexsort((self.ids, -nearest_center(x, centers)[1]))[:n]]


class Passes:
    """Vectors that stay where they are; every step is a pass over them."""

    def __init__(self, spark: SparkSession, rows: DataFrame, dim: int):
        self.spark, self.rows, self.dim = spark, rows, dim

    some = Local.some

    def sums(self, runs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        shared, dim, k = self.spark.sparkContext.broadcast(runs), self.dim, len(runs[0])
        names = [f"x{j}" for j in range(dim + 2)]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(shared.value), k, dim + 2))
            for batch in batches:
                x = dense(batch.column(0), dim)
                for r, centers in enumerate(shared.value):
                    total[r] += add_up(x, centers)
            total = total.reshape(-1, dim + 2)
            at = np.flatnonzero(total[:, dim])
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, j]) for j in range(dim + 2))], ["cell", *names])

        parts = self.rows.select("embedding").mapInArrow(add, ", ".join(["cell long", *(f"{n} double" for n in names)]))
        found = parts.groupBy("cell").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # one row a centre and run
        out = np.zeros((len(runs) * k, dim + 2))
        out[found.column("cell").to_numpy()] = np.column_stack([found.column(n).to_numpy() for n in names]).reshape(-1, dim + 2)
        return [parted(t) for t in out.reshape(len(runs), k, dim + 2)]

    def farthest(self, centers: np.ndarray, n: int) -> np.ndarray:
        far = assign(self.spark, self.rows, centers, self.dim, keep=True).orderBy(F.desc("d2"), "vec_id").limit(n)
        return _dense(far.select("embedding").toArrow().column(0), self.dim)


def _dense(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, dim)), *(dense(c, dim) for c in column.chunks)])


def assign(spark: SparkSession, df: DataFrame, centers: np.ndarray, dim: int, keep: bool = False) -> DataFrame:
    """``vec_id, cell, d2`` of the usable vectors, and ``embedding`` if kept."""
    shared = spark.sparkContext.broadcast(centers)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d2 = nearest_center(dense(batch.column(1), dim), shared.value)
            columns = [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(d2), *([batch.column(1)] if keep else [])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cell", "d2", *(["embedding"] if keep else [])])

    rows = df.where(usable(F.col("embedding"), dim)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(near, "vec_id long, cell int, d2 double" + (f", embedding {dict(rows.dtypes)['embedding']}" if keep else ""))
