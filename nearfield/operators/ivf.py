"""Inverted-file index: vectors by their nearest centroid, few cells probed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.arrays import binary, dimension, matrix, packed, usable
from nearfield.functions.metrics import block, check_metric
from nearfield.operators.blocks import SCHEMA, TASK_ROWS, few_rows, nearest, ranked, scan_cells, top_of_block, within_cells
from nearfield.operators.filters import allow, is_selective
from nearfield.operators.kmeans import KMeans, nearest_center
from nearfield.sources.tables import materialise


def nearest_cells(q: np.ndarray, centroids: np.ndarray, nprobe: int, metric: str) -> np.ndarray:
    """The ``nprobe`` nearest cells of each query, nearest first, the lower first of equal ones."""
    d = np.round(block(q, centroids, metric), 12)
    return np.argsort(d, axis=1, kind="stable")[:, :nprobe]


def probe(spark: SparkSession, queries: DataFrame, centroids: np.ndarray, nprobe: int, metric: str) -> DataFrame:
    """``cell, qid, v, rn``: the ``nprobe`` nearest cells of ``queries(qid, v)``."""
    shared, dim = spark.sparkContext.broadcast(centroids), centroids.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(1), dim, "f8")
            cells = nearest_cells(q, shared.value, nprobe, metric)
            row = np.repeat(np.arange(len(q)), cells.shape[1])
            rn = np.tile(np.arange(1, cells.shape[1] + 1, dtype=np.int32), len(q))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(pa.array(row)), binary(q[row]), pa.array(rn)], ["cell", "qid", "v", "rn"])

    return queries.select(F.col("qid").cast("long").alias("qid"), "v").mapInArrow(near, "cell int, qid long, v binary, rn int")


def by_cell(spark: SparkSession, corpus: DataFrame, centroids: np.ndarray, counts: np.ndarray, *keep: str) -> DataFrame:
    """``vec_id, v, cell`` and ``keep`` of the usable vectors of a corpus, cells apart, large ones in shares of ``TASK_ROWS``."""
    shared, dim = spark.sparkContext.broadcast((centroids, -(-np.maximum(counts, 1) // TASK_ROWS))), centroids.shape[1]
    rows = packed(corpus, dim, "embedding", "vec_id", *keep)
    names = ["vec_id", *keep, "v"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, shares = shared.value
        for batch in batches:
            cell = nearest_center(matrix(batch.column("v"), dim, "f8"), centroids)[0]
            spread = batch.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
            share = spread.astype(np.int64) % shares[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(share.astype(np.int32))], [*names, "cell", "share"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "cell int, share int"])
    return rows.mapInArrow(near, schema).repartition("cell", "share").drop("share")


class IVFIndex:
    """k-means cells (always by l2); a query scans the cells whose centroids are nearest by ``metric``.

    Probing all cells gives the exact result. With ``allowed`` a search of few allowed
    vectors (``is_selective``) is exact; otherwise the probed candidates are filtered
    and fewer than k may come out.
    """

    def __init__(self, nlist: int = 128, metric: str = "l2", nprobe: int = 8, init: str | np.ndarray = "k-means++", max_iter: int = 25, seed: int = 0, tol: float = 1e-4):
        self.nlist, self.metric, self.nprobe = nlist, check_metric(metric), nprobe
        self.init, self.max_iter, self.seed, self.tol = init, max_iter, seed, tol
        self.centroids: np.ndarray | None = None
        self.cells: DataFrame | None = None
        self.counts: np.ndarray | None = None
        self.inertia, self.kmeans_iters, self.n = 0.0, 0, 0

    def build(self, spark: SparkSession, corpus: DataFrame, *keep: str) -> IVFIndex:
        """Vectors are written by cell, once; ``keep`` names columns that filters will need."""
        dim = dimension(corpus, "embedding")
        n = corpus.where(usable(F.col("embedding"), dim)).count()
        k = KMeans(min(self.nlist, n), self.max_iter, self.tol, 1, self.init, self.seed).fit(spark, corpus, dim)
        self.centroids, self.inertia, self.kmeans_iters, self.counts, self.n = k.centers, k.inertia, k.n_iter, k.counts, n
        self.cells = materialise(spark, by_cell(spark, corpus, k.centers, k.counts, *keep), "cells", "cell")
        return self

    def built(self) -> None:
        if self.centroids is None:
            raise RuntimeError("build before searching or saving")

    def stats(self, spark: SparkSession) -> DataFrame:
        """``cell, n``, also of empty cells."""
        self.built()
        return spark.createDataFrame(list(enumerate(self.counts.tolist())), "cell int, n long")

    def shape(self) -> dict[str, float]:
        """Cells, passes and inertia of their k-means, and how full cells are."""
        self.built()
        return {"nlist": len(self.centroids), "kmeans_iters": self.kmeans_iters, "inertia": self.inertia, "avg_cell_size": self.n / len(self.centroids), "empty_cells": int((self.counts == 0).sum())}

    def memory_bytes(self) -> int:
        """Vectors and centroids in single precision, 8 bytes an id."""
        return 4 * self.n * self.centroids.shape[1] + 4 * self.centroids.size + 8 * self.n

    def search(self, spark: SparkSession, queries: DataFrame, k: int = 10, nprobe: int | None = None, allowed: Column | DataFrame | None = None) -> DataFrame:
        """``qid, vec_id, rn, dist`` for ``queries(qid, qvec)``.

        Queries of a checked size go to the tasks that read the probed cells, and only
        those are read. More of them meet the probed cells in a shuffle.
        """
        self.built()
        dim, metric = self.centroids.shape[1], self.metric
        asked, base = packed(queries, dim, "qvec", "qid"), allow(self.cells, allowed)
        if allowed is not None and is_selective(base.count(), self.n, k):
            return nearest(spark, asked, base, dim, k, metric)
        wanted = max(1, min(nprobe or self.nprobe, len(self.centroids)))
        few = few_rows(asked, dim)
        if few is None:
            probes = probe(spark, asked, self.centroids, wanted, metric)
            cells = [r["cell"] for r in probes.select("cell").distinct().collect()]  # at most all cells
            return within_cells(spark, probes, base.where(F.col("cell").isin(cells)), dim, k, metric)
        qids, q = few
        cells = nearest_cells(q, self.centroids, wanted, metric)
        shared = spark.sparkContext.broadcast((qids, q))

        def search(asking: np.ndarray, cell: int, rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            qids, q = shared.value
            return top_of_block(qids[asking], q[asking], rows.column("vec_id").to_numpy(), matrix(rows.column("v"), dim, "f8"), k, metric)

        probes = np.repeat(np.arange(len(q)), cells.shape[1]), cells.ravel()
        return ranked(scan_cells(spark, probes, base.select("cell", "vec_id", "v"), search, k, SCHEMA), k)

