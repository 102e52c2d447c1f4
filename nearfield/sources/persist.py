"""Indexes on disk: Parquet and one row about them."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from nearfield.operators.hnsw import HNSWIndex
from nearfield.operators.ivf import IVFIndex


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _read_meta(spark: SparkSession, path: str, kind: str) -> dict:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("type") != kind:
        raise ValueError(f"{path} holds a {meta.get('type')!r} index, not {kind!r}")
    return meta


def save_ivf(spark: SparkSession, index: IVFIndex, path: str) -> None:
    """Cells as partitions, as they were built: a search reads those it probes, and a large cell is written in shares."""
    index.built()
    index.cells.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    centroids = [(c, v.tolist(), int(n)) for c, (v, n) in enumerate(zip(index.centroids, index.counts))]
    spark.createDataFrame(centroids, "cell int, centroid array<double>, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    _write_meta(spark, path, {"type": "ivf", "nlist": index.nlist, "metric": index.metric, "nprobe": index.nprobe, "n": index.n, "inertia": index.inertia, "kmeans_iters": index.kmeans_iters})


def load_ivf(spark: SparkSession, path: str) -> IVFIndex:
    meta = _read_meta(spark, path, "ivf")
    index = IVFIndex(meta["nlist"], meta["metric"], meta["nprobe"])
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # one row a cell
    index.centroids = np.array([r["centroid"] for r in rows])
    index.counts = np.array([r["n"] for r in rows])
    index.cells = spark.read.parquet(f"{path}/cells")
    index.n, index.inertia, index.kmeans_iters = meta["n"], meta["inertia"], meta["kmeans_iters"]
    return index


def save_hnsw(spark: SparkSession, index: HNSWIndex, path: str) -> None:
    index.built()
    index.nodes.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/nodes")
    centers = [(c, v.tolist()) for c, v in enumerate(index.centers)]
    spark.createDataFrame(centers, "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    _write_meta(spark, path, {"type": "hnsw", "m": index.m, "ef_construction": index.ef_construction, "ef_search": index.ef_search, "metric": index.metric, "shard_probes": index.shard_probes, "n": index.n, "dim": index.dim})


def load_hnsw(spark: SparkSession, path: str) -> HNSWIndex:
    meta = _read_meta(spark, path, "hnsw")
    index = HNSWIndex(meta["m"], meta["ef_construction"], meta["ef_search"], meta["metric"], shard_probes=meta["shard_probes"])
    index.nodes, index.n, index.dim = spark.read.parquet(f"{path}/nodes"), meta["n"], meta["dim"]
    index.centers = np.array([r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("cell").collect()])  # one row a cell
    return index
