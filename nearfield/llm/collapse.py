"""Collapsing exact copies of vectors before anything is compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.arrays import usable
from nearfield.sources.tables import materialise


def vector_groups(spark: SparkSession, df: DataFrame, id_column: str, vector: Column, dim: int, kind: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """``(members, groups)``: ``members(id, rep)`` and ``groups(gid, v, ids, n, reps)``.

    A group holds the records of one exact vector: its smallest id ``gid``, the vector
    as bytes, its ``keep`` smallest ids, its size and ``reps``, one id a batch. Copies within an Arrow batch are
    collapsed before the shuffle, so a group of any size sends one record a batch;
    ``rep`` is the smallest id of a record's batch and vector. Vectors of another length
    or with a null or NaN and rows with a null id are left out; -0.0 counts as 0.0; an
    id that occurs again counts once.
    """

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim) + np.dtype(kind).type(0)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * dim))).ravel()
            codes, _ = pd.factorize(pd.Series(raw.tolist(), dtype=object)) if len(raw) else (np.zeros(0, int), None)
            first = np.unique(codes, return_index=True)[1]
            reps = ids[first][codes] if len(ids) else ids
            heads: list = [None] * len(ids)
            by = np.argsort(codes, kind="stable")
            bounds = np.append(np.searchsorted(codes[by], np.arange(len(first))), len(ids)) if len(ids) else [0]
            for c, at in enumerate(first):
                heads[at] = list(dict.fromkeys(ids[by[bounds[c] : bounds[c + 1]]].tolist()))[:keep]
            is_head = np.zeros(len(ids), bool)
            is_head[first] = True
            v = pa.array([b if h else None for b, h in zip(raw.tolist(), is_head)], pa.binary())
            size = np.bincount(codes, minlength=len(first))[codes] if len(ids) else codes
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(reps, pa.int64()), v, pa.array(heads, pa.list_(pa.int64())), pa.array(np.where(is_head, size, 0), pa.int64())], ["id", "rep", "v", "ids", "n"]
            )

    rows = df.select(F.col(id_column).cast("long").alias("id"), vector.alias("x")).where(usable(F.col("x"), dim) & F.col("id").isNotNull())
    rows = materialise(spark, rows.mapInArrow(collapse, "id long, rep long, v binary, ids array<long>, n long"), "vectors")
    heads = rows.where("v IS NOT NULL").select("v", "ids", "n")
    merged = heads.groupBy("v").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"), F.sum("n").alias("n"), F.collect_list(F.col("ids")[0]).alias("reps")
    )
    groups = materialise(spark, merged.select(F.col("ids")[0].alias("gid"), "v", "ids", "n", "reps"), "groups")
    return rows, groups


def members(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``id`` and the columns of ``groups`` but ``reps``, joined by the batch's first record, so never by a hot vector."""
    named = groups.withColumn("rep", F.explode("reps")).drop("reps")
    return rows.select("id", "rep").join(named, "rep").drop("rep").dropDuplicates(["id", "gid"])
