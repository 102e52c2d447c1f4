"""Vectors between Spark columns and numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, size: int) -> Column:
    """The vector has ``size`` values, none null or NaN."""
    return vector.isNotNull() & (F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: str) -> np.ndarray:
    """A binary column of equal lengths as a matrix, without a copy of each value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], pa.binary())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.zeros((0, dim), kind)
    wide = pa.types.is_large_binary(column.type)
    start = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset]
    size = len(column) * dim * np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + size].view(kind).reshape(-1, dim)


def binary(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    values = np.ascontiguousarray(values)
    offsets = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))


def dense(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths without nulls as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest length of the vectors (the least of equally common ones)."""
    first = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(first["d"]) if first else 0


def packed(df: DataFrame, dim: int, vector: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``v``, the usable vectors as bytes of doubles."""
    rows = df.where(usable(F.col(vector), dim)).select(*keep, F.col(vector).cast("array<double>").alias("v"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], binary(dense(batch.column(len(names) - 1), dim))], names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "v binary"])
    return rows.mapInArrow(convert, schema)
