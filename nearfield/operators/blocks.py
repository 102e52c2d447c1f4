"""Exact top k of queries among the vectors of their blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.arrays import matrix
from nearfield.functions.metrics import block, check_metric, rowwise

#: Queries of at most so many bytes are sent to every executor.
MAX_BROADCAST_BYTES = 64 << 20
#: Vectors, and queries, that meet in one task.
TASK_ROWS = 20_000
CELLS = 1 << 22
SCHEMA = "qid long, vec_id long, dist double"


def top_of_block(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``qid, vec_id, dist`` of the k nearest rows of x for each q, ties to the smaller id.

    A matrix product shortlists all that can be among the k nearest within its error;
    those are scored again directly in double precision.
    """
    out = []
    step = max(1, CELLS // max(1, len(x)))
    for at in range(0, len(q), step) if k > 0 and len(x) else ():
        part = q[at : at + step]
        d = block(part, x, metric)
        if k < len(x):
            bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            i, j = np.nonzero(d <= bound + 1e-9 * (1 + (part**2).sum(1)[:, None] + (x**2).sum(1).max()))
        else:
            i, j = np.divmod(np.arange(d.size), len(x))
        exact = rowwise(part[i], x[j], metric)
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        starts = np.searchsorted(i, np.arange(len(part)))
        keep = np.arange(len(i)) - starts[i] < k
        out.append((qids[at + i[keep]], ids[j[keep]], exact[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, d = (np.concatenate(c) for c in zip(*out))
    return a, b, d


def ranked(found: DataFrame, k: int, *keep: str) -> DataFrame:
    """``qid, vec_id, rn, dist`` and ``keep``: the k best candidates of each query."""
    rn = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "vec_id"))
    return found.withColumn("rn", rn).where(F.col("rn") <= k).select("qid", "vec_id", "rn", "dist", *keep)


def scan(spark: SparkSession, queries: tuple[np.ndarray, np.ndarray], base: DataFrame, dim: int, k: int, metric: str) -> DataFrame:
    """All of ``base(vec_id, v)`` against a few queries, each task keeping its k best."""
    shared = spark.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            new = top_of_block(qids, q, batch.column(0).to_numpy(), matrix(batch.column(1), dim, "f8"), k, metric)
            a, b, d = (np.concatenate(c) for c in zip(best, new))
            order = np.lexsort((b, d, a))
            a, b, d = a[order], b[order], d[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            best = a[keep], b[keep], d[keep]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["qid", "vec_id", "dist"])

    return ranked(base.mapInArrow(search, SCHEMA), k)


def few_rows(queries: DataFrame, dim: int, max_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of ``queries(qid, v)``, or none if they have more than ``max_bytes``."""
    limit = (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes) // (8 * max(dim, 1))
    few = queries.select("qid", "v").limit(limit + 1).toArrow()
    return (few.column("qid").to_numpy(), matrix(few.column("v"), dim, "f8")) if few.num_rows <= limit else None


def by_value(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different values and, of each, the places where it stands."""
    order = np.argsort(values, kind="stable")
    found, starts = np.unique(values[order], return_index=True)
    return found, np.split(order, starts[1:]) if len(found) else []


def scan_cells(spark: SparkSession, probes: tuple[np.ndarray, np.ndarray], base: DataFrame, search: Callable, keep: int, schema: str) -> DataFrame:
    """What ``search(queries, cell, rows)`` gives, for every batch of probed cells; each task keeps the ``keep`` best a query.

    ``probes`` holds query places and cells. Only files of probed cells are read, since
    ``base`` is parted by cell, and nothing of it is shuffled. ``search`` gives query
    places and then columns, of which the first two, id and distance, rank.
    """
    places, cells = probes
    listed, of_cell = by_value(cells)
    wanted = spark.sparkContext.broadcast({int(c): places[at] for c, at in zip(listed, of_cell)})
    names = [part.split()[0] for part in schema.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            found = [] if best is None else [best]
            for cell, rows in zip(*by_value(batch.column("cell").to_numpy())):
                if (asking := wanted.value.get(int(cell))) is not None:
                    found.append(search(asking, int(cell), batch.take(pa.array(rows))))
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                order = np.lexsort((columns[1], columns[2], columns[0]))
                query = columns[0][order]
                order = order[np.arange(len(order)) - np.searchsorted(query, query) < keep]
                best = tuple(c[order] for c in columns)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names)

    return base.where(F.col("cell").isin([int(c) for c in listed])).mapInArrow(look, schema)


def within_cells(spark: SparkSession, queries: DataFrame, base: DataFrame, dim: int, k: int, metric: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Each query of ``queries(cell, qid, v)`` against the vectors of its cells in ``base(cell, vec_id, v)``.

    A cell with many vectors or queries is cut into shares of ``task_rows``; each share
    of its vectors meets each share of its queries in a task of its own, and tasks give
    only their k best, so a cell of any size is spread.
    """
    counts = base.groupBy("cell").agg(F.count("*").alias("n")).join(queries.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    large = counts.where((F.col("n") > task_rows) | (F.col("m") > task_rows)).select("cell", F.ceil(F.col("n") / task_rows).cast("int").alias("bs"), F.ceil(F.col("m") / task_rows).cast("int").alias("qs"))
    bs, qs = F.coalesce("bs", F.lit(1)), F.coalesce("qs", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    b = base.join(large, "cell", "left").select("cell", F.pmod(F.xxhash64("vec_id"), bs).cast("int").alias("bshare"), every(qs).alias("qshare"), F.lit(0).cast("long").alias("qid"), "vec_id", "v", F.lit(False).alias("ask"))
    a = queries.join(large, "cell", "left").select("cell", every(bs).alias("bshare"), F.pmod(F.xxhash64("qid"), qs).cast("int").alias("qshare"), "qid", F.lit(0).cast("long").alias("vec_id"), "v", F.lit(True).alias("ask"))

    def search(rows: pa.Table) -> pa.Table:
        ask = rows.column("ask").to_numpy()
        x = matrix(rows.column("v"), dim, "f8")
        found = top_of_block(rows.column("qid").to_numpy()[ask], x[ask], rows.column("vec_id").to_numpy()[~ask], x[~ask], k, metric)
        return pa.table(dict(zip(("qid", "vec_id", "dist"), found)))

    return ranked(b.unionByName(a).groupBy("cell", "bshare", "qshare").applyInArrow(search, SCHEMA), k)


def nearest(spark: SparkSession, queries: DataFrame, base: DataFrame, dim: int, k: int, metric: str, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """All of ``queries(qid, v)`` against all of ``base(vec_id, v)``.

    Queries of at most ``max_bytes`` are broadcast and ``base`` is scanned without a
    shuffle but for the results. More are cut, like the vectors, into shares that meet
    pairwise, so nothing that grows is broadcast.
    """
    metric, base = check_metric(metric), base.select("vec_id", "v")
    few = few_rows(queries, dim, max_bytes)
    if few is not None:
        return scan(spark, few, base, dim, k, metric)
    one = F.lit(0).alias("cell")
    return within_cells(spark, queries.select(one, "qid", "v"), base.select(one, "vec_id", "v"), dim, k, metric)
