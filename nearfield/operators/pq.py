"""Product quantization: a code per subspace, distances from small tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.arrays import dense, dimension, lists, usable
from nearfield.functions.metrics import block_sq
from nearfield.operators.blocks import CELLS, MAX_BROADCAST_BYTES, SCHEMA, TASK_ROWS, ranked
from nearfield.operators.kmeans import LOCAL_BYTES, SEED_ROWS, add_up, nearest_center, plus_plus


def subspace_bounds(dim: int, m: int) -> list[tuple[int, int]]:
    """``m`` stretches of the dimensions, the first ones one longer where it doesn't divide."""
    if not 0 < m <= dim:
        raise ValueError("m must lie between 1 and the dimension")
    cuts = np.cumsum([0] + [dim // m + (s < dim % m) for s in range(m)]).tolist()
    return list(zip(cuts, cuts[1:]))


class ProductQuantizer:
    """``m`` codebooks of at most ``ksub`` entries, all fitted together, one pass an iteration (over vectors in memory, if they are few).

    Seeds come from distinct subvectors of a bounded sample; ``init='first_k'`` takes
    those of the smallest ids. A codebook is no larger than its distinct subvectors.
    """

    def __init__(self, m: int = 8, ksub: int = 256, max_iter: int = 25, init: str = "k-means++", seed: int = 0):
        if ksub > 256:
            raise ValueError("ksub must be at most 256")
        self.m, self.ksub, self.max_iter, self.init, self.seed = m, ksub, max_iter, init, seed
        self.books: list[np.ndarray] | None = None
        self.bounds: list[tuple[int, int]] = []
        self.dim = 0

    def fit(self, spark: SparkSession, df: DataFrame) -> ProductQuantizer:
        """``df(vec_id, embedding)``; NaN and other lengths are left out."""
        self.dim = dimension(df, "embedding")
        self.bounds = subspace_bounds(self.dim, self.m)
        rows = df.select("vec_id", "embedding").where(usable(F.col("embedding"), self.dim))
        order = F.col("vec_id") if self.init == "first_k" else F.xxhash64("vec_id", F.lit(self.seed))
        x = np.array([r[0] for r in rows.orderBy(order).limit(SEED_ROWS).select("embedding").collect()], np.float64).reshape(-1, self.dim)  # bounded
        self.books = []
        for s, (lo, hi) in enumerate(self.bounds):
            _, first = np.unique(x[:, lo:hi], axis=0, return_index=True)
            distinct = x[np.sort(first), lo:hi]
            k = min(self.ksub, len(distinct))
            self.books.append(distinct[:k] if self.init == "first_k" else plus_plus(distinct, k, np.random.default_rng([self.seed, s])))
        held = None
        if 8 * self.dim * rows.count() <= LOCAL_BYTES:
            held = np.concatenate([np.zeros((0, self.dim)), *(dense(c, self.dim) for c in rows.select("embedding").toArrow().column(0).chunks)])  # bounded
        for _ in range(self.max_iter):
            new = self._step(spark, rows) if held is None else self._averages(held)
            moved = max(np.abs(a - b).max() for a, b in zip(new, self.books))
            self.books = new
            if moved < 1e-9:
                break
        return self

    def _averages(self, x: np.ndarray) -> list[np.ndarray]:
        books = [b.copy() for b in self.books]
        for s, (lo, hi) in enumerate(self.bounds):
            sums = add_up(x[:, lo:hi], self.books[s])
            some = sums[:, -2] > 0
            books[s][some] = sums[some, :-2] / sums[some, -2:-1]
        return books

    def _step(self, spark: SparkSession, rows: DataFrame) -> list[np.ndarray]:
        shared, bounds, dim = spark.sparkContext.broadcast(self.books), self.bounds, self.dim
        widest = max(hi - lo for lo, hi in bounds)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(b), widest + 1)) for b in shared.value]
            for batch in batches:
                x = dense(batch.column(0), dim)
                for s, (lo, hi) in enumerate(bounds):
                    code = closest(x[:, lo:hi], shared.value[s])
                    np.add.at(total[s][:, : hi - lo], code, x[:, lo:hi])
                    total[s][:, -1] += np.bincount(code, minlength=len(total[s]))
            for s, t in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), s, np.int32)), pa.array(np.arange(len(t), dtype=np.int32)), *(pa.array(t[:, j]) for j in range(widest + 1))], ["sub", "code", *(f"x{j}" for j in range(widest + 1))])

        schema = ", ".join(["sub int", "code int", *(f"x{j} double" for j in range(widest + 1))])
        sums = rows.select("embedding").mapInArrow(add, schema).groupBy("sub", "code").agg(*(F.sum(f"x{j}") for j in range(widest + 1))).collect()  # m x ksub rows
        books = [b.copy() for b in self.books]
        for r in sums:
            width = books[r[0]].shape[1]
            if r[-1] > 0:
                books[r[0]][r[1]] = np.array(r[2 : 2 + width]) / r[-1]
        return books

    def codebooks(self, spark: SparkSession) -> DataFrame:
        """``sub, code, centroid``."""
        return spark.createDataFrame([(s, c, v.tolist()) for s, b in enumerate(self.books) for c, v in enumerate(b)], "sub int, code int, centroid array<double>")

    def encode(self, spark: SparkSession, df: DataFrame) -> DataFrame:
        """``vec_id, codes``; codes go to 255, so they are short, not byte."""
        shared, bounds, dim = spark.sparkContext.broadcast(self.books), self.bounds, self.dim

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = codes_of(dense(batch.column(1), dim), shared.value, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(codes.astype(np.int16), pa.int16())], ["vec_id", "codes"])

        rows = df.where(usable(F.col("embedding"), dim)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        return rows.mapInArrow(code, "vec_id long, codes array<smallint>")

    def decode(self, spark: SparkSession, codes: DataFrame) -> DataFrame:
        """``vec_id, embedding``, the centroids of the codes in a row."""
        shared, m = spark.sparkContext.broadcast(self.books), self.m

        def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m).astype(np.int64)
                x = np.hstack([b[c[:, s]] for s, b in enumerate(shared.value)])
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(x, pa.float64())], ["vec_id", "embedding"])

        return codes.select("vec_id", "codes").mapInArrow(back, "vec_id long, embedding array<double>")

    def adc(self, spark: SparkSession, queries: DataFrame, codes: DataFrame, k: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
        """``qid, vec_id, rn, d2``: nearest codes by table look-up.

        Tables of at most ``max_bytes`` are broadcast and the codes scanned; for more
        queries, shares of queries and codes meet pairwise.
        """
        asked = queries.where(usable(F.col("qvec"), self.dim)).select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec"))
        limit = max_bytes // (8 * self.m * self.ksub)
        few = asked.limit(limit + 1).collect()
        if len(few) > limit:
            return self._adc_shares(spark, asked, codes, k)
        tables = self.tables(np.array([r["qvec"] for r in few], np.float64).reshape(-1, self.dim))
        shared, m = spark.sparkContext.broadcast((np.array([r["qid"] for r in few], np.int64), tables)), self.m

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, tables = shared.value
            for batch in batches:
                ids = batch.column(0).to_numpy()
                c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m).astype(np.int64)
                q, i, d = best_codes(tables, c, k, ids)
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[i]), pa.array(d)], ["qid", "vec_id", "dist"])

        return ranked(codes.select("vec_id", "codes").mapInArrow(look, SCHEMA), k).withColumnRenamed("dist", "d2")

    def _adc_shares(self, spark: SparkSession, asked: DataFrame, codes: DataFrame, k: int) -> DataFrame:
        qs, bs = (max(1, -(-df.count() // TASK_ROWS)) for df in (asked, codes))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.select("qid", "qvec", F.pmod(F.xxhash64("qid"), F.lit(qs)).cast("int").alias("a"), every(bs).alias("b"))
        right = codes.select("vec_id", "codes", every(qs).alias("a"), F.pmod(F.xxhash64("vec_id"), F.lit(bs)).cast("int").alias("b"))
        model = spark.sparkContext.broadcast(self)

        def look(q: pa.Table, c: pa.Table) -> pa.Table:
            if not q.num_rows or not c.num_rows:
                return pa.table({"qid": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "dist": np.zeros(0)})
            pq, ids = model.value, c.column("vec_id").to_numpy()
            known = c.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, pq.m).astype(np.int64)
            at, i, d = best_codes(pq.tables(np.array(q.column("qvec").to_pylist(), np.float64)), known, k, ids)
            return pa.table({"qid": q.column("qid").to_numpy()[at], "vec_id": ids[i], "dist": d})

        found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(look, SCHEMA)
        return ranked(found, k).withColumnRenamed("dist", "d2")

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of the queries' parts to all entries; what a shorter book lacks is infinite."""
        out = np.full((len(q), self.m, self.ksub), np.inf)
        for s, (lo, hi) in enumerate(self.bounds):
            out[:, s, : len(self.books[s])] = block_sq(q[:, lo:hi], self.books[s])
        return out

    def memory_bytes(self, n: int) -> int:
        """Codes, a byte each, and books in single precision."""
        return n * self.m + sum(4 * b.size for b in self.books)


def closest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return nearest_center(x, book)[0]


def codes_of(x: np.ndarray, books: list[np.ndarray], bounds: list[tuple[int, int]]) -> np.ndarray:
    return np.column_stack([closest(x[:, lo:hi], b) for b, (lo, hi) in zip(books, bounds)])


def best_codes(tables: np.ndarray, codes: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and codes and table distances: of every query the ``k`` nearest codes, ties to the smaller id."""
    out, step = [], max(1, CELLS // max(1, len(codes)))
    for at in range(0, len(tables) if len(codes) and k > 0 else 0, step):
        some = tables[at : at + step]
        d = some[:, 0, codes[:, 0]]
        for s in range(1, codes.shape[1]):
            d += some[:, s, codes[:, s]]
        if k < len(codes):
            i, j = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 1e-12)
        else:
            i, j = np.divmod(np.arange(d.size), len(codes))
        near = d[i, j]
        order = np.lexsort((ids[j], near, i))
        i, j, near = i[order], j[order], near[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((at + i[keep], j[keep], near[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))
