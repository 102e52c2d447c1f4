"""Inverted file over product codes of residuals, with exact rescoring on demand."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.arrays import binary, lists, matrix, packed
from nearfield.functions.metrics import rowwise
from nearfield.operators.blocks import SCHEMA, TASK_ROWS, few_rows, nearest, ranked, scan_cells
from nearfield.operators.filters import allow, is_selective
from nearfield.operators.ivf import IVFIndex, nearest_cells, probe
from nearfield.operators.pq import ProductQuantizer, best_codes, codes_of
from nearfield.sources.tables import materialise


class IVFPQIndex:
    """Cells as of ``IVFIndex``; each vector is kept as codes of its offset from the centroid.

    ``rerank`` scores a longer list of candidates exactly if the vectors were kept;
    without them it warns and the code distances stand. A search of few allowed vectors
    is exact with kept vectors and otherwise looks through the codes of all cells.
    """

    def __init__(self, nlist: int = 128, m: int = 8, ksub: int = 256, nprobe: int = 8, init: str = "k-means++", max_iter: int = 25, pq_iter: int = 25, seed: int = 0):
        self.ivf = IVFIndex(nlist, "l2", nprobe, init, max_iter, seed)
        self.pq = ProductQuantizer(m, ksub, pq_iter, init, seed)
        self.codes: DataFrame | None = None
        self.kept = False

    def build(self, spark: SparkSession, corpus: DataFrame, *keep: str, keep_vectors: bool = False) -> IVFPQIndex:
        """Codes, and the vectors if kept, are written by cell, once."""
        self.ivf.build(spark, corpus, *keep)
        self.kept = keep_vectors
        centroids = spark.sparkContext.broadcast(self.ivf.centroids)
        dim = self.ivf.centroids.shape[1]

        def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1), dim, "f8") - centroids.value[batch.column(2).to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(x, pa.float64())], ["vec_id", "embedding"])

        self.pq.fit(spark, self.ivf.cells.select("vec_id", "v", "cell").mapInArrow(offsets, "vec_id long, embedding array<double>"))
        books, bounds, names = spark.sparkContext.broadcast(self.pq.books), self.pq.bounds, self.ivf.cells.columns

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("v"), dim, "f8") - centroids.value[batch.column("cell").to_numpy()]
                codes = codes_of(x, books.value, bounds)
                yield pa.RecordBatch.from_arrays([*batch.columns, binary(codes.astype(np.uint8))], [*names, "codes"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in self.ivf.cells.schema.fields), "codes binary"])
        coded = self.ivf.cells.mapInArrow(code, schema)
        self.codes = materialise(spark, coded if keep_vectors else coded.drop("v"), "codes", "cell")
        return self

    def search(self, spark: SparkSession, queries: DataFrame, k: int = 10, nprobe: int | None = None, rerank: int = 0, allowed: Column | DataFrame | None = None) -> DataFrame:
        """``qid, vec_id, rn, dist`` for ``queries(qid, qvec)``.

        A task keeps the best codes of each query and, if they are to be scored again,
        their exact distances, since the vectors lie beside the codes; so nothing is
        joined to them later. Queries go to the probed cells as in ``IVFIndex``.
        """
        if self.codes is None:
            raise RuntimeError("build before searching")
        dim, nlist = self.ivf.centroids.shape[1], len(self.ivf.centroids)
        asked, base = packed(queries, dim, "qvec", "qid"), allow(self.codes, allowed)
        cells = max(1, min(nprobe or self.ivf.nprobe, nlist))
        if allowed is not None and is_selective(base.count(), self.ivf.n, k):
            if self.kept:
                return nearest(spark, asked, base.select("vec_id", "v"), dim, k, "l2")
            cells = nlist
        if rerank and not self.kept:
            warnings.warn("vectors were not kept: candidates are not scored again", stacklevel=2)
        again = bool(rerank) and self.kept
        fetch = max(k, rerank) if again else k
        base = base.select("cell", "vec_id", "codes", *(["v"] if again else []))
        model, m = spark.sparkContext.broadcast((self.pq, self.ivf.centroids)), self.pq.m

        def score(qids: np.ndarray, q: np.ndarray, cell: int, rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
            pq, centroids = model.value
            ids, codes = rows.column("vec_id").to_numpy(), matrix(rows.column("codes"), m, "u1")
            at, i, d = best_codes(pq.tables(q - centroids[cell]), codes, fetch, ids)
            out = qids[at], ids[i], d
            return (*out, rowwise(q[at], matrix(rows.column("v"), dim, "f8")[i], "l2")) if again else out

        schema = SCHEMA + (", exact double" if again else "")
        few = few_rows(asked, dim)
        if few is not None:
            shared = spark.sparkContext.broadcast(few)
            wanted = nearest_cells(few[1], self.ivf.centroids, cells, "l2")
            probes = np.repeat(np.arange(len(wanted)), wanted.shape[1]), wanted.ravel()
            found = scan_cells(spark, probes, base, lambda asking, cell, rows: score(shared.value[0][asking], shared.value[1][asking], cell, rows), fetch, schema)
        else:
            found = self._shared(spark, probe(spark, asked, self.ivf.centroids, cells, "l2").select("cell", "qid", F.col("v").alias("q")), base, score, schema)
        short = ranked(found, fetch, *(["exact"] if again else []))
        if again:
            return ranked(short.select("qid", "vec_id", F.col("exact").alias("dist")), k)
        return short.withColumn("dist", F.sqrt(F.greatest("dist", F.lit(0.0))))

    def _shared(self, spark: SparkSession, probes: DataFrame, base: DataFrame, score: Callable, schema: str) -> DataFrame:
        """Probed cells and their queries, in shares of large cells and of many queries."""
        wanted = probes.groupBy("cell").agg(F.count("*").alias("m")).collect()  # at most all cells
        counts = self.ivf.counts
        large = spark.createDataFrame([(r["cell"], int(-(-max(counts[r["cell"]], 1) // TASK_ROWS)), -(-r["m"] // TASK_ROWS)) for r in wanted], "cell int, bs int, qs int")
        large, every = F.broadcast(large), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        b = base.where(F.col("cell").isin([r["cell"] for r in wanted])).join(large, "cell").withColumn("a", F.pmod(F.xxhash64("vec_id"), F.col("bs")).cast("int")).withColumn("b", every("qs")).drop("bs", "qs")
        q = probes.join(large, "cell").withColumn("a", every("bs")).withColumn("b", F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int")).drop("bs", "qs")
        dim = self.ivf.centroids.shape[1]
        names = [part.split()[0] for part in schema.split(", ")]

        def look(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({n: np.zeros(0, np.int64 if n in ("qid", "vec_id") else np.float64) for n in names})
            found = score(left.column("qid").to_numpy(), matrix(left.column("q"), dim, "f8"), left.column("cell")[0].as_py(), right)
            return pa.table(dict(zip(names, found)))

        return q.groupBy("cell", "a", "b").cogroup(b.groupBy("cell", "a", "b")).applyInArrow(look, schema)

    def stats(self) -> dict[str, float]:
        dim = self.ivf.centroids.shape[1]
        code = self.ivf.n * self.pq.m
        return {"nlist": len(self.ivf.centroids), "m": self.pq.m, "ksub": self.pq.ksub, "avg_cell_size": self.ivf.n / len(self.ivf.centroids), "code_bytes": code, "compression_ratio": 4 * dim / self.pq.m}

    def memory_bytes(self, whole: bool = False) -> int:
        """Codes, books and centroids; ``whole`` adds ids and kept vectors."""
        size = self.pq.memory_bytes(self.ivf.n) + 4 * self.ivf.centroids.size
        return size + whole * (8 * self.ivf.n + self.kept * 4 * self.ivf.n * self.ivf.centroids.shape[1])
