"""A layered proximity graph per shard, after Malkov and Yashunin."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.arrays import binary, dense, dimension, matrix, packed, usable
from nearfield.functions.metrics import block, check_metric, rowwise
from nearfield.operators.blocks import SCHEMA, nearest, ranked
from nearfield.operators.filters import allow, is_selective
from nearfield.operators.ivf import probe
from nearfield.operators.kmeans import KMeans, nearest_center
from nearfield.sources.tables import materialise

#: Vectors a shard's graph is built of in one task: as many as give every core a shard, within these.
LEAST_SHARD_ROWS, SHARD_ROWS = 500, 10_000
#: How many cells of shards a query asks.
SHARD_PROBES = 8
SHARD_ITERATIONS = 10
#: Queries that walk a shard's graph in one task, and tasks a shard has at most.
CHUNK_QUERIES, MAX_CHUNKS = 500, 64


class Graph:
    """The graph of one shard, on places 0..n-1 of its matrix."""

    def __init__(self, x: np.ndarray, metric: str, links: list[dict[int, list[int]]] | None = None, entry: int = -1):
        self.x, self.metric = x, metric
        self.layers: list[dict[int, list[int]]] = links or []
        self.entry = entry

    def away(self, q: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Ranking distances of ``places`` from ``q``: squared for l2."""
        if self.metric == "cosine":
            return rowwise(np.broadcast_to(q, (len(places), len(q))), self.x[places], "cosine")
        d = self.x[places] - q
        return np.einsum("ij,ij->i", d, d)

    def beam(self, q: np.ndarray, start: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest found by best-first walks from ``start``, ascending."""
        links, seen = self.layers[layer], {p for _, p in start}
        frontier = list(start)
        heapq.heapify(frontier)
        kept = [(-d, -p) for d, p in start]
        heapq.heapify(kept)
        while frontier:
            d, p = heapq.heappop(frontier)
            if len(kept) >= width and d > -kept[0][0]:
                break
            new = [t for t in links.get(p, ()) if t not in seen]
            if not new:
                continue
            seen.update(new)
            for e, t in zip(self.away(q, np.array(new)).tolist(), new):
                if len(kept) < width or e < -kept[0][0]:
                    heapq.heappush(frontier, (e, t))
                    heapq.heappush(kept, (-e, -t))
                    if len(kept) > width:
                        heapq.heappop(kept)
        return sorted((-d, -p) for d, p in kept)

    def spread(self, near: list[tuple[float, int]], count: int) -> list[int]:
        """Up to ``count`` neighbours in different directions: each nearer to the node than to those taken; the rest filled with the nearest."""
        if len(near) <= 1:
            return [p for _, p in near[:count]]
        d, p = np.array([d for d, _ in near]), np.array([p for _, p in near])
        between = block(self.x[p], self.x[p], self.metric)
        free, taken = np.ones(len(p), bool), []
        while len(taken) < count:
            first = int(free.argmax())
            if not free[first]:
                break
            taken.append(first)
            free &= between[first] >= d
            free[first] = False
        if len(taken) < count:
            rest = np.ones(len(p), bool)
            rest[taken] = False
            taken += np.flatnonzero(rest)[: count - len(taken)].tolist()
        return p[taken].tolist()

    def build(self, m: int, width: int, levels: np.ndarray, order: np.ndarray) -> Graph:
        for p in order.tolist():
            top = int(levels[p])
            if self.entry < 0:
                self.layers = [{p: []} for _ in range(top + 1)]
                self.entry = p
                continue
            q, highest = self.x[p], len(self.layers) - 1
            at = [(float(self.away(q, np.array([self.entry]))[0]), self.entry)]
            for layer in range(highest, top, -1):
                at = self.beam(q, at, 1, layer)
            for layer in range(min(top, highest), -1, -1):
                at = self.beam(q, at, width, layer)
                most, links = (2 * m if layer == 0 else m), self.layers[layer]
                chosen = self.spread(at, m)
                links[p] = chosen
                for t in chosen:
                    both = [*links[t], p]
                    if len(both) > most:
                        d = self.away(self.x[t], np.array(both))
                        both = self.spread(sorted(zip(d.tolist(), both)), most)
                    links[t] = both
            for _ in range(top - highest):
                self.layers.append({p: []})
                self.entry = p
        return self

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        at = [(float(self.away(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self.beam(q, at, 1, layer)
        return self.beam(q, at, width, 0)


class Packed:
    """Links of a layer as one array, a node's from ``bounds[p]`` to ``bounds[p + 1]``."""

    def __init__(self, lengths: np.ndarray, links: np.ndarray):
        self.bounds, self.links = np.concatenate([[0], np.cumsum(lengths)]).tolist(), links

    def get(self, p: int, _=()) -> list[int]:
        return self.links[self.bounds[p] : self.bounds[p + 1]].tolist()


class HNSWIndex:
    """A graph per shard of at most ``shard_rows`` vectors; the shards near a query answer, the best of all are kept.

    Inserting is sequential, so shards are what runs in parallel; one shard is the plain
    algorithm. More are cells of a k-means, a cell with too many vectors being cut by
    the id's hash, so a query asks the ``shard_probes`` cells with the nearest middles
    (all, if a beam is as wide as the whole index). With ``allowed``, few allowed vectors are
    searched exactly, otherwise the beam widens with their scarcity and drops the rest,
    so fewer than k may come out. Pruning may cut the last link to a vector, which then
    is not found.
    """

    def __init__(self, m: int = 16, ef_construction: int = 200, ef_search: int = 50, metric: str = "l2", seed: int = 0, shard_rows: int | None = None, shard_probes: int = SHARD_PROBES):
        self.m, self.ef_construction, self.ef_search = m, ef_construction, ef_search
        self.metric, self.seed, self.shard_rows, self.shard_probes = check_metric(metric), seed, shard_rows, shard_probes
        self.scale = 1 / math.log(m) if m > 1 else 1.0
        self.nodes: DataFrame | None = None
        self.centers: np.ndarray | None = None
        self.dim = self.n = 0

    def build(self, spark: SparkSession, corpus: DataFrame) -> HNSWIndex:
        """The graph as ``cell, shard, vec_id, v, level, entry, base, upper``, written to the shared folder by cell.

        ``base`` holds a node's links in the lowest layer, ``upper`` those above, as
        places among the shard's ids in their order.
        """
        self.dim = dimension(corpus, "embedding")
        rows = corpus.where(usable(F.col("embedding"), self.dim)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").dropDuplicates(["vec_id"])
        self.n = rows.count()
        most = self.shard_rows or max(LEAST_SHARD_ROWS, min(SHARD_ROWS, -(-self.n // spark.sparkContext.defaultParallelism)))
        cells = max(1, -(-self.n // most))
        if cells > 1:
            rows = materialise(spark, rows, "vectors")
            model = KMeans(cells, SHARD_ITERATIONS, 1e-4, 1, "k-means++", self.seed).fit(spark, rows, self.dim)
            self.centers, counts = model.centers, model.counts
        else:
            self.centers, counts = np.zeros((1, self.dim)), np.array([self.n])
        cut = spark.sparkContext.broadcast((self.centers, np.maximum(-(-counts // most), 1)))
        dim, m, width, metric, seed, scale = self.dim, self.m, self.ef_construction, self.metric, self.seed, self.scale

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers, shares = cut.value
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), dense(batch.column(1), dim)
                cell = nearest_center(x, centers)[0]
                spread = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array((spread.astype(np.int64) % shares[cell]).astype(np.int32)), batch.column(0), binary(x)], ["cell", "shard", "vec_id", "v"])

        def make(table: pa.Table) -> pa.Table:
            table = table.sort_by("vec_id")
            ids, x = table.column("vec_id").to_numpy(), matrix(table.column("v"), dim, "f8")
            rng = np.random.default_rng([seed, int(table.column("cell")[0].as_py()), int(table.column("shard")[0].as_py())])
            levels = np.floor(-np.log(np.maximum(rng.random(len(ids)), 1e-12)) * scale).astype(np.int64)
            g = Graph(x, metric).build(m, width, levels, rng.permutation(len(ids)))
            links = [[np.array(layer[p], np.int32).tobytes() for layer in g.layers[: levels[p] + 1]] for p in range(len(ids))]
            return pa.table(
                {
                    "cell": table.column("cell"), "shard": table.column("shard"), "vec_id": table.column("vec_id"), "v": binary(x), "level": pa.array(levels.astype(np.int32)),
                    "entry": pa.array(np.arange(len(ids)) == g.entry), "base": pa.array([t[0] for t in links], pa.binary()), "upper": pa.array([t[1:] for t in links], pa.list_(pa.binary())),
                }
            )

        placed = rows.mapInArrow(place, "cell int, shard int, vec_id long, v binary")
        built = placed.groupBy("cell", "shard").applyInArrow(make, "cell int, shard int, vec_id long, v binary, level int, entry boolean, base binary, upper array<binary>")
        self.nodes = materialise(spark, built, "graph", "cell")
        return self

    def built(self) -> None:
        if self.nodes is None:
            raise RuntimeError("build before searching or saving")

    def search(self, spark: SparkSession, queries: DataFrame, k: int = 10, ef: int | None = None, allowed: Column | DataFrame | None = None) -> DataFrame:
        """``qid, vec_id, rn, dist`` for ``queries(qid, qvec)``. A condition in ``allowed`` may use ``vec_id``."""
        self.built()
        asked = packed(queries, self.dim, "qvec", "qid").select(F.col("qid").cast("long").alias("qid"), "v")
        width, nodes = max(ef or self.ef_search, k), self.nodes.withColumn("ok", F.lit(True))
        if allowed is not None:
            base = allow(self.nodes.select("vec_id", "v"), allowed)
            n_allowed = base.count()
            if is_selective(n_allowed, self.n, k):
                return nearest(spark, asked, base, self.dim, k, self.metric)
            width = min(int(max(width, k / max(n_allowed / self.n, 1e-9))), self.n)
            nodes = self.nodes.join(base.select("vec_id", F.lit(True).alias("ok")), "vec_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        probes = len(self.centers) if width >= self.n else max(1, min(self.shard_probes, len(self.centers)))
        asked = materialise(spark, probe(spark, asked, self.centers, probes, self.metric).select("cell", "qid", "v"), "asked")
        cells = asked.groupBy("cell").count().collect()  # at most all cells
        chunks = min(MAX_CHUNKS, max(1, -(-max((r["count"] for r in cells), default=0) // CHUNK_QUERIES)))
        left = asked.withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int"))
        shards = self.nodes.select((F.col("cell") + 0).alias("cell"), (F.col("shard") + 0).alias("shard")).distinct()
        left = left.join(F.broadcast(shards), "cell")  # n / shard_rows
        right = nodes.where(F.col("cell").isin([r["cell"] for r in cells])).withColumn("chunk", F.explode(F.array(*map(F.lit, range(chunks)))))
        dim, metric = self.dim, self.metric

        def walk(q: pa.Table, n: pa.Table) -> pa.Table:
            if not q.num_rows or not n.num_rows:
                return pa.table({"qid": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "dist": np.zeros(0)})
            n = n.sort_by("vec_id")
            ids, x, ok = n.column("vec_id").to_numpy(), matrix(n.column("v"), dim, "f8"), n.column("ok").to_numpy()
            base = n.column("base").to_pylist()
            layers: list = [Packed(np.array([len(t) // 4 for t in base]), np.frombuffer(b"".join(base), np.int32))]
            for p in np.flatnonzero(n.column("level").to_numpy()).tolist():
                for layer, links in enumerate(n.column("upper")[p].as_py(), 1):
                    while len(layers) <= layer:
                        layers.append({})
                    layers[layer][p] = np.frombuffer(links, np.int32).tolist()
            g = Graph(x, metric, layers, int(n.column("entry").to_numpy().argmax()))
            out = []
            for qid, vector in zip(q.column("qid").to_pylist(), matrix(q.column("v"), dim, "f8")):
                found = np.array([p for _, p in g.search(vector, width) if ok[p]], np.int64)
                d = rowwise(np.broadcast_to(vector, (len(found), dim)), x[found], metric)
                order = np.lexsort((ids[found], d))[:k]
                out.append((np.full(len(order), qid), ids[found[order]], d[order]))
            return pa.table(dict(zip(("qid", "vec_id", "dist"), map(np.concatenate, zip(*out)))))

        by = ["cell", "shard", "chunk"]
        return ranked(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(walk, SCHEMA), k)

    def stats(self) -> DataFrame:
        """One row: ``n, levels, avg_degree, max_degree`` (of the lowest layer)."""
        self.built()
        degree = (F.length("base") / 4).cast("int")
        return self.nodes.agg(F.count("*").alias("n"), (F.max("level") + 1).alias("levels"), F.avg(degree).alias("avg_degree"), F.max(degree).alias("max_degree"))

    def shape(self) -> dict[str, float]:
        return self.stats().first().asDict()

    def memory_bytes(self) -> int:
        """Vectors in single precision, 8 bytes a link and 56 a node of every layer."""
        links = F.length("base") + F.aggregate("upper", F.lit(0), lambda s, x: s + F.length(x))
        total = self.nodes.agg(F.sum(links / 4).alias("links"), F.sum(F.col("level") + 1).alias("nodes")).first()
        return int(4 * self.n * self.dim + 8 * (total["links"] or 0) + 56 * (total["nodes"] or 0))
