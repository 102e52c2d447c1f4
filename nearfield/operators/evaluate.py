"""Recall, latency and size of searches."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.arrays import dimension
from nearfield.functions.metrics import block, rowwise


def recall_at_k(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``qid, recall``: the share of the true ``(qid, vec_id)`` found; every query with no truth has 1."""
    hits = truth.select("qid", "vec_id").distinct().join(found.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left")
    per = hits.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
    return found.select("qid").distinct().join(per, "qid", "full_outer").select("qid", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def mean_recall(truth: DataFrame, found: DataFrame) -> float:
    value = recall_at_k(truth, found).agg(F.avg("recall")).first()[0]
    return 1.0 if value is None else float(value)


@dataclass
class BenchResult:
    """One setting of one index. The names and order of the fields."""

    index: str
    params: dict[str, object]
    n: int
    d: int
    k: int
    build_time_s: float
    mean_latency_ms: float
    p95_latency_ms: float
    qps: float
    recall_at_k: float
    memory_mb: float
    extra: dict[str, object] = field(default_factory=dict)


# The columns of a report, and how their numbers are written.
COLUMNS = [("recall@k", "recall_at_k", ".3f"), ("mean ms", "mean_latency_ms", ".3f"), ("p95 ms", "p95_latency_ms", ".3f"), ("QPS", "qps", ".0f"), ("build s", "build_time_s", ".2f"), ("mem MB", "memory_mb", ".2f")]


def timed(search: Callable[[], DataFrame], repeats: int = 3) -> tuple[DataFrame, list[float]]:
    """The result and the seconds of each run of a batch of queries."""
    seconds = []
    for _ in range(repeats):
        start = time.perf_counter()
        out = search()
        out.write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return out, seconds


@dataclass
class Workload:
    """What searches are measured on: a corpus, queries and the true neighbours."""

    corpus: DataFrame
    queries: DataFrame
    truth: DataFrame
    n: int
    d: int
    n_queries: int
    k: int
    repeats: int = 3


def measure(index: str, params: dict[str, object], work: Workload, build_s: float, size: float, search: Callable[[], DataFrame], extra: dict[str, object] | None = None) -> BenchResult:
    """Latency is a batch's wall time over its queries."""
    out, seconds = timed(search, work.repeats)
    per = np.array(seconds) * 1000 / max(1, work.n_queries)
    return BenchResult(index, params, work.n, work.d, work.k, build_s, float(per.mean()), float(np.percentile(per, 95)), float(1000 / per.mean()), mean_recall(work.truth, out), size / 1e6, extra or {})


def run_benchmark(
    spark: SparkSession,
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 10,
    nlist: int | None = None,
    nprobes: tuple[int, ...] = (1, 4, 8, 16, 32),
    efs: tuple[int, ...] = (10, 20, 50, 100),
    reranks: tuple[int, ...] = (0, 100),
    m: int | None = None,
    ksub: int | None = None,
    with_graph: bool = True,
    repeats: int = 3,
    shard_rows: int | None = None,
) -> list[BenchResult]:
    """Sweeps of all indexes; an index is built once for its sweep.

    Unless stated there are sqrt(n) cells, and product codes of 8 parts from 16
    dimensions on, else a third of the dimensions, with n / 4 entries, 256 at most.
    ``shard_rows`` is that of the graph index.
    """
    from nearfield.operators.exact import exact_knn
    from nearfield.operators.hnsw import HNSWIndex
    from nearfield.operators.ivf import IVFIndex
    from nearfield.operators.ivfpq import IVFPQIndex
    from nearfield.sources.tables import materialise

    n, d = corpus.count(), dimension(corpus, "embedding")
    nlist, m = nlist or max(1, math.isqrt(n)), m or (8 if d >= 16 else max(1, d // 3))
    ksub = ksub or min(256, n // 4 or 1)
    truth = materialise(spark, exact_knn(spark, queries, corpus, k), "truth")
    work = Workload(corpus, queries, truth, n, d, queries.count(), k, repeats)
    out = [measure("brute", {}, work, 0.0, 4 * n * d, lambda: exact_knn(spark, queries, corpus, k))]

    def built(make: Callable[[], object]) -> tuple[object, float]:
        start = time.perf_counter()
        return make(), time.perf_counter() - start

    ivf, seconds = built(lambda: IVFIndex(nlist).build(spark, corpus))
    for nprobe in nprobes:
        out.append(measure("ivf", {"nlist": nlist, "nprobe": nprobe}, work, seconds, ivf.memory_bytes(), lambda p=nprobe: ivf.search(spark, queries, k, p), ivf.shape()))
    if with_graph:
        graph, seconds = built(lambda: HNSWIndex(**({} if shard_rows is None else {"shard_rows": shard_rows})).build(spark, corpus))
        for ef in efs:
            out.append(measure("hnsw", {"M": graph.m, "ef": ef}, work, seconds, graph.memory_bytes(), lambda e=ef: graph.search(spark, queries, k, e), graph.shape()))
    codes, seconds = built(lambda: IVFPQIndex(nlist, m, ksub).build(spark, corpus, keep_vectors=True))
    for rerank in reranks:
        params = {"m": m, "ksub": ksub, "nprobe": 16, "rerank": rerank}
        out.append(measure("ivfpq", params, work, seconds, codes.memory_bytes(), lambda r=rerank: codes.search(spark, queries, k, 16, r), codes.stats()))
    return out


def compare_kernels(spark: SparkSession, corpus: DataFrame, queries: DataFrame, k: int = 10, repeats: int = 3) -> DataFrame:
    """``kernel, seconds, recall, max_diff``: column expressions against products of blocks."""
    from nearfield.operators.exact import exact_knn, expression_knn

    a, a_s = timed(lambda: expression_knn(queries, corpus, k), repeats)
    b, b_s = timed(lambda: exact_knn(spark, queries, corpus, k), repeats)
    both = a.join(b.select("qid", "rn", F.col("dist").alias("other")), ["qid", "rn"])
    diff = both.agg(F.max(F.abs(F.col("dist") - F.col("other")))).first()[0] or 0.0
    rows = [("expression", float(np.median(a_s)), 1.0, 0.0), ("block", float(np.median(b_s)), mean_recall(a, b), float(diff))]
    return spark.createDataFrame(rows, "kernel string, seconds double, recall double, max_diff double")


def micro_benchmark(n: int = 50_000, d: int = 9, repeats: int = 50, seed: int = 0) -> dict[str, float]:
    """Milliseconds of one query against ``n`` vectors on this machine, row by row in numpy and by one product, and their largest difference."""
    rng = np.random.default_rng(seed)
    x, q = rng.random((n, d)), rng.random((1, d))
    kernels = {"rowwise_ms": lambda: rowwise(np.broadcast_to(q, x.shape), x, "l2"), "block_ms": lambda: np.sqrt(block(q, x, "l2")[0])}
    out: dict[str, float] = {}
    for name, kernel in kernels.items():
        start = time.perf_counter()
        for _ in range(repeats):
            kernel()
        out[name] = (time.perf_counter() - start) * 1000 / repeats
    return out | {"max_diff": float(np.abs(kernels["rowwise_ms"]() - kernels["block_ms"]()).max())}


def results_frame(spark: SparkSession, results: list[BenchResult]) -> DataFrame:
    rows = [(r.index, ", ".join(f"{k}={v}" for k, v in r.params.items()), *(getattr(r, f) for f in ("n", "d", "k")), *(float(getattr(r, f)) for _, f, _ in COLUMNS), json.dumps(r.extra)) for r in results]
    numbers = ", ".join(f"{f} double" for _, f, _ in COLUMNS)
    return spark.createDataFrame(rows, f"index string, params string, n long, d int, k int, {numbers}, extra string")


def markdown(results: list[BenchResult]) -> str:
    """A table with a line per result."""
    rows = [["index", "params", *(title for title, _, _ in COLUMNS)], ["---"] * (2 + len(COLUMNS))]
    for r in results:
        params = ", ".join(f"{k}={v}" for k, v in r.params.items()) or "—"
        rows.append([r.index, params, *(format(getattr(r, f), form) for _, f, form in COLUMNS)])
    return "\n".join("| " + " | ".join(row) + " |" for row in rows)


def save_results(spark: SparkSession, results: list[BenchResult], path: str) -> None:
    """One JSON document per result, and the table beside it."""
    results_frame(spark, results).coalesce(1).write.mode("overwrite").json(f"{path}/json")
    spark.createDataFrame([(markdown(results),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def load_results(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.json(pattern)

