"""Queries of the vector indexes, over all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.metrics import distance, similarity
from nearfield.operators.evaluate import BenchResult, compare_kernels, load_results, markdown, recall_at_k, results_frame, run_benchmark, save_results
from nearfield.operators.exact import as_queries, exact_knn, expression_knn
from nearfield.operators.hnsw import HNSWIndex
from nearfield.operators.ivf import IVFIndex, probe
from nearfield.operators.ivfpq import IVFPQIndex
from nearfield.operators.kmeans import KMeans
from nearfield.operators.pq import ProductQuantizer, subspace_bounds
from nearfield.functions.arrays import packed
from nearfield.plans.sql import VECTORS, best, books, knn, lloyd, probes
from nearfield.sources.persist import load_hnsw, load_ivf, save_hnsw, save_ivf
from nearfield.sources.tables import new_path, table
from nearfield.streaming.assign import append_cells

K, NLIST, NPROBE, STEPS = 10, 16, 4, 3
LABELS = [1, 3, 5]
DIM, M, KSUB, PQ_STEPS = 64, 4, 8, 2
RERANK = 50


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("qid", "vec_id", "rn", F.round("dist", 6).alias("dist"))


def _knn(metric: str, k: int = K, allowed=None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _corpus(spark, sf_dir)
        ok = allowed(spark, sf_dir) if allowed else None
        return _shown(exact_knn(spark, as_queries(e), e, k, metric, ok))

    return query


def _by_label(spark: SparkSession, sf_dir: str):
    return F.col("label").isin(LABELS)


def _of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("vec_id"))


def knn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _corpus(spark, sf_dir)
    return exact_knn(spark, as_queries(e), e, K).select("qid", "vec_id", "rn", similarity(F.col("dist"), 3).alias("similarity"))


def label_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances by the column expressions, of each vector to the smallest id of its label."""
    e = _corpus(spark, sf_dir)
    first = F.min_by("embedding", "vec_id").alias("first")
    firsts = e.groupBy("label").agg(first)
    cols = {m: F.round(distance(F.col("embedding"), F.col("first"), m, DIM), 6) for m in ("l2", "sqeuclidean", "cosine")}
    return e.join(firsts, "label").select("vec_id", *(c.alias(m) for m, c in cols.items()))


def _kmeans(spark: SparkSession, sf_dir: str, steps: int = STEPS) -> tuple[KMeans, DataFrame]:
    e = _corpus(spark, sf_dir)
    return KMeans(NLIST, steps, 0.0, 1, "first_k").fit(spark, e), e


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, e = _kmeans(spark, sf_dir)
    return model.predict(spark, e).select("vec_id", "cell")


def kmeans_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _kmeans(spark, sf_dir)
    rows = [(c, j, float(x)) for c, v in enumerate(model.centers) for j, x in enumerate(v)]
    return spark.createDataFrame(rows, "cell int, pos int, value double").withColumn("value", F.round("value", 6))


def kmeans_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, e = _kmeans(spark, sf_dir)
    return model.predict(spark, e).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.sum("d2"), 5).alias("inertia"))


def _ivf(spark: SparkSession, sf_dir: str) -> tuple[IVFIndex, DataFrame]:
    e = _corpus(spark, sf_dir)
    return IVFIndex(NLIST, nprobe=NPROBE, init="first_k", max_iter=STEPS, tol=0.0).build(spark, e, "label"), e


def ivf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf(spark, sf_dir)[0].stats(spark)


def ivf_probe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, e = _ivf(spark, sf_dir)
    asked = packed(as_queries(e), DIM, "qvec", "qid")
    return probe(spark, asked, index.centroids, NPROBE, "l2").select("qid", "rn", "cell")


def _ivf_search(nprobe: int = NPROBE, allowed=None, k: int = K):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        index, e = _ivf(spark, sf_dir)
        return _shown(index.search(spark, as_queries(e), k, nprobe, allowed(spark, sf_dir) if allowed else None))

    return query


def _few(spark: SparkSession, sf_dir: str):
    """The ids of the nations, few enough to be searched exactly."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vec_id"))


def ivf_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, e = _ivf(spark, sf_dir)
    path = new_path(spark, "ivf")
    save_ivf(spark, index, path)
    return _shown(load_ivf(spark, path).search(spark, as_queries(e), K, NPROBE))


def _pq(spark: SparkSession, sf_dir: str) -> tuple[ProductQuantizer, DataFrame]:
    e = _corpus(spark, sf_dir)
    return ProductQuantizer(M, KSUB, PQ_STEPS, "first_k").fit(spark, e), e


def pq_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pq, _ = _pq(spark, sf_dir)
    return pq.codebooks(spark).select("sub", "code", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 6))


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pq, e = _pq(spark, sf_dir)
    return pq.encode(spark, e).select("vec_id", F.posexplode("codes").alias("sub", "code")).withColumn("code", F.col("code").cast("int"))


def pq_decode_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    pq, e = _pq(spark, sf_dir)
    back = pq.decode(spark, pq.encode(spark, e)).withColumnRenamed("embedding", "decoded")
    return e.join(back, "vec_id").select("vec_id", F.round(distance(F.col("embedding"), F.col("decoded"), "sqeuclidean", DIM), 6).alias("error"))


def pq_adc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pq, e = _pq(spark, sf_dir)
    return pq.adc(spark, as_queries(e), pq.encode(spark, e), K).select("qid", "vec_id", "rn", F.round("d2", 6).alias("d2"))


def _ivfpq(rerank: int = 0, nprobe: int = NPROBE, allowed=None, kept: bool = True):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _corpus(spark, sf_dir)
        index = IVFPQIndex(NLIST, M, KSUB, NPROBE, "first_k", STEPS, PQ_STEPS)
        index.ivf.tol = 0.0
        index.build(spark, e, "label", keep_vectors=kept)
        return _shown(index.search(spark, as_queries(e), K, nprobe, rerank, allowed(spark, sf_dir) if allowed else None))

    return query


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, e = _ivf(spark, sf_dir)
    truth = exact_knn(spark, as_queries(e), e, K)
    return recall_at_k(truth, index.search(spark, as_queries(e), K, 1)).withColumn("recall", F.round("recall", 6))


def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear 95th percentile and mean of the events' values by type."""
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    return rows.agg(F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


def _hnsw(spark: SparkSession, sf_dir: str) -> tuple[HNSWIndex, DataFrame]:
    e = _corpus(spark, sf_dir)
    return HNSWIndex(16, 200, 50).build(spark, e), e


def hnsw_full_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, e = _hnsw(spark, sf_dir)
    return _shown(index.search(spark, as_queries(e), K, index.n))


def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, e = _hnsw(spark, sf_dir)
    return _shown(index.search(spark, as_queries(e), K))


def hnsw_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, e = _hnsw(spark, sf_dir)
    return _shown(index.search(spark, as_queries(e), K, allowed=e.where(_by_label(spark, sf_dir)).select("vec_id")))


def hnsw_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, e = _hnsw(spark, sf_dir)
    return _shown(index.search(spark, as_queries(e), K, allowed=_few(spark, sf_dir)))


def hnsw_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hnsw(spark, sf_dir)[0].stats()


def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether searches with the default beam find nine tenths of the true neighbours, with and without a filter."""
    index, e = _hnsw(spark, sf_dir)
    out, by_label = None, e.where(_by_label(spark, sf_dir)).select("vec_id")
    for name, allowed in (("all", None), ("labels", by_label)):
        truth = exact_knn(spark, as_queries(e), e, K, allowed=allowed)
        row = recall_at_k(truth, index.search(spark, as_queries(e), K, allowed=allowed)).agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("reached"))
        row = row.select(F.lit(name).alias("allowed"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def hnsw_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the graph, and whether degrees and levels keep their bounds."""
    index, _ = _hnsw(spark, sf_dir)
    return index.stats().select("n", (F.col("levels") >= 1).alias("has_levels"), (F.col("max_degree") <= 2 * index.m).alias("within_degree"), (F.col("avg_degree") >= 2).alias("linked"))


def kmeans_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in as many k-means++ clusters as there are regions, which lie far apart; a cluster is named by its least nation."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vec_id"), F.array(F.col("n_regionkey") * 100.0, F.col("n_nationkey") * 0.01).cast("array<float>").alias("embedding"))
    cells = KMeans(5, n_init=3, seed=1).fit_predict(spark, nations)
    least = cells.groupBy("cell").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
    return cells.join(least, "cell").select(F.col("vec_id").alias("n_nationkey"), "first", "size")


RESULTS = [
    BenchResult("brute", {}, 20_000, 9, 10, 0.0, 0.5, 0.75, 2000.0, 1.0, 0.72),
    BenchResult("ivf", {"nlist": 141, "nprobe": 4}, 20_000, 9, 10, 0.8125, 0.0625, 0.125, 16000.0, 0.9604, 0.89, {"empty_cells": 0}),
]


def bench_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written and read again, with their lines of the report."""
    path = new_path(spark, "bench")
    save_results(spark, RESULTS, path)
    lines = spark.createDataFrame(list(zip((r.index for r in RESULTS), markdown(RESULTS).splitlines()[2:])), "index string, line string")
    return load_results(spark, f"{path}/json").join(lines, "index").select("index", "params", "n", F.col("d").cast("int").alias("d"), "recall_at_k", "qps", "line")


def hnsw_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, e = _hnsw(spark, sf_dir)
    path = new_path(spark, "hnsw")
    save_hnsw(spark, index, path)
    return _shown(load_hnsw(spark, path).search(spark, as_queries(e), K))


def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _corpus(spark, sf_dir).select("vec_id", "embedding")
    return results_frame(spark, run_benchmark(spark, e, as_queries(e), ksub=64))


def knn_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _corpus(spark, sf_dir)
    return _shown(expression_knn(as_queries(e), e, K))


def kernel_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _corpus(spark, sf_dir)
    return compare_kernels(spark, e, as_queries(e), K)


def stream_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a stream of files, appended to their cells."""
    model, _ = _kmeans(spark, sf_dir)
    stream = spark.readStream.schema("vec_id long, embedding array<float>, label int").option("pathGlobFilter", "embeddings.parquet").parquet(sf_dir)
    path = new_path(spark, "stream")
    append_cells(spark, stream, model, f"{path}/cells", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/cells").select("vec_id", F.col("cell").cast("int").alias("cell"))


QUERIES = {
    "knn_l2": _knn("l2"),
    "knn_sqeuclidean": _knn("sqeuclidean"),
    "knn_cosine": _knn("cosine"),
    "knn_k_capped": _knn("l2", 100_000, lambda s, d: F.col("label") == 0),
    "knn_filter_label": _knn("l2", K, _by_label),
    "knn_filter_ids": _knn("l2", K, _of_users),
    "knn_similarity": knn_similarity,
    "knn_expression": knn_expression,
    "kernel_comparison": kernel_comparison,
    "label_distances": label_distances,
    "kmeans_assign": kmeans_assign,
    "kmeans_lloyd": kmeans_lloyd,
    "kmeans_inertia": kmeans_inertia,
    "ivf_stats": ivf_stats,
    "ivf_probe_cells": ivf_probe_cells,
    "ivf_search": _ivf_search(),
    "ivf_search_filtered": _ivf_search(allowed=_by_label),
    "ivf_selective": _ivf_search(allowed=_few),
    "ivf_full_probe": _ivf_search(NLIST),
    "ivf_saved": ivf_saved,
    "pq_codebooks": pq_codebooks,
    "pq_encode": pq_encode,
    "pq_decode_error": pq_decode_error,
    "pq_adc": pq_adc,
    "ivfpq_search": _ivfpq(),
    "ivfpq_rerank": _ivfpq(RERANK),
    "ivfpq_filtered": _ivfpq(0, NPROBE, _by_label),
    "ivfpq_selective": _ivfpq(0, NPROBE, _few),
    "ivfpq_compressed_selective": _ivfpq(0, NPROBE, _few, False),
    "ivf_recall": ivf_recall,
    "latency_percentile": latency_percentile,
    "hnsw_full_beam": hnsw_full_beam,
    "hnsw_search": hnsw_search,
    "hnsw_filtered": hnsw_filtered,
    "hnsw_selective": hnsw_selective,
    "hnsw_stats": hnsw_stats,
    "hnsw_recall": hnsw_recall,
    "hnsw_shape": hnsw_shape,
    "kmeans_regions": kmeans_regions,
    "bench_saved": bench_saved,
    "hnsw_saved": hnsw_saved,
    "benchmark_report": benchmark_report,
    "stream_assign": stream_assign,
}

_L2 = "list_distance(a.v, b.v)"
_COSINE = "CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 1.0 ELSE 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END"
_LABEL = f"label IN ({', '.join(map(str, LABELS))})"
_FEW = "vec_id IN (SELECT n_nationkey FROM nation)"
_LLOYD = f"WITH {VECTORS},\n{lloyd(NLIST, STEPS)}"
_PROBED = f"{_LLOYD},\n{probes(f'c{STEPS}', NPROBE)}"
_SEEN = f"f AS (SELECT qid, vec_id, list_distance(q, v) AS dist FROM p JOIN a{STEPS} USING (cell) WHERE {{}})\n"
_BOUNDS = subspace_bounds(DIM, M)
_PQ = f"WITH {VECTORS},\n{books('e', _BOUNDS, KSUB, PQ_STEPS)}"
_MINUS = "list_transform(list_zip({0}, {1}), lambda z: z[1] - z[2])"
_CODES = f"""{_LLOYD},
o AS (SELECT vec_id, label, cell, {_MINUS.format('v', 'c')} AS v FROM a{STEPS} JOIN c{STEPS} USING (cell)),
{books('o', _BOUNDS, KSUB, PQ_STEPS)},
{probes(f'c{STEPS}', '{cells}')},
pr AS (SELECT qid, q, cell, {_MINUS.format('q', 'c')} AS r FROM p JOIN c{STEPS} USING (cell)),
f AS (SELECT qid, o.vec_id, q, power(list_distance(r, decoded.v), 2) AS dist FROM pr JOIN o USING (cell) JOIN decoded ON o.vec_id = decoded.vec_id WHERE {{where}})
"""
_ROOT = "round(sqrt(dist), 6) + 0.0 AS dist"
SQL = {
    "knn_l2": f"WITH {VECTORS},\n{knn(_L2, K)}",
    "knn_sqeuclidean": f"WITH {VECTORS},\n{knn(f'power({_L2}, 2)', K)}",
    "knn_cosine": f"WITH {VECTORS},\n{knn(_COSINE, K)}",
    "knn_k_capped": f"WITH {VECTORS}, few AS (SELECT * FROM e WHERE label = 0),\n{knn(_L2, 100_000, 'few')}",
    "knn_filter_label": f"WITH {VECTORS}, few AS (SELECT * FROM e WHERE {_LABEL}),\n{knn(_L2, K, 'few')}",
    "knn_filter_ids": f"WITH {VECTORS}, few AS (SELECT * FROM e WHERE vec_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')),\n{knn(_L2, K, 'few')}",
    "knn_expression": f"WITH {VECTORS},\n{knn(_L2, K)}",
    "knn_similarity": f"WITH {VECTORS},\n{knn(_L2, K, out='round(1 / (1 + dist), 3) AS similarity')}",
    "label_distances": f"""WITH {VECTORS}, b AS (SELECT label, min_by(v, vec_id) AS v FROM e GROUP BY label)
SELECT a.vec_id, round({_L2}, 6) + 0.0 AS l2, round(power({_L2}, 2), 6) + 0.0 AS sqeuclidean, round({_COSINE}, 6) + 0.0 AS cosine FROM e a JOIN b ON a.label = b.label""",
    "kmeans_assign": f"{_LLOYD} SELECT vec_id, cell FROM a{STEPS}",
    "kmeans_lloyd": f"{_LLOYD} SELECT cell, CAST(pos - 1 AS INTEGER) AS pos, round(value, 6) + 0.0 AS value FROM (SELECT cell, unnest(c) AS value, generate_subscripts(c, 1) AS pos FROM c{STEPS})",
    "kmeans_inertia": f"{_LLOYD} SELECT cell, count(*) AS n, round(sum(d * d), 5) AS inertia FROM a{STEPS} GROUP BY cell",
    "ivf_stats": f"{_LLOYD} SELECT c.cell, count(a.vec_id) AS n FROM c{STEPS} c LEFT JOIN a{STEPS} a ON a.cell = c.cell GROUP BY c.cell",
    "ivf_probe_cells": f"{_PROBED} SELECT qid, CAST(rn AS INTEGER) AS rn, cell FROM p",
    "ivf_search": f"{_PROBED},\n{_SEEN.format('true')}{best('f', K)}",
    "ivf_search_filtered": f"{_PROBED},\n{_SEEN.format(_LABEL)}{best('f', K)}",
    "ivf_selective": f"WITH {VECTORS}, few AS (SELECT * FROM e WHERE {_FEW}),\n{knn(_L2, K, 'few')}",
    "ivf_full_probe": f"WITH {VECTORS},\n{knn(_L2, K)}",
    "ivf_saved": f"{_PROBED},\n{_SEEN.format('true')}{best('f', K)}",
    "pq_codebooks": f"{_PQ} SELECT sub, code, CAST(pos - 1 AS INTEGER) AS pos, round(value, 6) + 0.0 AS value FROM (SELECT sub, code, unnest(c) AS value, generate_subscripts(c, 1) AS pos FROM book)",
    "pq_encode": f"{_PQ} SELECT vec_id, sub, code FROM coded",
    "pq_decode_error": f"{_PQ} SELECT e.vec_id, round(power(list_distance(e.v, d.v), 2), 6) + 0.0 AS error FROM e JOIN decoded d ON e.vec_id = d.vec_id",
    "pq_adc": f"{_PQ}, f AS (SELECT a.vec_id AS qid, d.vec_id, power(list_distance(a.v, d.v), 2) AS dist FROM e a CROSS JOIN decoded d)\n{best('f', K, 'round(dist, 6) + 0.0 AS d2')}",
    "ivfpq_search": _CODES.format(cells=NPROBE, where="true") + best("f", K, _ROOT),
    "ivfpq_rerank": _CODES.format(cells=NPROBE, where="true").rstrip()
    + f""",
short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS place FROM f) WHERE place <= {RERANK}),
g AS (SELECT qid, e.vec_id, list_distance(q, e.v) AS dist FROM short JOIN e ON e.vec_id = short.vec_id)
{best('g', K)}""",
    "ivfpq_filtered": _CODES.format(cells=NPROBE, where=_LABEL) + best("f", K, _ROOT),
    "ivfpq_selective": f"WITH {VECTORS}, few AS (SELECT * FROM e WHERE {_FEW}),\n{knn(_L2, K, 'few')}",
    "ivfpq_compressed_selective": _CODES.format(cells=NLIST, where="o." + _FEW) + best("f", K, _ROOT),
    "ivf_recall": f"""{_LLOYD}, {probes(f'c{STEPS}', 1)},
f AS (SELECT qid, vec_id, list_distance(q, v) AS dist FROM p JOIN a{STEPS} USING (cell)),
found AS ({best('f', K)}),
x AS (SELECT a.vec_id AS qid, b.vec_id, {_L2} AS dist FROM e a CROSS JOIN e b),
truth AS ({best('x', K)})
SELECT t.qid, round(count(f.vec_id) / CAST(count(*) AS DOUBLE), 6) AS recall FROM truth t LEFT JOIN found f ON f.qid = t.qid AND f.vec_id = t.vec_id GROUP BY t.qid""",
    "latency_percentile": "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "hnsw_full_beam": f"WITH {VECTORS},\n{knn(_L2, K)}",
    "hnsw_recall": f"SELECT 'all' AS allowed, count(*) AS n_queries, true AS reached FROM embeddings UNION ALL SELECT 'labels', count(*), true FROM embeddings",
    "hnsw_shape": "SELECT count(*) AS n, true AS has_levels, true AS within_degree, true AS linked FROM embeddings",
    "kmeans_regions": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(min(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS first, count(*) OVER (PARTITION BY n_regionkey) AS size FROM nation",
    "bench_saved": """SELECT * FROM (VALUES
  ('brute', '', CAST(20000 AS BIGINT), CAST(9 AS INTEGER), CAST(1.0 AS DOUBLE), CAST(2000.0 AS DOUBLE), '| brute | — | 1.000 | 0.500 | 0.750 | 2000 | 0.00 | 0.72 |'),
  ('ivf', 'nlist=141, nprobe=4', 20000, 9, 0.9604, 16000.0, '| ivf | nlist=141, nprobe=4 | 0.960 | 0.062 | 0.125 | 16000 | 0.81 | 0.89 |')) AS t(index, params, n, d, recall_at_k, qps, line)""",
    "hnsw_selective": f"WITH {VECTORS}, few AS (SELECT * FROM e WHERE {_FEW}),\n{knn(_L2, K, 'few')}",
    "stream_assign": f"{_LLOYD} SELECT vec_id, cell FROM a{STEPS}",
}
