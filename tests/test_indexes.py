import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators.blocks import nearest, within_cells
from nearfield.functions.arrays import packed
from nearfield.operators.evaluate import compare_kernels, markdown, mean_recall, recall_at_k, results_frame, run_benchmark
from nearfield.operators.exact import as_queries, exact_knn, expression_knn, nearest_to
from nearfield.operators.filters import allow, is_selective
from nearfield.operators.hnsw import HNSWIndex
from nearfield.operators.ivf import IVFIndex, nearest_cells
from nearfield.operators.ivfpq import IVFPQIndex
from nearfield.operators.kmeans import KMeans
from nearfield.operators.pq import ProductQuantizer
from nearfield.sources.corpus import exact_sample, from_matrix, make_clustered, noisy_queries, repeated_queries, to_dataset
from nearfield.sources.persist import load_hnsw, load_ivf, save_hnsw, save_ivf
from tests.conftest import vectors


def rows(df):
    return sorted((r["qid"], r["rn"], r["vec_id"]) for r in df.collect())


def brute(x, ids, q, k):
    d = np.sqrt(((x - q) ** 2).sum(1))
    return ids[np.lexsort((ids, d))[:k]].tolist()


def test_known_answer(spark):
    corpus = vectors(spark, [[0, 0], [1, 0], [5, 5], [0, 2]])
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, qvec array<double>")
    assert [v for *_, v in rows(exact_knn(spark, q, corpus, 3))] == [0, 1, 3]
    assert exact_knn(spark, q, corpus, 99).count() == 4 and exact_knn(spark, q, corpus, 0).count() == 0
    assert exact_knn(spark, q, corpus, 3, allowed=F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        exact_knn(spark, q, corpus, 1, "manhattan")


def test_exact_matches_brute_force(spark, uniform, asked):
    x = np.array([r["embedding"] for r in uniform.orderBy("vec_id").collect()])
    want = [(r["qid"], k + 1, v) for r in asked.collect() for k, v in enumerate(brute(x, np.arange(800), np.array(r["qvec"]), 10))]
    assert rows(exact_knn(spark, asked, uniform, 10)) == sorted(want)
    base, q = packed(uniform, 16, "embedding", "vec_id"), packed(asked, 16, "qvec", "qid")
    assert rows(nearest(spark, q, base, 16, 10, "l2", max_bytes=0)) == sorted(want)
    one = F.lit(0).alias("cell")
    shares = within_cells(spark, q.select(one, "qid", "v"), base.select(one, "vec_id", "v"), 16, 10, "l2", task_rows=100)
    assert rows(shares) == sorted(want)


def test_expressions_agree(spark, uniform, asked):
    assert rows(expression_knn(asked, uniform, 10)) == rows(exact_knn(spark, asked, uniform, 10))
    one = asked.where("qid >= 0").orderBy("qid").first()
    near = [r["vec_id"] for r in nearest_to(list(one["qvec"]), uniform, 5).collect()]
    assert near == [v for q, _, v in rows(exact_knn(spark, asked, uniform, 5)) if q == one["qid"]]
    with pytest.raises(ValueError):
        expression_knn(asked, uniform, 10, max_queries=5)
    assert [r["recall"] for r in compare_kernels(spark, uniform, asked, 5).collect()] == [1.0, 1.0]


def test_expressions_ask_in_blocks(spark, uniform, asked, monkeypatch):
    small = uniform.where("vec_id < 20")
    many = asked.unionByName(spark.range(1000, 11_000).select(F.col("id").alias("qid"), F.array(*(F.lit(float(x)).cast("float") for x in range(16))).alias("qvec")))
    assert expression_knn(many, small, 1).count() == 10_040
    monkeypatch.setattr("nearfield.operators.exact.BLOCK_QUERIES", 15)
    assert rows(expression_knn(asked, uniform, 10)) == rows(exact_knn(spark, asked, uniform, 10))


def test_bad_vectors_are_left_out(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 5), (2, None, 5), (3, [1.0], 5), (4, [float("nan"), 1.0], 5), (5, [0.0, 0.0], 5), (6, [1.0, None], 5)], "vec_id long, embedding array<double>, dist long")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, qvec array<double>")
    assert rows(exact_knn(spark, q, df, 9)) == [(0, 1, 1), (0, 2, 5)]
    assert exact_knn(spark, q, df.limit(0), 3, dim=2).count() == 0


def test_filters(spark, uniform, asked):
    ids = spark.createDataFrame([(0,), (2,), (4,), (4,), (None,)], "vec_id long")
    assert sorted(r[0] for r in allow(uniform, ids).select("vec_id").collect()) == [0, 2, 4]
    assert is_selective(40, 100, 10) and not is_selective(41, 100, 10) and is_selective(200, 10_000, 10)
    with pytest.raises(Exception, match="negative"):
        allow(uniform, spark.createDataFrame([(-1,)], "vec_id long")).collect()
    found = exact_knn(spark, asked, uniform, 10, allowed=F.col("vec_id") % 3 == 0)
    assert {v % 3 for *_, v in rows(found)} == {0} and found.count() == 400


def test_kmeans(spark, blobs):
    model = KMeans(12, n_init=2, seed=1).fit(spark, blobs)
    both = model.predict(spark, blobs).join(blobs, "vec_id").groupBy("cell", "label").count().collect()
    best = {}
    for r in both:
        best[r["cell"]] = max(best.get(r["cell"], 0), r["count"])
    assert sum(best.values()) / 600 > 0.95 and len(best) == 12
    random = KMeans(12, max_iter=1, init="first_k").fit(spark, blobs)
    assert model.inertia <= random.inertia
    with pytest.raises(ValueError):
        KMeans(601).fit(spark, blobs)
    with pytest.raises(RuntimeError):
        KMeans(2).predict(spark, blobs)
    with pytest.raises(ValueError):
        KMeans(2, init="other").fit(spark, blobs)


def test_kmeans_fills_empty_centers(spark):
    corpus = vectors(spark, [[0, 0], [0, 0], [9, 0], [0, 9]])
    model = KMeans(3, init=np.array([[0.0, 0.0], [100, 100], [200, 200]])).fit(spark, corpus)
    assert sorted(map(tuple, model.centers.round(3).tolist())) == [(0, 0), (0, 9), (9, 0)]


def test_ivf(spark, uniform, asked):
    index = IVFIndex(16, seed=1).build(spark, uniform)
    truth = exact_knn(spark, asked, uniform, 10).cache()
    assert rows(index.search(spark, asked, 10, 16)) == rows(truth)
    recalls = [mean_recall(truth, index.search(spark, asked, 10, p)) for p in (1, 4, 12)]
    assert recalls == sorted(recalls) and recalls[-1] > 0.9
    assert index.stats(spark).agg(F.sum("n")).first()[0] == 800
    few = uniform.where("vec_id < 25").select("vec_id")
    assert rows(index.search(spark, asked, 10, 1, few)) == rows(exact_knn(spark, asked, uniform, 10, allowed=few))
    with pytest.raises(RuntimeError):
        IVFIndex().search(spark, asked)


def test_ivf_round_trip(spark, uniform, asked, tmp_path):
    index = IVFIndex(8, seed=2).build(spark, uniform)
    save_ivf(spark, index, str(tmp_path / "ivf"))
    assert rows(load_ivf(spark, str(tmp_path / "ivf")).search(spark, asked, 5, 3)) == rows(index.search(spark, asked, 5, 3))
    with pytest.raises(ValueError):
        load_hnsw(spark, str(tmp_path / "ivf"))
    with pytest.raises(RuntimeError):
        save_ivf(spark, IVFIndex(), str(tmp_path / "none"))


def test_pq(spark, blobs):
    pq = ProductQuantizer(4, 32, seed=1).fit(spark, blobs)
    codes = pq.encode(spark, blobs)
    assert max(max(r["codes"]) for r in codes.collect()) < 32
    x = np.array([r["embedding"] for r in blobs.orderBy("vec_id").collect()])
    y = np.array([r["embedding"] for r in pq.decode(spark, codes).orderBy("vec_id").collect()])
    assert ((x - y) ** 2).mean() < 0.25 * ((x - x.mean(0)) ** 2).mean()
    q = as_queries(blobs.where("vec_id = 7"))
    d = {r["vec_id"]: r["d2"] for r in pq.adc(spark, q, codes, 600).collect()}
    assert np.corrcoef([d[i] for i in range(600)], ((x - x[7]) ** 2).sum(1))[0, 1] > 0.95
    some = as_queries(blobs.where("vec_id < 9"))
    assert rows(pq.adc(spark, some, codes, 5, max_bytes=0)) == rows(pq.adc(spark, some, codes, 5))
    assert pq.memory_bytes(600) == 600 * 4 + sum(4 * b.size for b in pq.books)
    with pytest.raises(ValueError):
        ProductQuantizer(ksub=512)


def test_ivfpq(spark, blobs):
    q = as_queries(blobs.where("vec_id < 40"))
    truth = exact_knn(spark, q, blobs, 10).cache()
    index = IVFPQIndex(12, 4, 16, 4, seed=3).build(spark, blobs, "label", keep_vectors=True)
    plain, again = (mean_recall(truth, index.search(spark, q, 10, 4, r)) for r in (0, 80))
    assert again >= plain and again > 0.85
    assert index.stats()["compression_ratio"] == 8.0 and index.memory_bytes(True) > index.memory_bytes()
    assert rows(index.search(spark, q, 10, 12, 600)) == rows(truth)
    only = index.search(spark, q, 10, 12, 0, F.col("label") == 3)
    assert only.join(blobs, "vec_id").where("label <> 3").count() == 0
    with pytest.raises(RuntimeError):
        IVFPQIndex().search(spark, q)


def test_ivfpq_without_vectors(spark, blobs):
    q = as_queries(blobs.where("vec_id < 5"))
    index = IVFPQIndex(12, 4, 16, 4, seed=3).build(spark, blobs)
    with pytest.warns(UserWarning):
        assert index.search(spark, q, 10, 12, 50).count() == 50
    few = blobs.where("vec_id < 20").select("vec_id")
    assert index.search(spark, q, 10, 1, allowed=few).count() == 50


def test_hnsw(spark, uniform, asked, tmp_path):
    index = HNSWIndex(16, 100, seed=1).build(spark, uniform)
    truth = exact_knn(spark, asked, uniform, 10).cache()
    assert mean_recall(truth, index.search(spark, asked, 10, 100)) > 0.9
    stats = index.stats().first()
    assert stats["n"] == 800 and stats["max_degree"] <= 32 and index.memory_bytes() > 800 * 64
    few = uniform.where("vec_id % 33 = 0").select("vec_id")
    assert rows(index.search(spark, asked, 10, 50, few)) == rows(exact_knn(spark, asked, uniform, 10, allowed=few))
    some = uniform.where("vec_id % 3 = 0").select("vec_id")
    found = index.search(spark, asked, 10, 50, some)
    assert mean_recall(exact_knn(spark, asked, uniform, 10, allowed=some), found) > 0.85 and {v % 3 for *_, v in rows(found)} == {0}
    save_hnsw(spark, index, str(tmp_path / "graph"))
    assert rows(load_hnsw(spark, str(tmp_path / "graph")).search(spark, asked, 5)) == rows(index.search(spark, asked, 5))
    sharded = HNSWIndex(16, 100, seed=1, shard_rows=300).build(spark, uniform)
    assert mean_recall(truth, sharded.search(spark, asked, 10, 100)) > 0.9
    with pytest.raises(RuntimeError):
        HNSWIndex().search(spark, asked)


def test_recall(spark):
    truth = spark.createDataFrame([(0, v) for v in (1, 2, 3, 4)], "qid long, vec_id long")
    found = spark.createDataFrame([(0, v) for v in (1, 2, 9, 9)] + [(1, 5)], "qid long, vec_id long")
    assert {r["qid"]: r["recall"] for r in recall_at_k(truth, found).collect()} == {0: 0.5, 1: 1.0}


def test_benchmark(spark, blobs):
    results = run_benchmark(spark, blobs.select("vec_id", "embedding"), as_queries(blobs.where("vec_id < 20")), 5, 8, (1, 8), (20,), (0, 50), 4, 16)
    assert [r.index for r in results] == ["brute", "ivf", "ivf", "hnsw", "ivfpq", "ivfpq"]
    assert results[0].recall_at_k == results[2].recall_at_k == 1.0
    assert len(markdown(results).splitlines()) == 8 and results_frame(spark, results).count() == 6


def test_datasets(spark):
    data = from_matrix(spark, np.arange(12.0).reshape(4, 3))
    assert data.d == 3 and data.n() == 4 and data.columns == ["f0", "f1", "f2"]
    with pytest.raises(ValueError):
        data.describe(spark.createDataFrame([(0,)], "vec_id long"))
    df = spark.createDataFrame([(i, float(i), None if i == 3 else 1.0, f"t{i}") for i in range(9)], "k long, a double, b double, track_id string")
    part = to_dataset(df, "k", ["a", "b"], limit=5, sample_seed=1)
    assert part.n() == 5 and part.metadata == ["track_id"] and to_dataset(df, "k", ["a", "b"], limit=50).n() == 8
    first = exact_sample(df, 4, "k", 3).select("k").collect()
    assert first == exact_sample(df.repartition(3), 4, "k", 3).select("k").collect() and len(first) == 4
    clouds = make_clustered(spark, 200, 4, 3, 1)
    assert clouds.count() == 200 and noisy_queries(clouds, 7).count() == 7 and repeated_queries(clouds, 30).count() == 30


def rows_scanned(spark, df):
    """Rows that leave the scans of vectors, after running ``df``."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    df.collect()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(s.metrics().apply("numOutputRows").value() for s in scans if "Scan parquet" in s.nodeName())


def test_only_probed_cells_are_read(spark, uniform, tmp_path):
    one = uniform.where("vec_id = 7").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    index = IVFIndex(16).build(spark, uniform)
    save_ivf(spark, index, str(tmp_path / "ivf"))
    coded = IVFPQIndex(16, 4, 16).build(spark, uniform, keep_vectors=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for searched, cells in ((index, index.cells), (load_ivf(spark, str(tmp_path / "ivf")), index.cells), (coded, coded.codes)):
            found = searched.search(spark, one, 5, 2)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
            own = index if searched is not coded else coded.ivf
            wanted = [int(c) for c in nearest_cells(np.array(one.first()["qvec"], float)[None], own.centroids, 2, "l2")[0]]
            assert rows_scanned(spark, found) == cells.where(F.col("cell").isin(wanted)).count() < 800
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_many_queries_meet_cells_in_shares(spark, uniform, asked, monkeypatch):
    from nearfield.operators import blocks, ivfpq

    index = IVFIndex(8).build(spark, uniform)
    coded = IVFPQIndex(8, 4, 16).build(spark, uniform, keep_vectors=True)
    searches = [lambda: index.search(spark, asked, 5, 3), lambda: coded.search(spark, asked, 5, 3), lambda: coded.search(spark, asked, 5, 3, 40)]
    few = [sorted(map(tuple, s().collect())) for s in searches]
    monkeypatch.setattr(blocks, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(ivfpq, "TASK_ROWS", 20)
    for s, want in zip(searches, few):
        got = sorted(map(tuple, s().collect()))
        assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


def test_large_cells_are_written_in_shares(spark, uniform, monkeypatch):
    from nearfield.operators import ivf

    monkeypatch.setattr(ivf, "TASK_ROWS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = IVFIndex(2).build(spark, uniform)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = index.cells.where("cell = 0").inputFiles()
    assert index.cells.count() == 800 and len([f for f in files if "cell=0" in f]) > 1


def test_passes_and_memory_agree(spark, blobs, monkeypatch):
    from nearfield.operators import kmeans, pq

    one = KMeans(6, 10, n_init=2, seed=1).fit(spark, blobs)
    books = ProductQuantizer(2, 8, 5).fit(spark, blobs).books
    monkeypatch.setattr(kmeans, "LOCAL_BYTES", 0)
    monkeypatch.setattr(pq, "LOCAL_BYTES", 0)
    two = KMeans(6, 10, n_init=2, seed=1).fit(spark, blobs)
    assert np.allclose(one.centers, two.centers) and one.inertia == pytest.approx(two.inertia) and (one.counts == two.counts).all()
    assert all(np.allclose(a, b) for a, b in zip(books, ProductQuantizer(2, 8, 5).fit(spark, blobs).books))
    far = np.vstack([blobs.first()["embedding"]] * 2 + [np.full(8, 500.0)] * 2)
    filled = KMeans(4, 3, n_init=1, init=far).fit(spark, blobs)
    assert (filled.counts > 0).sum() >= 3
