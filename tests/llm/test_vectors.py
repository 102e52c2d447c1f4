"""Similar vectors and clusters."""

import numpy as np
from pyspark.sql import functions as F

from nearfield.llm import similar, spectral
from nearfield.llm.collapse import members, vector_groups
from nearfield.llm.routing import LearnedPartitions
from nearfield.llm.similar import exact_neighbours, neighbours, similar_records
from nearfield.llm.spectral import ROUNDS, missed_groups, place_landmarks, spectral_clusters
from tests.conftest import vectors


def want(ids, x, k, most=None):
    out = set()
    for i, v in zip(ids, x):
        d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 6)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out |= {(int(i), r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order) if most is None or d[j] <= most}
    return out


def got(df):
    return {(r["id"], r["rank"], r["neighbour"], r["d"]) for r in df.collect()}


def test_copies_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (300, 3)).astype(float)
    x[:100] = 1.0  # a third are one vector
    df = vectors(spark, x, rank=[0] * 300, v=[0] * 300).repartition(5)
    for k in (1, 5):
        assert got(similar_records(spark, df, "vec_id", F.col("embedding"), 3, "f4", k)) == want(np.arange(300), x, k)
        assert got(similar_records(spark, df, "vec_id", F.col("embedding"), 3, "f4", k, most=1.0)) == want(np.arange(300), x, k, 1.0)


def test_shares_of_large_partitions(spark, monkeypatch):
    monkeypatch.setattr(similar, "TASK_ROWS", 30)
    monkeypatch.setattr(similar, "QUERY_SHARE", 2)
    monkeypatch.setattr(similar, "PART_ROWS", 60)  # one block of eight partitions, in shares of vectors and of queries
    monkeypatch.setattr(similar, "LEAST_PROBES", 8)
    monkeypatch.setattr(similar, "LEAST_BLOCK_LEVELS", 0)
    x = np.random.default_rng(1).normal(size=(400, 4)).astype("f4").astype(float)
    assert got(similar_records(spark, vectors(spark, x), "vec_id", F.col("embedding"), 4, "f4", 3)) == want(np.arange(400), x, 3)


def test_unusable_vectors(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [nan, 0.0]), (5, [0.0, None]), (6, [-0.0, 0.0]), (None, [0.0, 0.0]), (7, [3.0, 4.0]), (7, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, x array<float>")
    out = got(similar_records(spark, df, "id", F.col("x"), 2, "f4", 5))
    assert out == {(1, 1, 6, 0.0), (1, 2, 7, 5.0), (6, 1, 1, 0.0), (6, 2, 7, 5.0), (7, 1, 1, 5.0), (7, 2, 6, 5.0)}
    assert similar_records(spark, df.limit(0), "id", F.col("x"), 2, "f4", 5).count() == 0
    rows, groups = vector_groups(spark, df, "id", F.col("x"), 2, "f4", 3)
    assert sorted(map(tuple, members(rows, groups.select("gid", "reps")).select("id", "gid").collect())) == [(1, 1), (6, 1), (7, 7)]


def test_recall_of_learned_partitions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 3, (20, 8))[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8))
    _, groups = vector_groups(spark, vectors(spark, x), "vec_id", F.col("embedding"), 8, "f4", 1)
    monkeypatch.setattr(similar, "PART_ROWS", 200)
    router = similar.fit_router(groups, 4000, 8, "f4", part_rows=200)
    assert router.depth == 5
    asked = F.col("gid") % 50 == 0
    truth = {(r["a"], r["b"]) for r in exact_neighbours(spark, groups, 8, "f4", 10, asked).collect()}
    found = {(r["a"], r["b"]) for r in neighbours(spark, groups, 8, "f4", 10, 6, queries=asked).collect()}
    assert len(truth) == 800 and len(truth & found) / 800 >= 0.9


def test_neighbours_at_any_distance_by_default(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 3, (20, 8))[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8))).astype("f4").astype(float)
    fit = similar.fit_router
    monkeypatch.setattr(similar, "fit_router", lambda *a: fit(*a, part_rows=100))  # 64 partitions
    found = got(similar_records(spark, vectors(spark, x), "vec_id", F.col("embedding"), 8, "f4", 10))
    truth = want(np.arange(4000), x, 10)
    assert len(found) == 40_000 and len({(a, b) for a, _, b, _ in found} & {(a, b) for a, _, b, _ in truth}) / 40_000 >= 0.98
    assert "p3_nearest" in similar.QUERIES


def test_recall_asks_with_every_stated_id(spark):
    x = np.random.default_rng(6).normal(size=(300, 3)).astype("f4").astype(float)
    x[100] = x[99] = x[7]  # 100 is not the first of its copies
    out = {r["within"]: r for r in similar.recall(spark, vectors(spark, x).repartition(3), "vec_id", F.col("embedding"), 3, "f4", 0.0, 50).collect()}
    assert out[None]["n_queries"] == 6 and out[None]["recall"] == 1.0
    assert out[0.0]["n_queries"] == 1 and out[0.0]["recall"] == 1.0  # the copies of 100


def test_second_level_of_the_router(spark, monkeypatch):
    monkeypatch.setattr(similar, "LEVELS", 3)
    rng = np.random.default_rng(12)
    x = (rng.normal(0, 3, (20, 8))[rng.integers(0, 20, 6000)] + rng.normal(size=(6000, 8))).astype("f4").astype(float)
    _, groups = vector_groups(spark, vectors(spark, x), "vec_id", F.col("embedding"), 8, "f4", 1)
    router = similar.fit_router(groups, 6000, 8, "f4", sample=1000, part_rows=100)
    assert router.depth == 6
    sizes = np.bincount(router.route(x, 1)[:, 0], minlength=64)
    assert sizes.min() > 20 and sizes.max() < 3 * 94
    asked = F.col("gid") % 50 == 0
    truth = {(r["a"], r["b"]) for r in exact_neighbours(spark, groups, 8, "f4", 10, asked).collect()}
    found = {(r["a"], r["b"]) for r in neighbours(spark, groups, 8, "f4", 10, 12, queries=asked, router=router).collect()}
    assert len(truth & found) / len(truth) >= 0.9


def test_grown_router_routes_as_its_parts():
    x = np.random.default_rng(13).normal(2, 3, size=(4096, 5))
    top = LearnedPartitions(2).fit(x)
    own = top.route(x, 1)[:, 0]
    below = {p: LearnedPartitions(3).fit(x[own == p]) for p in range(4)}
    leaf = top.grown(below, 3).route(x, 32)[:, 0]
    alone = top.grown(below, 3).route(x, 1)[:, 0]
    assert (leaf == alone).mean() > 0.8  # the beam may find a better one elsewhere
    for p in range(4):
        assert (alone[own == p] == 8 * p + below[p].route(x[own == p], 1)[:, 0]).mean() > 0.999


def test_router_is_balanced():
    x = np.random.default_rng(3).normal(size=(2048, 6))
    parts = LearnedPartitions(4).fit(x).route(x, 3)
    sizes = np.bincount(parts[:, 0], minlength=16)
    assert parts.shape == (2048, 3) and sizes.max() < 3 * 128 and all(len(set(p)) == 3 for p in parts)
    assert (LearnedPartitions(0).fit(x[:1]).route(x, 3) == 0).all()


def clouds(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 12, (5, 8))
    labels = np.repeat(np.arange(5), [900, 400, 300, 200, 200])
    x = centers[labels] + rng.normal(0, 0.5, (2000, 8))
    x[:900] += np.linspace(-8, 8, 900)[:, None] * np.eye(8)[0]  # one is long
    apart = rng.normal(0, 60, (20, 8))
    drifted = centers + rng.normal(0, 0.6, centers.shape)
    return labels, vectors(spark, np.vstack([x, apart])), spark.createDataFrame([(10 + k, v.tolist()) for k, v in enumerate(drifted)], "label int, center array<float>")


def test_clusters(spark):
    labels, df, centers = clouds(spark)
    bad = spark.createDataFrame([(9000, None), (9001, [1.0]), (9002, [float("nan")] * 8)], "vec_id long, embedding array<float>")
    out = spectral_clusters(spark, df.unionByName(bad), "vec_id", "embedding", 8, centers, landmarks=96).collect()
    found = {r["id"]: r["label"] - 10 for r in out}
    assert not set(found) & set(range(2000, 2020)) and max(found) < 2000
    assert len(found) > 1960 and sum(labels[i] == c for i, c in found.items()) / len(found) > 0.995
    assert all(r["affinity"] > 0 for r in out)


def test_clusters_of_nothing(spark):
    _, df, centers = clouds(spark)
    assert spectral_clusters(spark, df.limit(0), "vec_id", "embedding", 8, centers).count() == 0
    assert spectral_clusters(spark, df, "vec_id", "embedding", 8, centers.limit(0)).count() == 0
    same = vectors(spark, np.ones((5, 8)))
    assert spectral_clusters(spark, same, "vec_id", "embedding", 8, centers).count() == 5


def test_small_groups_of_large_tables(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(0, 12, (4, 8))
    labels = np.r_[rng.integers(0, 3, 20_000), np.full(40, 3)]
    x = centers[labels] + rng.normal(0, 0.5, (20_040, 8))
    alone = rng.normal(0, 60, (200, 8))
    named = spark.createDataFrame([(k, (v + 0.2).tolist()) for k, v in enumerate(centers)], "label int, center array<float>")
    out = spectral_clusters(spark, vectors(spark, np.vstack([x, alone])), "vec_id", "embedding", 8, named, sample=500, landmarks=60).collect()
    found = {r["id"]: r["label"] for r in out}
    assert not [i for i in found if i >= 20_040]
    assert all(found.get(i) == 3 for i in range(20_000, 20_040))
    assert sum(found.get(i) == c for i, c in enumerate(labels)) / len(labels) > 0.985


def test_more_groups_than_landmarks_of_the_default(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 12, (2_000, 16))
    labels = rng.integers(0, 2_000, 30_000)
    df = vectors(spark, centers[labels] + rng.normal(0, 0.5, (30_000, 16)))
    named = spark.createDataFrame([(k, (v + rng.normal(0, 0.3, 16)).tolist()) for k, v in enumerate(centers)], "label int, center array<float>")
    found = {r["id"]: r["label"] for r in spectral_clusters(spark, df, "vec_id", "embedding", 16, named).collect()}
    assert sum(found.get(i) == c for i, c in enumerate(labels)) / len(labels) > 0.99


def test_doubtful_labels_do_not_change_clusters(spark):
    labels, df, centers = clouds(spark)
    rng = np.random.default_rng(10)
    rows = [(int(i), int(c) + 10 if rng.random() > 0.2 else int(rng.integers(10, 15))) for i, c in enumerate(labels) if rng.random() > 0.1]
    rows += [(3, None), (4, -1), (4, 77), (None, 10), (99_999, 11), *rows[:50]]
    doubtful = spark.createDataFrame(rows, "id long, label int")
    found = {r["id"]: r["label"] - 10 for r in spectral_clusters(spark, df, "vec_id", "embedding", 8, centers, doubtful, landmarks=96).collect()}
    assert len(found) > 1960 and sum(labels[i] == c for i, c in found.items()) / len(found) > 0.995


def test_groups_that_samples_miss(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(0, 12, (4, 8))
    labels = np.r_[rng.integers(0, 3, 20_000), np.full(120, 3)]
    x = centers[labels] + rng.normal(0, 0.5, (20_120, 8))
    x[20_000:] += np.arange(120)[:, None] * 1.5 * np.eye(8)[0]  # a long one: of half its vectors many are too far from the next
    alone = rng.normal(0, 100, (9_000, 8))
    ring = rng.normal(size=(400, 8)) * np.r_[0, np.ones(7)]
    alone[:400] = centers[3] + 45 * ring / np.linalg.norm(ring, axis=1, keepdims=True)  # nearer to the center than most of the group
    named = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centers)], "label int, center array<float>")
    out = spectral_clusters(spark, vectors(spark, np.vstack([x, alone])), "vec_id", "embedding", 8, named, sample=500, landmarks=60).collect()
    found = {r["id"]: r["label"] for r in out}
    assert [found.get(i) for i in range(20_000, 20_120)] == [3] * 120
    assert sum(found.get(i) == c for i, c in enumerate(labels)) / len(labels) > 0.985
    assert not [i for i in found if i >= 20_120]


def test_landmarks_of_all_vectors(spark):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(0, 0.5, (901, 4)), rng.normal(9, 1.2, (600, 4))]).astype("f4").astype(float)
    rows = spark.createDataFrame([(bytearray(v.astype("f4").tobytes()),) for v in x], "v binary").repartition(3)
    start = np.array([[1.0] * 4, [8.0] * 4, [900.0] * 4])
    marks, radius, usual = place_landmarks(spark, rows, 4, start)
    for _ in range(ROUNDS):
        near = ((x[:, None] - start[:2]) ** 2).sum(2).argmin(1)
        start = np.array([x[near == k].mean(0) for k in range(2)])
    near = ((x[:, None] - start) ** 2).sum(2).argmin(1)
    d = np.sqrt(((x - start[near]) ** 2).sum(1))
    n = np.bincount(near)
    middle = np.array([np.median(d[near == k]) for k in range(2)])
    assert np.allclose(marks, start) and np.isclose(usual, np.median(d), rtol=1e-6)
    assert np.allclose(radius, (n * middle + 8 * np.median(d)) / (n + 8), rtol=1e-6)


def test_sets_of_linked_vectors(spark, monkeypatch):
    monkeypatch.setattr(spectral, "SHARE_BYTES", 4 * 2 * 70)  # shares of 70 vectors
    monkeypatch.setattr(spectral, "TASK_PAIRS", 5_000)
    monkeypatch.setattr(spectral, "LINKS", 10)
    line = np.column_stack([np.arange(200.0), np.zeros(200)])
    x = np.vstack([line, line[:15] + [0, 50], line[:16] + [0, 90], np.repeat([[0.0, 200.0]], 40, 0)])
    left = spark.createDataFrame([(bytearray(v.astype("f4").tobytes()),) for v in x[np.random.default_rng(13).permutation(len(x))]], "v binary").repartition(3)
    out = missed_groups(spark, left, 2, 1.0).collect()
    assert sorted(tuple(np.frombuffer(r["v"], "f4")) for r in out) == sorted(map(tuple, np.vstack([line, line[:16] + [0, 90]])))
    assert sorted(sum(q["root"] == r for q in out) for r in {r["root"] for r in out}) == [16, 200]
    assert missed_groups(spark, left.limit(0), 2, 1.0).count() == 0
