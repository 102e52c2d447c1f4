import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import mood
from nearfield.functions.metrics import block_sq, distance, get_metric, similarity
from nearfield.operators.mood import matched_terms, query_vectors, translate
from nearfield.operators.normalize import Normalizer
from nearfield.operators.pq import subspace_bounds


def measured(spark, q, m, metric, dim=None):
    df = spark.createDataFrame([(i, q, v) for i, v in enumerate(m)], "i long, q array<double>, v array<double>")
    return [r[0] for r in df.orderBy("i").select(distance(F.col("q"), F.col("v"), metric, dim)).collect()]


def test_distances(spark):
    m = [[3.0, 4.0, 0.0], [0.0, 0.0, 0.0], [1.0, 2.0, 2.0]]
    for dim in (None, 3):
        assert measured(spark, [0.0, 0.0, 0.0], m, "l2", dim) == [5, 0, 3]
        assert measured(spark, [0.0, 0.0, 0.0], m, "sqeuclidean", dim) == [25, 0, 9]
        assert measured(spark, [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0]], "cosine", dim and 2) == [0, 1, 2, 1]
    assert get_metric("euclidean") is get_metric("l2")
    with pytest.raises(ValueError):
        get_metric("manhattan")
    assert spark.range(1).select(similarity(F.lit(1.0), 3)).first()[0] == 0.5


def test_block_matches_naive():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(7, 5)), rng.normal(size=(9, 5))
    assert np.allclose(block_sq(a, b), ((a[:, None] - b) ** 2).sum(2))


def test_normalizer(spark):
    x = np.random.default_rng(0).normal(3, 10, (500, 3))
    df = spark.createDataFrame([(*map(float, r), 1.0) for r in x], "a double, b double, c double, k double")
    n = Normalizer.fit(df, ["a", "b", "c", "k"])
    z = np.array([tuple(r) for r in df.select(*map(n.transform, n.columns)).collect()])
    assert np.allclose(z[:, :3].mean(0), 0, atol=1e-9) and np.allclose(z[:, :3].std(0), 1) and (z[:, 3] == 0).all()
    t = df.select(*(n.transform(c).alias(c) for c in n.columns))
    assert np.allclose(np.array([tuple(r) for r in t.select(*map(n.inverse, n.columns)).collect()])[:, :3], x)
    m = Normalizer.fit(df, ["a", "b"], "minmax")
    y = np.array([tuple(r) for r in df.select(*map(m.transform, m.columns)).collect()])
    assert y.min() == 0 and abs(y.max() - 1) < 1e-12
    assert Normalizer.fit(df.limit(0), ["a"]).scale == [1.0]
    with pytest.raises(ValueError):
        Normalizer.fit(df, ["a"], "robust")


def test_subspaces():
    assert subspace_bounds(9, 2) == [(0, 5), (5, 9)]
    assert subspace_bounds(8, 4) == [(0, 2), (2, 4), (4, 6), (6, 8)]


def test_lexicon():
    rows = mood.lexicon()
    assert len({t for t, *_ in rows}) == 41 and {f for _, f, *_ in rows} <= set(mood.FEATURES)
    assert set(mood.ALIASES.values()) <= {t for t, *_ in rows} and list(mood.NEUTRAL) == mood.FEATURES


def told(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    return [r for r in translate(spark, df).orderBy("qid").collect()]


def test_moods(spark):
    chill, party, rainy, none, both, null = told(spark, "chill", "Energetic PARTY", "music for a rainy day", "zzxqq", "happy sad", None)
    assert chill["targets"]["energy"] == 0.25 and party["targets"]["energy"] > 0.8
    assert rainy["matched"] == ["rainy day", "rainy"] and rainy["targets"]["energy"] == pytest.approx(0.3)
    assert none["matched"] == [] and none["explanation"] == mood.UNMATCHED_TEXT and none["raw_vector"] == list(mood.NEUTRAL.values())
    assert both["targets"]["valence"] == pytest.approx((0.9 + 0.12) / 2) and null["matched"] == []
    assert chill["explanation"] == "Matched 'chill' → target energy≈0.25, valence≈0.50, acousticness≈0.60, tempo≈95 BPM."


def test_phrase_and_word_fire_both(spark):
    df = spark.createDataFrame([(0, "rainy day"), (1, "happy happy"), (2, "chilled out")], "qid long, text string")
    fired = sorted((r["qid"], r["term"]) for r in matched_terms(spark, df).collect())
    assert fired == [(0, "rainy"), (0, "rainy"), (1, "happy"), (1, "happy"), (2, "chill")]


def test_query_vector(spark):
    df = spark.createDataFrame([(0, "loud")], "qid long, text string")
    n = Normalizer(mood.FEATURES, [1.0] * 9, [2.0] * 9)
    v = query_vectors(spark, df, n).first()["qvec"]
    assert v[2] == pytest.approx((-3 - 1) / 2) and len(v) == 9
