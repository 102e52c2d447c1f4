import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from nearfield.cli import make_search, search_moods
from nearfield.functions.mood import FEATURES
from nearfield.operators.filters import by_genre, by_popularity, genres
from nearfield.operators.kmeans import KMeans
from nearfield.sources.corpus import to_dataset
from nearfield.streaming.assign import append_cells, read_vectors


@pytest.fixture(scope="module")
def tracks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"t{i}", f"n{i}", ["pop", "rock", None][i % 3], i % 101, *map(float, rng.random(9))) for i in range(300)]
    rows[5] = (*rows[5][:5], None, *rows[5][6:])
    kinds = ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, f"row_id long, track_id string, track_name string, track_genre string, popularity int, {kinds}").cache()


def test_mood_search(spark, tracks):
    data = to_dataset(tracks, "row_id")
    assert data.n() == 299
    texts = spark.createDataFrame([(0, "party"), (1, "sleep")], "qid long, text string")
    found = search_moods(spark, data, texts, "brute", 5, by_genre(["pop"]) & by_popularity(20)).collect()
    assert [(r["qid"], r["rn"]) for r in found] == [(q, n) for q in (0, 1) for n in range(1, 6)]
    assert {r["track_genre"] for r in found} == {"pop"} and all(0 < r["similarity"] < 1 and r["popularity"] >= 20 for r in found)
    assert [r[0] for r in genres(tracks).collect()] == ["pop", "rock"]
    assert tracks.where(by_genre([])).count() == 300


@pytest.mark.parametrize("index", ["brute", "ivf", "ivfpq", "hnsw"])
def test_factory(spark, tracks, index):
    corpus = to_dataset(tracks, "row_id", limit=80).df.select("vec_id", "embedding").cache()
    q = corpus.where("vec_id < 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    first = make_search(spark, index, corpus, 80)(q, 3).where("rn = 1").collect()
    assert {(r["qid"], r["vec_id"]) for r in first} == {(0, 0), (1, 1), (2, 2)}


def test_unknown_index(spark, tracks):
    with pytest.raises(ValueError):
        make_search(spark, "tree", tracks, 5)


def test_stream(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(60, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    model = KMeans(4, init="first_k").fit(spark, rows)
    where = [str(tmp_path / name) for name in ("in", "out", "state")]
    for part in (rows.where("vec_id < 40"), rows.where("vec_id >= 40")):
        part.write.mode("append").parquet(where[0])
        append_cells(spark, read_vectors(spark, where[0]), model, *where[1:]).awaitTermination()
    got = {(r["vec_id"], r["cell"]) for r in spark.read.parquet(where[1]).collect()}
    assert got == {(r["vec_id"], r["cell"]) for r in model.predict(spark, rows).collect()}


def test_entry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
