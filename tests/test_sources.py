import json

import numpy as np
import pytest

from nearfield.cli import PRESETS, main, make_search
from nearfield.functions.metrics import blocks_available
from nearfield.operators.evaluate import BenchResult, load_results, markdown, micro_benchmark, save_results
from nearfield.operators.exact import as_queries
from nearfield.operators.hnsw import HNSWIndex
from nearfield.operators.kmeans import KMeans
from nearfield.operators.mood import fixed
from nearfield.operators.normalize import Normalizer
from nearfield.sources import tables
from nearfield.sources.corpus import FEATURES, load_csv


def csv(path, rows):
    head = ["track_id", "track_name", "artists", "track_genre", "popularity", *FEATURES]
    path.write_text("\n".join(",".join(map(str, r)) for r in [head, *rows]) + "\n")


def track(k, **other):
    row = [f"t{k}", f'"Name ""{k}""\nline"', "a;b", f"g{k % 3}", k, *((k * 7 + j) % 10 / 10 for j in range(9))]
    for place, value in other.items():
        row[int(place[1:])] = value
    return row


def test_csv_ids_number_what_is_kept(spark, tmp_path):
    csv(tmp_path / "a.csv", [track(k) if k != 2 else track(k, c6="") for k in range(6)])
    data = load_csv(spark, str(tmp_path / "a.csv"))
    assert [(r["vec_id"], r["track_id"]) for r in data.df.orderBy("vec_id").collect()] == list(enumerate(["t0", "t1", "t3", "t4", "t5"]))
    assert data.df.where("vec_id = 2").first()["track_name"] == 'Name "3"\nline'
    assert [r["track_id"] for r in load_csv(spark, str(tmp_path / "a.csv"), limit=3).df.orderBy("vec_id").collect()] == ["t0", "t1", "t3"]
    some = load_csv(spark, str(tmp_path / "a.csv"), limit=3, sample_seed=4).df.collect()
    assert sorted(r["vec_id"] for r in some) == [0, 1, 2] and load_csv(spark, str(tmp_path / "a.csv"), dropna=False).n() == 6


def test_csv_of_several_files(spark, tmp_path):
    for name, size, first in (("b.csv", 40, 100), ("a.csv", 4, 0), ("c.csv", 9, 200)):
        csv(tmp_path / name, [track(first + k) for k in range(size)])
    rows = load_csv(spark, str(tmp_path)).df.orderBy("vec_id").collect()
    assert [r["vec_id"] for r in rows] == list(range(53)) and [r["popularity"] for r in rows] == [*range(4), *range(100, 140), *range(200, 209)]


def test_command_line(spark, tmp_path, capsys):
    csv(tmp_path / "a.csv", [track(k) for k in range(30)])
    main(["sad rainy night", "--data", str(tmp_path / "a.csv"), "--index", "brute", "--k", "3", "--genre", "g1"])
    told, *lines = capsys.readouterr().out.strip().split("\n")
    assert told.startswith("Matched 'sad', 'rainy', 'night'") and sum(line.startswith(("1\t", "2\t", "3\t")) for line in lines) == 3
    main(["chill", "--data", str(tmp_path / "a.csv"), "--index", "ivf", "--genre", "none"])
    assert "none" in capsys.readouterr().out


@pytest.mark.parametrize("index", list(PRESETS))
@pytest.mark.parametrize("app", [False, True])
def test_presets(spark, blobs, index, app, monkeypatch):
    if index == "ivfpq":
        monkeypatch.setitem(PRESETS[index]["app"]["build"], "ksub", 32)
    search = make_search(spark, index, blobs.select("vec_id", "embedding"), 600, app)
    found = search(as_queries(blobs.where("vec_id < 5")), 3).collect()
    assert len(found) == 15 and all(r["vec_id"] == r["qid"] for r in found if r["rn"] == 1)
    with pytest.raises(ValueError):
        make_search(spark, "tree", blobs, 600)


def test_results_round_trip(spark, tmp_path):
    some = [BenchResult("ivf", {"nprobe": 4}, 100, 8, 10, 0.5, 1.25, 2.0, 800.0, 0.9876, 1.5, {"nlist": 10}), BenchResult("brute", {}, 100, 8, 10, 0.0, 1.0, 1.0, 1000.0, 1.0, 1.0)]
    save_results(spark, some, str(tmp_path / "out"))
    back = {r["index"]: r for r in load_results(spark, str(tmp_path / "out" / "json")).collect()}
    assert back["ivf"]["recall_at_k"] == 0.9876 and back["ivf"]["n"] == 100 and json.loads(back["ivf"]["extra"]) == {"nlist": 10}
    assert markdown(some).splitlines()[2] == "| ivf | nprobe=4 | 0.988 | 1.250 | 2.000 | 800 | 0.50 | 1.50 |"
    assert markdown(some).splitlines()[3].startswith("| brute | — |")


def test_kernels_of_one_machine():
    found = micro_benchmark(500, 9, 3)
    assert found["max_diff"] < 1e-6 and found["block_ms"] > 0 and blocks_available()


def test_fit_predict(spark, blobs):
    cells = KMeans(3, 5).fit_predict(spark, blobs)
    assert cells.count() == 600 and {r["cell"] for r in cells.select("cell").distinct().collect()} == {0, 1, 2}


def test_normalizer_edges(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0), (5.0, None)], "a double, b double")
    for method in ("zscore", "minmax"):
        n = Normalizer.fit(df, ["a", "b"], method)
        assert n.scale[0] == 1.0 and [r[0] for r in df.select(n.transform("a")).collect()] == [0.0 if method == "zscore" else 0.0] * 3
    with pytest.raises(ValueError):
        Normalizer.fit(df, ["a"], "robust")


def test_rounding_of_binary_values(spark):
    values = [k / 1000 for k in range(2000)] + np.random.default_rng(1).random(2000).tolist() + [0.125, 0.375, 7.995, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", fixed("x", 2).alias("s")).collect()
    assert [r["s"] for r in rows] == [f"{r['x']:.2f}" for r in rows]


def test_memory_counts_nodes_of_every_layer(spark, uniform):
    index = HNSWIndex(4, 30, seed=2).build(spark, uniform)
    rows = index.nodes.collect()
    links = sum((len(r["base"]) + sum(map(len, r["upper"]))) // 4 for r in rows)
    assert sum(r["level"] for r in rows) > 0 and all(len(r["upper"]) == r["level"] for r in rows)
    assert index.memory_bytes() == 4 * 800 * 16 + 8 * links + 56 * sum(r["level"] + 1 for r in rows)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = spark.conf, Cluster()

    monkeypatch.setattr(type(spark.conf), "get", lambda *_: None)
    with pytest.raises(RuntimeError):
        tables.shared_dir(Session())
