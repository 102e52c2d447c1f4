"""Top items, copies in other spelling, proportional and stable samples."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nearfield.llm.proportions import proportional_sample, target_report
from nearfield.llm.spelling import Trie, canonical, radix_buckets, spelling_groups
from nearfield.llm.stable import golden_sample, sequence_numbers
from nearfield.llm.topn import top_n_per_group


def best(rows, n):
    by = defaultdict(dict)
    for g, i, s in rows:
        if None not in (g, i, s):
            by[g][i] = max(by[g].get(i, -1), s)
    return sorted((g, k + 1, i) for g, items in by.items() for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:n]))


@pytest.mark.parametrize("first, growth", [(0.02, 8.0), (0.2, 2.0), (0.9, 2.0)])
def test_top_n(spark, first, growth):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "é", None]), rng.choice(["x", "y", "Z", "ä"]) + str(rng.randrange(60)) if rng.random() > 0.05 else None, rng.choice([None, 0, 5, 5, 90, rng.randrange(101)])) for _ in range(3000)]
    rows += [("few", "one", 3), ("few", "one", 3)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "genre string, item string, score int, rn int, g string")
    got = top_n_per_group(spark, df, "genre", "item", "score", 7, first, growth)
    assert sorted((r["genre"], r["rn"], r["item"]) for r in got.collect()) == best(rows, 7)


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "g string, i string, s double")
    assert top_n_per_group(spark, df, "g", "i", "s", 3).count() == 0
    nan = spark.createDataFrame([("g", "i", float("nan")), ("g", "j", 1.0)], "g string, i string, s double")
    assert [r["i"] for r in top_n_per_group(spark, nan, "g", "i", "s", 3).collect()] == ["j"]


def test_canonical():
    assert canonical(" Los  Tiwampé! ") == canonical("LOS TIWAMPÉ") != canonical("los tiwampe")
    assert canonical("STRASSE") == canonical("Straße") and canonical("?!") == ""
    assert canonical("हिन्दी") != canonical("हन्द")


def test_trie():
    t = Trie()
    keys = [b"", b"a", b"abcdefgh", b"abcdefghi", b"abcdefgh", b"a"]
    last = {k: t.add(k, 10 - at, at + 1) for at, k in enumerate(keys)}
    assert last == {b"": [10, 1], b"a": [5, 8], b"abcdefgh": [6, 8], b"abcdefghi": [7, 4]}


ROWS = [
    (5, "Blue Sky", "A; B", "One"),
    (3, "BLUE-sky!", "b, a", "one."),
    (9, "One", "Blue Sky", "A & B"),
    (9, "One", "Blue Sky", "A & B"),
    (4, "Blue Sky", "A; B; B", "One"),
    (7, "Blue Skÿ", "A; B", "One"),
    (8, None, "A; B", "One"),
    (2, "Blue Sky", "", "One"),
    (1, "...", "A; B", "One"),
    (None, "Blue Sky", "A; B", "One"),
]


@pytest.mark.parametrize("bucket_rows, max_known", [(50_000, 10), (1, 10), (50_000, 1)])
def test_copies(spark, bucket_rows, max_known):
    df = spark.createDataFrame([(*r, 0) for r in ROWS], "id long, t string, a string, l string, key int").repartition(3)
    names = spark.createDataFrame([("A",), ("B",), (None,)], "n string")
    members, groups = spelling_groups(spark, df, "id", ["t", "a", "l"], ["a"], names, "n", max_known, bucket_rows)
    got = Counter((r["first_row_id"], r["row_id"]) for r in members.collect())
    assert got == {(3, 3): 1, (3, 5): 1, (3, 9): 2, (4, 4): 1, (7, 7): 1}
    assert sorted(map(tuple, groups.collect())) == [(3, 4), (4, 1), (7, 1)]
    members, groups = spelling_groups(spark, df.limit(0), "id", ["t", "a", "l"], ["a"], names, "n", max_known, bucket_rows)
    assert members.count() == groups.count() == 0


def test_hot_copies(spark):
    """A third of all rows are one record."""
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, F.lit("Hot One")).otherwise(F.concat(F.lit("T"), "id")).alias("t"), F.lit("A").alias("a"), F.lit("L").alias("l"))
    names = spark.createDataFrame([("A",)], "n string")
    members, groups = spelling_groups(spark, df.repartition(4), "id", ["t", "a", "l"], ["a"], names, "n", bucket_rows=100)
    assert Counter(r["n_rows"] for r in groups.collect()) == {3000: 1, 1: 6000}
    assert Counter(r["count"] for r in members.groupBy("first_row_id").count().collect()) == {3000: 1, 1: 6000}


def test_names_full_of_signs(spark):
    """What bounds the stretches looked up are letters and digits, whatever stands between them."""
    df = spark.createDataFrame([(1, "T", "A, B & C; D", "L"), (2, "t", "D; a,  -- ** -- !!!! b ///// & ..... c", "l")], "id long, t string, a string, l string")
    names = spark.createDataFrame([("A, B & C",), ("D",), ("E",)], "n string")
    for max_known in (10, 1):
        groups = spelling_groups(spark, df, "id", ["t", "a", "l"], ["a"], names, "n", max_known)[1]
        assert list(map(tuple, groups.collect())) == [(1, 2)]


@pytest.mark.parametrize("max_splits", [1000, 0])
def test_radix_buckets_fit(spark, max_splits):
    reps = spark.range(3000).select(F.col("id").alias("rep_id"), F.concat(F.lit("samestart"), F.format_string("%05d", "id")).cast("binary").alias("key"))
    sizes = [r["count"] for r in radix_buckets(spark, reps, 200, max_splits).groupBy("bucket").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == 3000


TARGETS = [("a", 0.5, 0), ("b", 0.3, 40), ("c", 0.1, 30), ("none", 0.1, 5), (None, 0.5, 9), ("a", 0.5, 0)]


def pairs_of(spark, *counts):
    return spark.createDataFrame([(c, f"{c}{k}") for c, n in counts for k in range(n)], "cat string, item string")


def test_proportions(spark):
    pairs = pairs_of(spark, ("a", 4000), ("b", 900), ("c", 20), ("other", 80))
    targets = spark.createDataFrame(TARGETS, "cat string, share double, least int")
    report = target_report(pairs, targets, "cat", "share", "least")
    lines = {r["cat"]: (r["observed"], r["wanted"], r["taken"], r["deficit"]) for r in report.collect()}
    assert lines == {"a": (4000, 500, 500, 0), "b": (900, 300, 300, 0), "c": (20, 100, 20, 80), "none": (0, 100, 0, 100)}
    one = proportional_sample(spark, pairs, report, "cat", "item").collect()
    assert Counter(r["cat"] for r in one) == {"a": 500, "b": 300, "c": 20} and len(set(one)) == 820
    again = proportional_sample(spark, pairs.repartition(7), report, "cat", "item").collect()
    assert sorted(one) == sorted(again)
    other = proportional_sample(spark, pairs, report, "cat", "item", seed=18).collect()
    assert sorted(one) != sorted(other)
    low = proportional_sample(spark, pairs, report, "cat", "item", over=-0.9).collect()
    assert sorted(one) == sorted(low)  # too few accepted at first


def test_proportions_of_nothing(spark):
    empty = pairs_of(spark, ("a", 1)).limit(0)
    targets = spark.createDataFrame(TARGETS, "cat string, share double, least int")
    report = target_report(empty, targets, "cat", "share", "least")
    assert report.where("taken > 0").count() == 0 and report.count() == 4
    assert proportional_sample(spark, empty, report, "cat", "item").count() == 0


def arrivals(spark, n, start=0):
    rows = spark.range(start, n).select(F.concat(F.lit("t"), (F.col("id") * 7919 % 100_003).cast("string")).alias("item"), F.timestamp_seconds(F.col("id") / 3).alias("at"))
    return rows


def test_stable_sample(spark):
    small, large = arrivals(spark, 2000), arrivals(spark, 5000)
    one = {r["item"] for r in golden_sample(spark, small, "item", "at", 0.1).collect()}
    again = {r["item"] for r in golden_sample(spark, small.union(small).repartition(7), "item", "at", 0.1).collect()}
    more = {r["item"] for r in golden_sample(spark, large, "item", "at", 0.1).collect()}
    assert one == again and one <= more and abs(len(one) - 200) <= 3 and abs(len(more) - 500) <= 3
    numbers = sorted(r["seq"] for r in sequence_numbers(spark, small, "item", "at").collect())
    assert numbers == list(range(2000))


def test_kept_numbers_stand_whatever_arrives(spark):
    rows = arrivals(spark, 2000)
    numbers = sequence_numbers(spark, rows, "item", "at")
    one = {r["item"] for r in golden_sample(spark, rows, "item", "at", 0.1, known=numbers).collect()}
    early = spark.createDataFrame([("before all", 0), ("t7919", 0)], "item string, s long").select("item", F.timestamp_seconds(F.col("s") - 900).alias("at"))
    tie = rows.limit(1).select(F.lit(" first of equals").alias("item"), "at")
    more = rows.unionByName(early).unionByName(tie).unionByName(arrivals(spark, 3000, 2000))
    again = sequence_numbers(spark, more, "item", "at", numbers)
    assert sorted(r["seq"] for r in again.collect()) == list(range(3002))
    assert one <= {r["item"] for r in golden_sample(spark, more, "item", "at", 0.1, known=numbers).collect()}
    assert sequence_numbers(spark, rows, "item", "at", numbers.limit(0)).count() == 2000


def test_stable_sample_edges(spark):
    df = spark.createDataFrame([(None, None), ("a", None)], "item string, at timestamp").union(arrivals(spark, 5))
    assert golden_sample(spark, df, "item", "at", 1.0).count() == 5 and golden_sample(spark, df, "item", "at", 0.0).count() == 0
    assert golden_sample(spark, df.limit(0), "item", "at", 0.5).count() == 0
    with pytest.raises(ValueError):
        golden_sample(spark, df, "item", "at", 2.0)


def test_top_n_stops_when_all_are_filled(spark):
    df = spark.range(20_000).selectExpr("concat('g', id % 5) AS g", "concat('i', id) AS i", "CAST(id AS INT) AS s")
    found = top_n_per_group(spark, df, "g", "i", "s", 3, 0.02, 4.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "topn" in str(found.inputFiles())  # the table is not read again, nor the second band
    assert sorted((r["g"], r["rn"], r["i"]) for r in found.collect()) == sorted((f"g{(19_999 - k) % 5}", k // 5 + 1, f"i{19_999 - k}") for k in range(15))
