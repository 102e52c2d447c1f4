import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.functions.packing import Tokenizer, fold
from nearfield.operators.packed import split_packed

NAMES = ["Bekov/Anchor", 'Qith "Meadow" Hurust', "Juniper, Besoth & Ribbon", "Jalox + Mosaics", "Tilk", "A & B"]
KNOWN = {fold(n) for n in NAMES}
LONGEST = max(len("".join(n.split())) for n in NAMES)


@pytest.mark.parametrize(
    "text, values",
    [
        ('"A;b", c', ["A;b", "c"]),
        ('["A", "B ""q"" d"]', ["A", 'B "q" d']),
        ("'Don't x', 'B'", ["Don't x", "B"]),
        ('Qith "Meadow" Hurust;Bekov/Anchor', ['Qith "Meadow" Hurust', "Bekov/Anchor"]),
        ("juniper,  besoth & RIBBON | Tilk", ["juniper,  besoth & RIBBON", "Tilk"]),
        ("a,, b ;; ", ["a", "b"]),
        ("(a; b), c", ["a", "b", "c"]),
        ('"open; b', ['"open', "b"]),
        ("a feat. b ft. c featuring d x e + f", ["a", "b", "c", "d", "e", "f"]),
        ("Kid X", ["Kid X"]),
        ("a; a", ["a", "a"]),
        ("x (live; 2001); y", ["x (live; 2001)", "y"]),
        ('"a\\"b"; c', ['a"b', "c"]),
        ("", []),
        ("  ", []),
        (";,", []),
    ],
)
def test_values(text, values):
    assert Tokenizer(KNOWN, LONGEST).split(text) == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text('ab";, /&|', min_size=1, max_size=8).filter(lambda v: v.strip() == v and v), min_size=1, max_size=5))
def test_quoted_round_trip(values):
    packed = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert Tokenizer().split(packed) == values


@settings(max_examples=100, deadline=None)
@given(st.text("ab \"'[](){};,/|&x+\\", max_size=30))
def test_never_fails(text):
    Tokenizer(KNOWN, LONGEST).split(text)


def test_long_text_is_linear():
    assert len(Tokenizer(KNOWN, LONGEST).split("ab; " * 50_000)) == 50_000


def test_table(spark):
    rows = [(1, "Bekov/Anchor; Tilk", 9), (1, "Bekov/Anchor; Tilk", 9), (2, None, 9), (3, "", 9), (4, "Tilk", 9), (5, "a, b", 9)]
    df = spark.createDataFrame(rows, "id long, packed string, pos long")
    names = spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "name string")
    want = sorted([(1, 1, "Bekov/Anchor"), (1, 2, "Tilk")] * 2 + [(4, 1, "Tilk"), (5, 1, "a"), (5, 2, "b")])
    for limit in (100, 2):  # the broadcast way and the join
        out = split_packed(spark, df, "packed", "id", names, max_broadcast_names=limit)
        assert sorted((r["id"], r["pos"], r["value"]) for r in out.collect()) == want
    assert split_packed(spark, df.limit(0), "packed", "id", names).count() == 0
    assert split_packed(spark, df, "packed", "id").where("id = 1").count() == 6


def test_hot_text_of_a_large_reference(spark, monkeypatch):
    from nearfield.operators import packed

    monkeypatch.setattr(packed.join_texts, "__defaults__", (50,))
    df = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'Bekov/Anchor; Tilk' ELSE concat('a', id, '/b') END AS packed")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    out = sorted(map(tuple, split_packed(spark, df, "packed", "id", names, max_broadcast_names=2).collect()))
    assert out == sorted(map(tuple, split_packed(spark, df, "packed", "id", names).collect())) and len(out) == 600


def test_one_pass_over_the_texts(spark):
    df = spark.createDataFrame([(1, "a; b")], "id long, packed string")
    plan = split_packed(spark, df, "packed", "id").where("n_values >= 2")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Python") + plan.count("MapInArrow") == 1
