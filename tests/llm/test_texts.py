"""Packing, mixing and sentences."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import mixing
from nearfield.llm.mixing import min_cost_flow, mixture
from nearfield.llm.packing import best_fit, pack
from nearfield.llm.sentences import candidates, sentences, units, viterbi
from nearfield.llm.tokens import CHUNK, count, encoding, TOKENIZER, token_counts


def test_token_counts(spark):
    rows = [(1, "Hello world, naïve 北京"), (2, ""), (3, None), (4, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "id long, text string, n int")
    got = {r["id"]: r["n_tokens"] for r in token_counts(df, "text", ["id", "n"]).collect()}
    assert got[2] == got[3] == 0 and got[1] == len(encoding(TOKENIZER).encode_ordinary(rows[0][1])) and got[4] > 1


def test_long_text_is_counted_whole():
    text = "word and 12 more, " * (CHUNK // 9)
    assert count(text) == len(encoding(TOKENIZER).encode_ordinary(text))
    assert count("x" * (2 * CHUNK)) > 0


def items_of(patterns):
    out = {}
    for p in patterns:
        assert p.room >= 0 and sum(s * c for s, c in p.items) + p.room == p.capacity
        for s, c in p.items:
            out[s] = out.get(s, 0) + c * p.bins
    return out


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=15))
def test_best_fit_places_all(histogram):
    patterns = best_fit(histogram, (60,))
    assert items_of(patterns) == histogram
    assert sum(p.bins for p in patterns) == plain_best_fit([s for s, c in histogram.items() for _ in range(c)], 60)
    mixed = best_fit(histogram, (16, 32, 60))
    assert items_of(mixed) == histogram and {p.capacity for p in mixed} <= {16, 32, 60}


@pytest.mark.parametrize("capacities", [(100,), (40, 100)])
def test_pack(spark, capacities):
    rng = random.Random(1)
    rows = [(k, 7 if k % 3 else rng.choice([0, None, 30, 99, 100, 101, 250, 700])) for k in range(900)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, n int, piece int")
    got = pack(spark, df, "id", "n", capacities).collect()
    pieces, room = {}, {}
    for r in got:
        pieces.setdefault(r["id"], []).append((r["piece"], r["n"]))
        if r["bin_id"] is not None:
            room.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_start"], r["n"]))
    for k, n in rows:
        own = [s for _, s in sorted(pieces[k])]
        assert sum(own) == (n or 0) and (len(own) == 1 or n > 100) and all(s == 100 for s in own[:-1])
    for (_, capacity), placed in room.items():
        end = 0
        for start, n in sorted(placed):
            assert start == end
            end += n
        assert end <= capacity
    assert len({b for b, _ in room}) == len(room)
    total = sum(n or 0 for _, n in rows)
    assert total / sum(c for _, c in room) > 0.97


def test_pack_beyond_the_histogram(spark):
    """Capacities above what the driver takes: sizes in units, nothing overfilled, only larger items cut."""
    rng = random.Random(4)
    rows = [(k, rng.choice([3, 500, 997, 1000, 1003, 2500, rng.randint(1, 1003)])) for k in range(400)]
    got = pack(spark, spark.createDataFrame(rows, "id long, n int"), "id", "n", (300, 1003), max_sizes=64).collect()
    bins, own = {}, {}
    for r in got:
        bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_start"], r["n"]))
        own.setdefault(r["id"], []).append(r["n"])
    assert {k: sum(v) for k, v in own.items()} == dict(rows) and all(len(own[k]) == -(-n // 1003) for k, n in rows)
    for (_, capacity), placed in bins.items():
        placed.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(placed, placed[1:])) and placed[-1][0] + placed[-1][1] <= capacity
    assert sum(n for _, n in rows) / sum(c for _, c in bins) > 0.85


def test_pack_edges(spark):
    df = spark.createDataFrame([], "id long, n int")
    assert pack(spark, df, "id", "n").count() == 0
    twice = spark.createDataFrame([(1, 5), (1, 5), (None, 5)], "id long, n int")
    assert pack(spark, twice, "id", "n", (10,)).groupBy("bin_id").count().count() == 2
    with pytest.raises(ValueError):
        pack(spark, df, "id", "n", (0,))


def test_flow_shares_overlaps():
    # the first set serves both sources; the second only the first source
    flow = min_cost_flow([100.0, 100.0], [[0, 1], [0]], [100.0, 100.0], [3, 3])
    assert flow[0].get(1) == pytest.approx(100) and flow[1][0] == pytest.approx(100) and flow[0][0] == pytest.approx(0)
    assert sum(min_cost_flow([10.0], [[0]], [100.0], [4])[0].values()) == pytest.approx(40)
    assert min_cost_flow([0.0], [[0]], [10.0], [2]) == [{0: 0.0}]


def unit_flow(supply, members, quota, repeats):
    """Most tokens and least cost, one token along a cheapest path after another."""
    P, S = range(len(supply)), range(len(quota))
    given, used, met, cost = {(p, s): 0 for p in P for s in members[p]}, [0] * len(supply), [0] * len(quota), 0
    most = [max((repeats[s] for s in members[p]), default=0) for p in P]
    while True:
        away = {("p", p): used[p] // supply[p] + 1 for p in P if supply[p] and used[p] < most[p] * supply[p]}
        back = {}
        for _ in range(len(supply) + len(quota)):
            for (p, s), x in given.items():
                if ("p", p) in away and x < repeats[s] * supply[p] and away["p", p] < away.get(("s", s), 1e9):
                    away["s", s], back["s", s] = away["p", p], ("p", p)
                if ("s", s) in away and x > 0 and away["s", s] < away.get(("p", p), 1e9):
                    away["p", p], back["p", p] = away["s", s], ("s", s)
        ends = [(away["s", s], s) for s in S if ("s", s) in away and met[s] < quota[s]]
        if not ends:
            return sum(met), cost
        c, s = min(ends)
        met[s] += 1
        cost += c
        at = ("s", s)
        while at in back:
            before = back[at]
            given[(before[1], at[1]) if before[0] == "p" else (at[1], before[1])] += 1 if before[0] == "p" else -1
            at = before
        used[at[1]] += 1


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_flow_is_maximal_and_cheapest(data):
    sources = data.draw(st.integers(1, 4))
    supply = data.draw(st.lists(st.integers(0, 5), min_size=1, max_size=5))
    members = [sorted(data.draw(st.sets(st.integers(0, sources - 1), max_size=sources))) for _ in supply]
    quota = [data.draw(st.integers(0, 12)) for _ in range(sources)]
    repeats = [data.draw(st.integers(0, 3)) for _ in range(sources)]
    flow = min_cost_flow(list(map(float, supply)), members, list(map(float, quota)), repeats)
    cost = 0.0
    for x, given in zip(supply, flow):
        total, level = sum(given.values()), 1
        assert all(-1e-9 <= y <= repeats[s] * x + 1e-9 for s, y in given.items())
        while total > 1e-9:
            assert x
            cost += level * min(x, total)
            total, level = total - x, level + 1
    met = sum(sum(f.values()) for f in flow)
    assert all(sum(f.get(s, 0) for f in flow) <= quota[s] + 1e-9 for s in range(sources))
    assert (met, cost) == pytest.approx(unit_flow(supply, members, quota, repeats))


def documents(spark):
    rng = random.Random(2)
    rows = [(k, ["hot"] if k % 3 else rng.choice([["a"], ["b"], ["a", "b"], ["off"], [], None]), rng.choice([10, 30, 80])) for k in range(3000)]
    return spark.createDataFrame([*rows, (None, ["a"], 10), (9999, ["a"], None)], "id long, sources array<string>, n int")


def test_mixture(spark):
    targets = spark.createDataFrame([("hot", 0.3, 2), ("a", 0.2, 2), ("b", 0.4, 2), ("gone", 0.1, 9), (None, 0.5, 2)], "source string, target_share double, max_repeats int")
    docs = documents(spark)
    uses, report = mixture(spark, docs, "id", "sources", "n", targets)
    lines = {r["source"]: r for r in report.collect()}
    assert {s for s, r in lines.items() if r["short"]} == {"b", "gone"} and lines["gone"]["reached"] == 0
    for s in ("hot", "a"):
        assert abs(lines[s]["reached"] - lines[s]["target"]) <= 3 * 80
    each = uses.collect()
    assert all(1 <= r["uses"] <= 2 for r in each)
    own = {r["id"]: r["sources"] for r in docs.where("id IS NOT NULL").collect()}
    assert all(r["source"] in own[r["id"]] for r in each)
    again, _ = mixture(spark, docs.repartition(5), "id", "sources", "n", targets)
    assert sorted(each) == sorted(again.collect())


def test_short_sources_follow_from_the_draw(spark, monkeypatch):
    rows = [(k, ["a", "b"][k % 2], 10) for k in range(100)]
    docs = spark.createDataFrame(rows, "id long, source string, n int").withColumn("sources", F.array("source"))
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.05, 2), ("gone", 0.05, 9)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "_mixed", lambda *_: mixture(spark, docs, "id", "sources", "n", targets))
    found = mixing.p9_found(spark, "")
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString()  # the documents are drawn
    assert sorted(r["source"] for r in found.collect()) == ["a", "gone"]


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 0.5, 2)], "source string, target_share double, max_repeats int")
    uses, report = mixture(spark, documents(spark).limit(0), "id", "sources", "n", targets)
    assert uses.count() == 0 and report.count() == 1


def test_units():
    body = "## 4. Head\nFirst line\nsecond. Third.\n\n- one. two\n* three\n\n1. four\n2. five\n\nlast\n- not a list? no"
    got = [(body[a:b].strip(), whole) for a, b, whole in units(body) if body[a:b].strip()]
    assert got == [
        ("4. Head", True), ("First line\nsecond. Third.", False), ("one. two", True), ("three", True), ("four", True), ("five", True), ("last", False), ("not a list? no", True),
    ]


def test_candidates():
    text = 'He said "Stop. Now!" loudly. v1.2.3 is (ok?). End'
    ends = [text[: c.end].split()[-1] for c in candidates(text)]
    assert ends == ['"Stop.', 'Now!"', "loudly.", "(ok?)."]
    assert len(candidates("一。二！“三。”四")) == 3


SENTENCES = {
    "en": ["Dr. Lee measured the flow at 3 p.m. and left.", "See Fig. 4 for the curve.", "Is it stable?", 'She wrote "Stop. Check it!" above the plot.', "The value (cf. Sec. 2.1) stays below 4.5.", "We compare rows, bins, etc.", "Set it to 5.2, i.e. half of the range."],
    "de": ["Frau V. K. Meier prüfte den Wert, vgl. Kap. 8.", "Am 3. März lag er bei 14,6.", "„Der Filter stimmt nicht.“", "Stimmt das?", "Im 44. Schritt wird er geglättet."],
    "zh": ["我们读取数据并保留三行。", "曲线稳定吗？", "她写道“停下！先检查。”然后离开了。", "请看图中的阈值！"],
    "th": ["ค่าของดัชนีเพิ่มขึ้น 12.5 จากเดิม", "ความชันคงที่หรือไม่", "เราอ่านไฟล์ a.csv แล้วเก็บไว้ 7 แถวเท่านั้น", "ดูหน้าต่างในรูปที่ 4 ก่อนเสมอ"],
    "hi": ["यह सीमा गलत है।", "क्या मान स्थिर है?", "हम फ़ाइल पढ़ते हैं।"],
}


def notebooks(spark, n=500):
    """Documents of joined sentences with their true places."""
    rng = random.Random(5)
    rows, truth = [], set()
    for doc in range(n):
        lang = rng.choice(list(SENTENCES))
        text, places = "# %% [markdown]\n", []
        start = len(text)
        for p in range(rng.randint(1, 4)):
            text += "\n\n" if p else ""
            for k in range(rng.choice([1, 1, 2, 3])):
                text += " " if k and lang != "zh" else ""
                s = rng.choice(SENTENCES[lang])
                places.append((doc, len(text), len(text) + len(s)))
                text += s
        cells = [(1, "text", None, start, len(text) - start), (2, "code", 1, 0, 5), (3, None, None, None, None)]
        truth |= set(places)
        rows.append((doc, text, cells, "x"))
    schema = "doc_id long, text string, cells array<struct<cell_no int, kind string, exec_count int, start_pos int, n_chars int>>, doc string"
    return spark.createDataFrame([*rows, (9001, None, None, "x"), (9002, "", [], "x"), (None, "A. B.", [(1, "text", None, 0, 5)], "x")], schema), truth


def test_sentences(spark):
    df, truth = notebooks(spark)
    got = {(r["doc_id"], r["start_pos"], r["end_pos"]) for r in sentences(spark, df.repartition(4), "doc_id", "text", "cells").collect()}
    right = len(got & truth)
    assert right / len(truth) > 0.97 and right / len(got) > 0.97


def test_sentences_of_nothing(spark):
    df, _ = notebooks(spark, 1)
    assert sentences(spark, df.where("doc_id > 9000"), "doc_id", "text", "cells").count() == 0
    astral = df.limit(1).withColumn("text", F.lit("😀 Hello there. ")).withColumn("cells", F.expr("array(named_struct('cell_no', 1, 'kind', 'text', 'exec_count', 0, 'start_pos', 0, 'n_chars', 99))"))
    assert [tuple(r) for r in sentences(spark, astral, "doc_id", "text", "cells").collect()] == [(0, 0, 14)]


# Words of made-up sentences: starts, middles and ends, and what joins words and ends and parts sentences.
WORDS = {
    "en": (["The filter", "Our model", "Each curve", "This table", "A new sensor"], ["keeps", "shows", "needs", "loses"], ["three rows", "the old values", "a second pass", "little noise", "its first column"], " ", ".", " "),
    "zh": (["我们的模型", "这条曲线", "新的表格", "第一个滤波器"], ["保留", "需要", "显示", "改变"], ["三行数据", "旧的数值", "很少的噪声", "另一列"], "", "。", ""),
    "ja": (["この表は", "新しいモデルは", "曲線は", "各フィルタは"], ["三行を", "古い値を", "雑音を", "列を"], ["残します", "示します", "変えます", "失います"], "", "。", ""),
    "km": (["តារាងនេះ", "ម៉ូដែលថ្មី", "ខ្សែកោង", "តម្រង"], ["រក្សា", "បង្ហាញ", "ត្រូវការ"], ["បីជួរ", "តម្លៃចាស់", "សំឡេងតិច"], "", "។", " "),
}


def made_up(rng, lang):
    first, then, last, blank, _, _ = WORDS[lang]
    return blank.join([rng.choice(first), rng.choice(then), rng.choice(last)])


def test_text_stripped_of_stops(spark):
    """Most documents have stops; of those without, the boundaries are found all the same."""
    rng = random.Random(11)
    rows, truth = [], {lang: set() for lang in WORDS}
    for doc in range(1200):
        lang = rng.choice(list(WORDS))
        _, _, _, _, stop, gap = WORDS[lang]
        bare, text = doc % 10 == 0, ""
        for k in range(rng.randint(2, 6)):
            text += ("" if not text or (bare and lang in ("zh", "ja", "km")) else gap if not bare else " ")
            start = len(text)
            text += made_up(rng, lang) + ("" if bare else stop)
            if bare:
                truth[lang].add((doc, start, len(text)))
        rows.append((doc, text, [(1, "text", None, 0, len(text))]))
    df = spark.createDataFrame(rows, "doc_id long, text string, cells array<struct<cell_no int, kind string, exec_count int, start_pos int, n_chars int>>")
    got = {(r["doc_id"], r["start_pos"], r["end_pos"]) for r in sentences(spark, df.repartition(3), "doc_id", "text", "cells").collect()}
    for lang, true in truth.items():
        docs = {d for d, _, _ in true}
        found = {g for g in got if g[0] in docs}
        f1 = 2 * len(found & true) / (len(found) + len(true))
        assert f1 > 0.8, (lang, f1)


def test_stops_of_khmer_and_tibetan():
    assert len(candidates("តារាងនេះ។ ខ្សែកោង។ តម្រង។")) == 2
    assert len(candidates("བཀྲ་ཤིས། བདེ་ལེགས།")) == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.floats(-3, 3), max_size=6), max_size=8), st.lists(st.floats(-2, 2), min_size=4, max_size=4))
def test_viterbi_of_many_sequences(rows, moves):
    from itertools import product

    moves = np.array(moves).reshape(2, 2)
    got = viterbi(np.array([s for r in rows for s in r]), np.array([len(r) for r in rows], int), moves)
    value = lambda r, tags: sum(s for s, t in zip(r, tags) if t) + sum(moves[int(a), int(b)] for a, b in zip(tags, tags[1:]))
    at = 0
    for r in rows:
        best = max((value(r, tags) for tags in product([False, True], repeat=len(r))), default=0)
        assert value(r, got[at : at + len(r)]) == pytest.approx(best)
        at += len(r)


def test_long_paragraph(spark):
    text = "One is here. Two is there! " * 20_000
    df = spark.createDataFrame([(1, text, [(1, "text", None, 0, len(text))])], "doc_id long, text string, cells array<struct<cell_no int, kind string, exec_count int, start_pos int, n_chars int>>")
    rows = sorted((r["start_pos"], r["end_pos"]) for r in sentences(spark, df, "doc_id", "text", "cells").collect())
    assert rows[0][0] == 0 and rows[-1][1] == len(text) - 1 and all(b[0] == a[1] + 1 for a, b in zip(rows, rows[1:]))
