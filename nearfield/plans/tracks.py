"""Queries of loading, normalising, moods and filters, over all tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.cli import search_moods
from nearfield.functions import mood
from nearfield.operators.exact import exact_knn
from nearfield.operators.filters import by_genre, by_popularity, genres
from nearfield.operators.mood import available_moods, matched_terms, query_vectors, translate
from nearfield.operators.normalize import Normalizer
from nearfield.sources.corpus import METADATA, drop_missing, exact_sample, from_matrix, head, load_csv, to_dataset
from nearfield.sources.tables import new_path, table

# Texts about moods.
TEXTS = [
    "chill", "energetic", "sad", "happy", "workout", "study focus", "high energy gym workout", "music for a rainy day",
    "zzxqq nonsense tokens", "happy sad", "energetic party", "chill rainy day coding music", "Chilled OUT, laid back!", "",
    "calm relaxing", "intense upbeat", "upbeat dance", "mellow romantic", "live",
]
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GENRES = ["lumen step", "velour folk"]
SAMPLE, SEED, K = 100, 7, 10
MATRIX = [[1.0, 5.0, -2.0], [2.0, 5.0, 0.5], [4.0, 5.0, 8.0], [9.0, 5.0, 1.25]]


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TEXTS)), "qid long, text string")


def _fit(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Normalizer.statistics(table(spark, sf_dir, "lineitem"), COLUMNS, method).select("feature", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))

    return query


def norm_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    n = Normalizer.fit(rows, COLUMNS)
    return rows.select("l_orderkey", "l_linenumber", *(F.round(n.transform(c), 6).alias(c) for c in COLUMNS))


def norm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    n = Normalizer.fit(rows, COLUMNS, "minmax")
    there = rows.select("l_orderkey", "l_linenumber", *(n.transform(c).alias(c) for c in COLUMNS))
    return there.select("l_orderkey", "l_linenumber", *(F.round(n.inverse(c), 6).alias(c) for c in COLUMNS))


def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_missing(table(spark, sf_dir, "spotify_tracks"), mood.FEATURES).select("row_id", *mood.FEATURES)


def sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_sample(table(spark, sf_dir, "spotify_tracks"), SAMPLE, "row_id", SEED).select("row_id", "track_id")


def head_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head(table(spark, sf_dir, "spotify_tracks"), SAMPLE, "row_id").select("row_id", "track_id")


def _dataset(spark: SparkSession, sf_dir: str):
    return to_dataset(table(spark, sf_dir, "spotify_tracks"), "row_id")


def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks as a dataset: the metadata and the normalised features."""
    d = _dataset(spark, sf_dir).df
    return d.select(F.col("vec_id").alias("row_id"), "track_id", "popularity", *(F.round(d["embedding"][k].cast("double"), 4).alias(f) for k, f in enumerate(mood.FEATURES)))


def csv_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks written as CSV and loaded again: rows with all features, numbered in file order."""
    path = new_path(spark, "csv")
    rows = table(spark, sf_dir, "spotify_tracks").select("row_id", *METADATA, *mood.FEATURES)
    rows.orderBy("row_id").coalesce(1).drop("row_id").write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    d = load_csv(spark, path).df
    return d.select("vec_id", "track_id", "track_genre", "popularity", *(F.round(d["embedding"][k].cast("double"), 4).alias(f) for k, f in enumerate(mood.FEATURES)))


def matrix_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix with a constant column as a dataset."""
    d = from_matrix(spark, np.array(MATRIX)).df
    return d.select("vec_id", *(F.round(d["embedding"][k].cast("double"), 5).alias(f"f{k}") for k in range(3)))


def genre_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genres(table(spark, sf_dir, "spotify_tracks"))


def filtered_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "spotify_tracks").where(by_genre(GENRES) & by_popularity(40)).select("row_id", "track_genre", "popularity")


def mood_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_terms(spark, _texts(spark)).groupBy("qid", "term").agg(F.count("*").alias("n"))


def mood_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = translate(spark, _texts(spark)).select("qid", F.explode("targets").alias("feature", "value"))
    return rows.select("qid", "feature", F.round("value", 6).alias("value"))


def mood_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate(spark, _texts(spark)).select("qid", "text", "explanation")


def moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available_moods(spark)


def mood_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_moods(spark, _dataset(spark, sf_dir), _texts(spark), "brute", K)
    return found.select("qid", "rn", F.col("vec_id").alias("row_id"), "track_id", F.round("dist", 4).alias("dist"))


def mood_search_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_moods(spark, _dataset(spark, sf_dir), _texts(spark), "brute", K, by_genre(GENRES) & by_popularity(40))
    return found.select("qid", "rn", F.col("vec_id").alias("row_id"), "track_id", F.round("dist", 4).alias("dist"))


def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text and feature the target and the mean of its results, tempo and loudness on the corpus's range."""
    d, texts = _dataset(spark, sf_dir), _texts(spark)
    found = exact_knn(spark, query_vectors(spark, texts, d.normalizer), d.df.select("vec_id", "embedding"), K)
    got = found.join(d.df.select("vec_id", "raw"), "vec_id").select("qid", F.posexplode("raw").alias("pos", "x")).groupBy("qid", "pos").agg(F.avg(F.col("x").cast("double")).alias("results"))
    asked = translate(spark, texts).select("qid", F.posexplode("raw_vector").alias("pos", "target"))
    spans = d.df.agg(*(F.struct(F.min(F.col("raw")[k]).cast("double").alias("lo"), F.max(F.col("raw")[k]).cast("double").alias("hi")).alias(f) for k, f in enumerate(mood.FEATURES)))
    spans = spans.select(F.posexplode(F.array(*mood.FEATURES)).alias("pos", "r")).select("pos", "r.lo", "r.hi")
    names = F.array(*map(F.lit, mood.FEATURES))
    scaled = F.element_at(names, F.col("pos") + 1).isin("tempo", "loudness")
    shown = lambda c: F.round(F.when(scaled, (F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).otherwise(F.col(c)), 4)
    return asked.join(got, ["qid", "pos"]).join(spans, "pos").select("qid", F.element_at(names, F.col("pos") + 1).alias("feature"), shown("target").alias("target"), shown("results").alias("results"))


QUERIES = {
    "norm_zscore_fit": _fit("zscore"),
    "norm_minmax_fit": _fit("minmax"),
    "norm_transform": norm_transform,
    "norm_inverse": norm_inverse,
    "drop_nulls": drop_nulls,
    "sample_exact_n": sample_exact_n,
    "head_limit": head_limit,
    "dataset_rows": dataset_rows,
    "csv_tracks": csv_tracks,
    "matrix_dataset": matrix_dataset,
    "genre_list": genre_list,
    "filtered_tracks": filtered_tracks,
    "mood_tokens": mood_tokens,
    "mood_targets": mood_targets,
    "mood_explanations": mood_explanations,
    "moods": moods,
    "mood_search": mood_search,
    "mood_search_genre": mood_search_genre,
    "feature_profile": feature_profile,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({i}, {_quoted(t)})" for i, t in enumerate(TEXTS))
_TERMS = ", ".join(f"('{t}', '{f}', {v}, {w})" for t, f, v, w in mood.lexicon())
_ALIASES = ", ".join(f"('{p}', '{t}', {k})" for k, (p, t) in enumerate(mood.ALIASES.items()))
_NEUTRAL = ", ".join(f"('{f}', {v}, {k})" for k, (f, v) in enumerate(mood.NEUTRAL.items()))
_MOOD = f"""WITH texts(qid, text) AS (VALUES {_VALUES}),
lexicon(term, feature, target, weight) AS (VALUES {_TERMS}),
aliases(phrase, term, nth) AS (VALUES {_ALIASES}),
neutral(feature, value, pos) AS (VALUES {_NEUTRAL}),
words AS (SELECT qid, unnest(w) AS word, generate_subscripts(w, 1) AS nth FROM (SELECT qid, regexp_extract_all(lower(text), '[a-z]+') AS w FROM texts)),
fired AS (
  SELECT qid, term, phrase AS written, nth - 1000 AS place FROM texts JOIN aliases ON contains(lower(text), phrase)
  UNION ALL
  SELECT qid, word AS term, word AS written, nth AS place FROM words WHERE word IN (SELECT term FROM lexicon)),
asked AS (SELECT qid, feature, sum(CAST(target AS DOUBLE) * CAST(weight AS DOUBLE) ORDER BY place) / sum(CAST(weight AS DOUBLE) ORDER BY place) AS value FROM fired JOIN lexicon USING (term) GROUP BY qid, feature),
targets AS (SELECT t.qid, n.feature, n.pos, coalesce(a.value, CAST(n.value AS DOUBLE)) AS value FROM texts t CROSS JOIN neutral n LEFT JOIN asked a ON a.qid = t.qid AND a.feature = n.feature)
"""
_FULL = " AND ".join(f"{f} IS NOT NULL" for f in mood.FEATURES)


def _stat(template: str) -> str:
    return ", ".join(template.format(f=f) for f in mood.FEATURES)


_TRACKS = f"""full_rows AS (SELECT * FROM spotify_tracks WHERE {_FULL}),
stats AS (SELECT {_stat("avg({f}) AS c_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS s_{f}")} FROM full_rows),
corpus AS (SELECT row_id, track_id, track_genre, popularity, [{_stat("CAST(({f} - c_{f}) / s_{f} AS FLOAT)")}]::DOUBLE[] AS v, [{_stat("CAST({f} AS FLOAT)")}]::DOUBLE[] AS raw FROM full_rows CROSS JOIN stats)"""
_ASKED = f"""wide AS (SELECT qid, {", ".join(f"max(value) FILTER (feature = '{f}') AS t_{f}" for f in mood.FEATURES)} FROM targets GROUP BY qid),
queries AS (SELECT qid, [{_stat("CAST((t_{f} - c_{f}) / s_{f} AS FLOAT)")}]::DOUBLE[] AS q FROM wide CROSS JOIN stats)"""


def _found(where: str = "true") -> str:
    return f"""found AS (SELECT qid, rn, row_id, track_id, raw, dist FROM (SELECT qid, row_id, track_id, raw, list_distance(q, v) AS dist,
  row_number() OVER (PARTITION BY qid ORDER BY list_distance(q, v), row_id) AS rn FROM queries CROSS JOIN (SELECT * FROM corpus WHERE {where})) WHERE rn <= {K})"""


_IN = ", ".join(map(_quoted, GENRES))
_SHOWN = "SELECT qid, CAST(rn AS INTEGER) AS rn, row_id, track_id, round(dist, 4) AS dist FROM found"


def _lines(method: str) -> str:
    one = "avg({c}) AS center, stddev_pop({c}) AS s" if method == "zscore" else "min({c}) AS center, max({c}) - min({c}) AS s"
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, {one.format(c=c)} FROM lineitem" for c in COLUMNS)
    return f"SELECT feature, round(center, 6) + 0.0 AS center, round(CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS scale FROM ({parts})"


SQL = {
    "norm_zscore_fit": _lines("zscore"),
    "norm_minmax_fit": _lines("minmax"),
    "norm_transform": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) + 0.0 AS {c}" for c in COLUMNS)
    + " FROM lineitem",
    "norm_inverse": f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({c}, 6) AS {c}' for c in COLUMNS)} FROM lineitem",
    "drop_nulls": f"SELECT row_id, {', '.join(mood.FEATURES)} FROM spotify_tracks WHERE {_FULL}",
    "sample_exact_n": f"SELECT row_id, track_id FROM spotify_tracks ORDER BY md5(CAST(row_id AS VARCHAR) || chr(31) || '{SEED}'), row_id LIMIT {SAMPLE}",
    "head_limit": f"SELECT row_id, track_id FROM spotify_tracks ORDER BY row_id LIMIT {SAMPLE}",
    "dataset_rows": f"WITH {_TRACKS} SELECT row_id, track_id, popularity, {', '.join(f'round(v[{k + 1}], 4) + 0.0 AS {f}' for k, f in enumerate(mood.FEATURES))} FROM corpus",
    "csv_tracks": f"""WITH {_TRACKS}, kept AS (SELECT c.row_id, t.track_id, t.track_genre, t.popularity, v FROM corpus c JOIN spotify_tracks t USING (row_id))
SELECT row_number() OVER (ORDER BY row_id) - 1 AS vec_id, track_id, track_genre, popularity, {', '.join(f'round(v[{k + 1}], 4) + 0.0 AS {f}' for k, f in enumerate(mood.FEATURES))} FROM kept""",
    "matrix_dataset": "WITH m(vec_id, a, b, c) AS (VALUES "
    + ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(MATRIX))
    + ") SELECT CAST(vec_id AS BIGINT) AS vec_id, round(CAST((a - (SELECT avg(a) FROM m)) / (SELECT stddev_pop(a) FROM m) AS FLOAT)::DOUBLE, 5) + 0.0 AS f0, 0.0::DOUBLE AS f1, "
    "round(CAST((c - (SELECT avg(c) FROM m)) / (SELECT stddev_pop(c) FROM m) AS FLOAT)::DOUBLE, 5) + 0.0 AS f2 FROM m",
    "genre_list": "SELECT DISTINCT track_genre FROM spotify_tracks WHERE track_genre IS NOT NULL",
    "filtered_tracks": f"SELECT row_id, track_genre, popularity FROM spotify_tracks WHERE track_genre IN ({_IN}) AND popularity >= 40",
    "mood_tokens": _MOOD + "SELECT CAST(qid AS BIGINT) AS qid, term, count(*) AS n FROM fired GROUP BY qid, term",
    "mood_targets": _MOOD + "SELECT CAST(qid AS BIGINT) AS qid, feature, round(value, 6) AS value FROM targets",
    "mood_explanations": _MOOD
    + f""", bits AS (SELECT qid, string_agg(CASE feature WHEN 'tempo' THEN 'tempo≈' || format('{{:.0f}}', value) || ' BPM' ELSE feature || '≈' || format('{{:.2f}}', value) END, ', ' ORDER BY list_position({mood.EXPLAINED}, feature)) AS targets
  FROM asked WHERE list_contains({mood.EXPLAINED}, feature) GROUP BY qid),
named AS (SELECT qid, string_agg('''' || written || '''', ', ' ORDER BY place) AS terms FROM (SELECT qid, written, min(place) AS place FROM fired GROUP BY qid, written) GROUP BY qid)
SELECT CAST(t.qid AS BIGINT) AS qid, t.text, CASE WHEN terms IS NULL THEN {_quoted(mood.UNMATCHED_TEXT)} ELSE 'Matched ' || terms || ' → target ' || coalesce(targets, '') || '.' END AS explanation
FROM texts t LEFT JOIN named n ON n.qid = t.qid LEFT JOIN bits b ON b.qid = t.qid""",
    "moods": _MOOD + "SELECT DISTINCT term FROM lexicon",
    "mood_search": f"{_MOOD}, {_TRACKS}, {_ASKED}, {_found()} " + _SHOWN.replace("SELECT qid", "SELECT CAST(qid AS BIGINT) AS qid"),
    "mood_search_genre": f"{_MOOD}, {_TRACKS}, {_ASKED}, {_found(f'track_genre IN ({_IN}) AND popularity >= 40')} " + _SHOWN.replace("SELECT qid", "SELECT CAST(qid AS BIGINT) AS qid"),
    "feature_profile": f"""{_MOOD}, {_TRACKS}, {_ASKED}, {_found()},
got AS (SELECT qid, pos, avg(x) AS results FROM (SELECT qid, unnest(raw) AS x, generate_subscripts(raw, 1) - 1 AS pos FROM found) GROUP BY qid, pos),
spans AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(raw) AS x, generate_subscripts(raw, 1) - 1 AS pos FROM corpus) GROUP BY pos)
SELECT CAST(t.qid AS BIGINT) AS qid, t.feature,
  round(CASE WHEN t.feature IN ('tempo', 'loudness') THEN (t.value - lo) / (hi - lo + 1e-9) ELSE t.value END, 4) AS target,
  round(CASE WHEN t.feature IN ('tempo', 'loudness') THEN (results - lo) / (hi - lo + 1e-9) ELSE results END, 4) AS results
FROM targets t JOIN got g ON g.qid = t.qid AND g.pos = t.pos JOIN spans s ON s.pos = t.pos""",
}
