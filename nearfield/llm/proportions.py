"""A sample whose categories follow target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.sources.tables import materialise, table

BANDS = 4096


def uniform(*columns, seed: int):
    """A number in [0, 1) from the values of a row, the same in every run and layout."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *columns)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def target_report(pairs: DataFrame, targets: DataFrame, category: str, share: str, least: str, divisor: int = 5) -> DataFrame:
    """Per target category: ``category, observed, wanted, taken, deficit``.

    The sample's size S is the number of distinct pairs over ``divisor``, rounded down;
    ``wanted`` is the larger of ``least`` and share times S (to 6 decimals, then up). A
    null share or least counts as 0; a repeated category takes its largest figures; a
    category without rows has ``observed`` 0.
    """
    counts = pairs.groupBy(category).agg(F.count("*").alias("observed"))
    size = counts.agg(F.floor(F.coalesce(F.sum("observed"), F.lit(0)) / divisor).alias("s"))
    wish = targets.where(F.col(category).isNotNull()).groupBy(category).agg(F.coalesce(F.max(share), F.lit(0.0)).alias("share"), F.coalesce(F.max(least), F.lit(0)).alias("least"))
    wanted = F.greatest(F.col("least").cast("long"), F.ceil(F.round(F.col("share") * F.col("s"), 6)))
    out = wish.crossJoin(F.broadcast(size)).join(counts, category, "left")  # size is one row
    out = out.select(category, F.coalesce("observed", F.lit(0)).cast("long").alias("observed"), wanted.cast("long").alias("wanted"))
    return out.withColumn("taken", F.least("observed", "wanted")).withColumn("deficit", F.col("wanted") - F.col("taken"))


def proportional_sample(spark: SparkSession, pairs: DataFrame, report: DataFrame, category: str, item: str, seed: int = 17, over: float = 0.02) -> DataFrame:
    """``category, item``: exactly ``taken`` distinct pairs of each category of ``report``.

    Every pair is accepted by itself if its uniform number falls below the category's
    ratio of target to observed, raised by ``over`` and four standard deviations. The
    counts are then corrected exactly: accepted pairs are counted per category in
    ``BANDS`` equal bands of the number, whole bands are kept below the one in which the
    target falls, and only that band is ranked, so a category of any size is never
    sorted in one task. If a category got too few, its other pairs are added first.
    Pairs of categories without a target are not drawn.
    """
    wish = report.where("taken > 0").select(category, "taken", F.least(F.lit(1.0), ((1 + over) * F.col("taken") + 4 * F.sqrt("taken") + 8) / F.col("observed")).alias("p"))
    drawn = pairs.join(wish, category).withColumn("u", uniform(F.col(category), F.col(item), seed=seed))
    accepted = materialise(spark, drawn.where("u < p"), "accepted")
    got = accepted.groupBy(category).agg(F.count("*").alias("got"))
    short = wish.join(got, category, "left").where(F.coalesce("got", F.lit(0)) < F.col("taken")).select(category)
    if not short.isEmpty():
        accepted = accepted.unionByName(drawn.where("u >= p").join(short, category, "left_semi"))
    banded = accepted.withColumn("band", F.floor(F.col("u") / F.col("p") * BANDS))
    upto = Window.partitionBy(category).orderBy("band")
    counts = banded.groupBy(category, "band").agg(F.count("*").alias("n"), F.first("taken").alias("_taken"))
    below = counts.withColumn("below", F.sum("n").over(upto) - F.col("n")).where("below < _taken").select(category, "band", "n", "below")
    kept = banded.join(below, [category, "band"])
    whole = kept.where("below + n <= taken").select(category, item)
    rank = F.row_number().over(Window.partitionBy(category).orderBy("u", item))
    edge = kept.where("below + n > taken").withColumn("rank", rank).where("below + rank <= taken").select(category, item)
    return whole.unionByName(edge)


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tracks = table(spark, sf_dir, "spotify_tracks").select("track_genre", "track_id").where("track_genre IS NOT NULL AND track_id IS NOT NULL")
    pairs = materialise(spark, tracks.distinct(), "pairs")
    return pairs, target_report(pairs, table(spark, sf_dir, "genre_targets"), "track_genre", "target_share", "min_rows")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres that fell short in the drawn sample."""
    pairs, report = _parts(spark, sf_dir)
    sample = proportional_sample(spark, pairs, report, "track_genre", "track_id")
    drawn = sample.groupBy("track_genre").agg(F.count("*").alias("drawn"))
    return report.join(drawn, "track_genre", "left").where(F.coalesce("drawn", F.lit(0)) < F.col("wanted")).select("track_genre")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, report = _parts(spark, sf_dir)
    return proportional_sample(spark, pairs, report, "track_genre", "track_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[1]


QUERIES = {"p6_found": p6_found, "p6_sample": p6_sample, "p6_report": p6_report}

_REPORT = """
WITH pairs AS (SELECT DISTINCT track_genre, track_id FROM spotify_tracks WHERE track_genre IS NOT NULL AND track_id IS NOT NULL),
counts AS (SELECT track_genre, count(*) AS observed FROM pairs GROUP BY 1),
size AS (SELECT count(*) // 5 AS s FROM pairs),
report AS (
  SELECT t.track_genre, coalesce(observed, 0) AS observed,
         CAST(greatest(min_rows, ceil(round(target_share * s, 6))) AS BIGINT) AS wanted
  FROM genre_targets t CROSS JOIN size LEFT JOIN counts c ON t.track_genre = c.track_genre)
"""
SQL = {
    "p6_found": _REPORT + "SELECT track_genre FROM report WHERE observed < wanted",
    "p6_report": _REPORT + "SELECT *, least(observed, wanted) AS taken, wanted - least(observed, wanted) AS deficit FROM report",
    "p6_sample": _REPORT
    + """, ranked AS (
  SELECT p.track_genre, p.track_id, least(observed, wanted) AS taken,
         row_number() OVER (PARTITION BY p.track_genre ORDER BY substr(md5('17' || chr(31) || p.track_genre || chr(31) || p.track_id), 1, 13), p.track_id) AS rank
  FROM pairs p JOIN report r ON p.track_genre = r.track_genre)
SELECT track_genre, track_id FROM ranked WHERE rank <= taken""",
}
