"""Top N items within every group, by descending score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.sources.tables import materialise


def top_n_per_group(
    spark: SparkSession,
    df: DataFrame,
    group: str,
    item: str,
    score: str,
    n: int,
    first_share: float = 0.02,
    growth: float = 8.0,
) -> DataFrame:
    """``group, rn, item, score`` of the ``n`` best items of every group.

    The score range is cut at quantiles into bands that hold ``first_share`` of the
    rows and ``growth`` times more each. All bands but the last, a small part of the
    rows, are written once, parted by band, with one scan that has their lower bound
    pushed down. From the top, a band is read, groups already filled are anti-joined
    away, and its rows together with what open groups carry over (fewer than ``n`` rows
    a group) are ranked exactly; a group with ``n`` rows then is final, since all later
    scores are lower. When every group is filled no lower band is read. The window is
    limited before its shuffle, so a group of any size sends at most ``n`` rows a task.

    An item counts once a group, with its highest score; equal scores go by item
    ascending in byte order. Rows with a null group, item or score (NaN too) do not
    count; a group with fewer items gives all; an empty table gives none; further
    columns are not read.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s")).where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL")
    if dict(rows.dtypes)["s"] in ("double", "float"):
        rows = rows.where(~F.isnan("s"))
    shares, share = [], first_share
    while share < 0.5:
        shares.append(1 - share)
        share *= growth
    cuts = sorted(set(rows.select(F.percentile_approx("s", shares, 1000)).first()[0] or []), reverse=True)
    by_score = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))

    def ranked(some: DataFrame) -> DataFrame:
        return some.groupBy("g", "i").agg(F.max("s").alias("s")).withColumn("rn", F.row_number().over(by_score)).where(F.col("rn") <= n)

    def shown(some: DataFrame) -> DataFrame:
        return some.select(F.col("g").alias(group), "rn", F.col("i").alias(item), F.col("s").alias(score))

    if not cuts:
        return shown(ranked(rows))
    groups = rows.select("g").distinct().count()
    band = F.lit(0)
    for cut in cuts[:-1]:
        band = band + (F.col("s") < F.lit(cut)).cast("int")
    upper = materialise(spark, rows.where(F.col("s") >= F.lit(cuts[-1])).withColumn("band", band), "bands", "band")
    done, open_rows, filled = [], None, None
    for k in range(len(cuts)):
        some = upper.where(F.col("band") == k).select("g", "i", "s")
        if filled is not None:
            some = some.join(filled, "g", "left_anti").unionByName(open_rows)
        top = materialise(spark, ranked(some), "topn")
        now = top.where(F.col("rn") == n).select("g")
        done.append(top.join(now, "g", "left_semi"))
        open_rows = top.join(now, "g", "left_anti").select("g", "i", "s")
        filled = now if filled is None else filled.unionByName(now)
        if filled.count() == groups:
            break
    else:
        below = rows.where(F.col("s") < F.lit(cuts[-1])).join(filled, "g", "left_anti").unionByName(open_rows)
        done.append(ranked(below))
    return shown(reduce(DataFrame.unionByName, done))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.sources.tables import table

    top = top_n_per_group(spark, table(spark, sf_dir, "spotify_tracks"), "track_genre", "track_id", "popularity", 10)
    return top.select("track_genre", "rn", "track_id")


QUERIES = {"p2_found": p2_found}
SQL = {
    "p2_found": """
SELECT track_genre, CAST(rn AS INTEGER) AS rn, track_id FROM (
  SELECT track_genre, track_id, row_number() OVER (PARTITION BY track_genre ORDER BY popularity DESC, track_id) AS rn
  FROM (SELECT track_genre, track_id, max(popularity) AS popularity FROM spotify_tracks
        WHERE track_genre IS NOT NULL AND track_id IS NOT NULL AND popularity IS NOT NULL
        GROUP BY track_genre, track_id)) WHERE rn <= 10""",
}
