"""A reproducible sample that keeps its records as data grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.sources.tables import materialise, table

#: 2^64 over the golden ratio, odd.
GOLDEN = 11400714819323198485
MODULUS = 1 << 64


def sequence_numbers(spark: SparkSession, df: DataFrame, item: str, arrived: str, known: DataFrame | None = None) -> DataFrame:
    """``item, seq``: items numbered from 0 by first arrival, then item in byte order.

    ``known(item, seq)`` are numbers given before and kept: they stay, and only items
    without one are numbered, after the largest. So no row changes a kept number, even
    one that is dated before rows already numbered. Without them an item's number
    depends only on what arrived before it, so only strictly later arrivals are sure not
    to change it.

    Items are range-parted and sorted in parts; a part's numbers start where the parts
    before it end. Only one count a part reaches the driver. Null items or arrivals get
    no number.
    """
    first = df.select(F.col(item).alias("item"), F.col(arrived).alias("at")).where("item IS NOT NULL AND at IS NOT NULL").groupBy("item").agg(F.min("at").alias("at"))
    total = 0
    if known is not None:
        known = known.select(item, F.col("seq").cast("long").alias("seq"))
        first = first.join(known.select(F.col(item).alias("item")), "item", "left_anti")
        last = known.agg(F.max("seq")).first()[0]
        total = 0 if last is None else last + 1
    parts = first.repartitionByRange("at", "item").sortWithinPartitions("at", "item")
    number = F.monotonically_increasing_id()
    rows = materialise(spark, parts.withColumn("n", number).select("item", F.shiftright("n", 33).alias("part"), F.col("n").bitwiseAND((1 << 33) - 1).alias("place")), "sequence")
    offsets = []
    for part, n in sorted(rows.groupBy("part").count().collect()):
        offsets.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, start long"))  # one row a part
    new = rows.join(starts, "part").select(F.col("item").alias(item), (F.col("start") + F.col("place")).alias("seq"))
    return new if known is None else known.unionByName(new)


def golden_sample(spark: SparkSession, df: DataFrame, item: str, arrived: str, rate: float, seed: int = 23, known: DataFrame | None = None) -> DataFrame:
    """``item, seq`` of the items whose number, times the golden ratio and shifted, has a fraction below ``rate``.

    The fractions of successive numbers cover the interval evenly, so every stretch of
    arrivals gives its share. The arithmetic is exact in 64-bit fractions. The same rows
    in any order, layout or run give the same sample, and rows that arrive later than
    all present ones leave it within the larger sample; with the numbers of earlier runs
    in ``known`` (see ``sequence_numbers``) any further rows do. Repeated items count once; a
    rate of 0 gives none, of 1 all; null items or arrivals are never drawn.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    shift = (GOLDEN * (2 * seed + 1) * (2 * seed + 1)) % MODULUS
    numbered = sequence_numbers(spark, df, item, arrived, known)
    fraction = (F.col("seq").cast("decimal(17,0)") * F.lit(str(GOLDEN)).cast("decimal(20,0)")).cast("decimal(38,0)") + F.lit(str(shift)).cast("decimal(20,0)")
    kept = F.pmod(fraction.cast("decimal(38,0)"), F.lit(str(MODULUS)).cast("decimal(20,0)")) < F.lit(str(int(rate * MODULUS))).cast("decimal(20,0)")
    return numbered.where(kept)


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_sample(spark, table(spark, sf_dir, "spotify_tracks"), "track_id", "loaded_at", 0.1)


QUERIES = {"p7_sample": p7_sample}
SQL = {
    "p7_sample": f"""
WITH first AS (SELECT track_id, min(loaded_at) AS arrived FROM spotify_tracks WHERE track_id IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1),
numbered AS (SELECT track_id, row_number() OVER (ORDER BY arrived, track_id) - 1 AS seq FROM first)
SELECT track_id, seq FROM numbered
WHERE (CAST(seq AS HUGEINT) * {GOLDEN} + {(GOLDEN * 47 * 47) % MODULUS}) % {MODULUS} < {int(0.1 * MODULUS)}""",
}
