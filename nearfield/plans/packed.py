"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.packed import split_packed
from nearfield.sources.tables import table


def p1_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artist of every track row: ``row_id, pos, artist, n_values``."""
    tracks, names = table(spark, sf_dir, "spotify_tracks"), table(spark, sf_dir, "artist_ref")
    return split_packed(spark, tracks, "artists", "row_id", names, "artist_name", "artist")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the strings that hold two or more."""
    found = p1_artists(spark, sf_dir).where("n_values >= 2")
    return found.select("row_id", F.col("pos").cast("int").alias("pos"), "artist")


QUERIES = {"p1_found": p1_found, "p1_artists": p1_artists}
SQL: dict[str, str] = {}
