"""Which vectors may be found, and whether to filter before or after probing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allow(corpus: DataFrame, allowed: Column | DataFrame | None) -> DataFrame:
    """The rows of ``corpus`` a condition or a table of ``vec_id`` allows.

    A null condition does not allow. Ids that occur again count once; negative ids are
    rejected when the table is read, unknown ones allow nothing.
    """
    if allowed is None:
        return corpus
    if isinstance(allowed, DataFrame):
        sign = F.when(F.col("vec_id") < 0, F.raise_error(F.lit("negative id"))).otherwise(F.col("vec_id"))
        return corpus.join(allowed.where("vec_id IS NOT NULL").select(sign.alias("vec_id")), "vec_id", "left_semi")
    return corpus.where(allowed)


def is_selective(n_allowed: int, n: int, k: int) -> bool:
    """So few are allowed that searching just those exactly beats probing."""
    return n_allowed <= max(4 * k, int(0.02 * n))


def by_genre(genres: list[str], column: str = "track_genre") -> Column:
    """Any of the genres; all rows if none is given."""
    return F.col(column).isin(genres) if genres else F.lit(True)


def by_popularity(least: int, column: str = "popularity") -> Column:
    return F.col(column) >= least


def genres(df: DataFrame, column: str = "track_genre") -> DataFrame:
    """The distinct genres, sorted."""
    return df.select(column).na.drop().distinct().orderBy(column)
