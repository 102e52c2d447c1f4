"""Normalisation by statistics of the corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Normalizer:
    """Centre and scale of each feature; corpus and queries share them."""

    columns: list[str]
    center: list[float]
    scale: list[float]
    method: str = "zscore"

    @staticmethod
    def statistics(df: DataFrame, columns: list[str], method: str = "zscore") -> DataFrame:
        """``feature, center, scale``: one aggregation. A scale of 0 (or of no rows) is 1.

        ``zscore`` takes the mean and the deviation of the population, ``minmax`` the
        least value and the range. Nulls and NaN don't count.
        """
        if method not in ("zscore", "minmax"):
            raise ValueError(f"unknown method {method!r}; known are zscore, minmax")
        aggs = []
        for c in columns:
            x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
            center, scale = (F.avg(x), F.stddev_pop(x)) if method == "zscore" else (F.min(x), F.max(x) - F.min(x))
            guarded = F.when(F.coalesce(scale, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(scale)
            aggs.append(F.struct(F.lit(c).alias("feature"), F.coalesce(center, F.lit(0.0)).alias("center"), guarded.alias("scale")))
        return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], method: str = "zscore") -> Normalizer:
        rows = cls.statistics(df, columns, method).collect()  # one row a feature
        return cls(columns, [r["center"] for r in rows], [r["scale"] for r in rows], method)

    def transform(self, column: str) -> Column:
        """A column as normalised."""
        k = self.columns.index(column)
        return (F.col(column).cast("double") - F.lit(self.center[k])) / F.lit(self.scale[k])

    def inverse(self, column: str) -> Column:
        k = self.columns.index(column)
        return F.col(column) * F.lit(self.scale[k]) + F.lit(self.center[k])

    def vector(self) -> Column:
        """All features as one normalised vector, in order."""
        return F.array(*map(self.transform, self.columns)).cast("array<float>")

    def transform_vector(self, vector: Column) -> Column:
        steps = F.arrays_zip(vector.alias("x"), F.array(*map(F.lit, self.center)).alias("c"), F.array(*map(F.lit, self.scale)).alias("s"))
        return F.transform(steps, lambda t: (t["x"] - t["c"]) / t["s"])
