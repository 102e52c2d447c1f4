"""Collections of vectors: loading, sampling, generating."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.mood import FEATURES
from nearfield.operators.normalize import Normalizer
from nearfield.sources.tables import materialise

# The columns kept beside the features.
METADATA = ["track_id", "track_name", "artists", "album_name", "track_genre", "popularity"]
SCHEMA = T.StructType(
    [*(T.StructField(c, T.StringType()) for c in METADATA[:-1]), T.StructField("popularity", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in FEATURES)]
)


@dataclass
class Dataset:
    """``vec_id``, ``embedding`` (normalised), ``raw`` and the metadata columns present."""

    df: DataFrame
    columns: list[str]
    normalizer: Normalizer

    @property
    def metadata(self) -> list[str]:
        return [c for c in METADATA if c in self.df.columns]

    @property
    def d(self) -> int:
        return len(self.columns)

    def n(self) -> int:
        return self.df.count()

    def describe(self, found: DataFrame) -> DataFrame:
        """The metadata of found ``vec_id``s, with the other columns of ``found``, by rank."""
        if not self.metadata:
            raise ValueError("the dataset has no metadata")
        rows = found.join(self.df.select("vec_id", *self.metadata), "vec_id")
        return rows.orderBy(*[c for c in ("qid", "rn") if c in found.columns])


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without rows that have a null or NaN in one of the columns."""
    return df.na.drop(subset=columns)


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first ``n`` by key."""
    return df.orderBy(key).limit(n)


def sample_order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("\x1f", F.col(key).cast("string"), F.lit(str(seed))))


def exact_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly ``n`` rows (or all), the same in every run and layout."""
    return df.orderBy(sample_order(key, seed), key).limit(n)


def to_dataset(df: DataFrame, key: str, columns: list[str] = FEATURES, method: str = "zscore", limit: int | None = None, dropna: bool = True, sample_seed: int | None = None) -> Dataset:
    """A table with feature columns as a dataset.

    Rows lacking a feature are dropped if ``dropna``; then ``limit`` rows are taken,
    the first by key, or a seeded sample if a seed is given and there are more.
    """
    rows = drop_missing(df, columns) if dropna else df
    if limit is not None:
        rows = exact_sample(rows, limit, key, sample_seed) if sample_seed is not None else head(rows, limit, key)
    normalizer = Normalizer.fit(rows, columns, method)
    kept = [c for c in METADATA if c in df.columns]
    raw = F.array(*(F.col(c).cast("float") for c in columns))
    return Dataset(rows.select(F.col(key).alias("vec_id"), normalizer.vector().alias("embedding"), raw.alias("raw"), *kept), columns, normalizer)


def numbered(df: DataFrame, out: str, *order: str) -> DataFrame:
    """``df`` with its rows numbered from 0 by ``order``: sorted in parts, whose numbers start where the parts before end."""
    spark = df.sparkSession
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    rows = materialise(spark, parts.withColumn("_part", F.shiftright("_n", 33)).withColumn("_n", F.col("_n").bitwiseAND((1 << 33) - 1)), "numbered")
    starts, total = [], 0
    for part, n in sorted(rows.groupBy("_part").count().collect()):  # one row a part
        starts.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
    return rows.join(starts, "_part").withColumn(out, F.col("_start") + F.col("_n")).drop("_part", "_start", "_n")


def load_csv(spark: SparkSession, path: str, limit: int | None = None, dropna: bool = True, sample_seed: int | None = None, **options) -> Dataset:
    """Tracks from CSV with a header; ids number the rows that are kept from 0, in file order.

    Rows of several files follow in the order of the files' names. Which rows are kept
    is decided before they are numbered (see ``to_dataset``).
    """
    names = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in SCHEMA}
    schema = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    rows = rows.withColumn("_file", F.input_file_name()).withColumn("_row", F.monotonically_increasing_id())  # a file is read by one task
    if dropna:
        rows = drop_missing(rows, [f for f in FEATURES if f in names])
    rows = numbered(rows, "vec_id", "_file", "_row").drop("_file", "_row")
    if limit is not None:
        rows = exact_sample(rows, limit, "vec_id", sample_seed) if sample_seed is not None else head(rows, limit, "vec_id")
        if sample_seed is not None:
            rows = numbered(rows.withColumnRenamed("vec_id", "_row"), "vec_id", "_row").drop("_row")
    return to_dataset(rows, "vec_id", dropna=False, **options)


def from_matrix(spark: SparkSession, values: np.ndarray, method: str = "zscore") -> Dataset:
    """Rows of a matrix with features named f0, f1, ..."""
    columns = [f"f{k}" for k in range(values.shape[1])]
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], ", ".join(["vec_id long", *(f"{c} double" for c in columns)]))
    return to_dataset(rows, "vec_id", columns, method, dropna=False)


def make_clustered(spark: SparkSession, n: int, dim: int, n_clusters: int, seed: int = 0, spread: float = 3.0) -> DataFrame:
    """``vec_id, embedding, label``: normal clouds of unit deviation about normal centres."""
    centers = np.random.default_rng(seed).normal(0, spread, (n_clusters, dim))
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_clusters)).cast("int").alias("label"))
    middle = F.element_at(F.array(*(F.array(*map(F.lit, c.tolist())) for c in centers)), F.col("label") + 1)
    noise = F.array(*(F.randn(seed * 10_007 + k + 1) for k in range(dim)))
    return rows.select("vec_id", F.zip_with(middle, noise, lambda a, b: (a + b).cast("float")).alias("embedding"), "label")


def corpus_queries(corpus: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``qid, qvec``: ``n`` rows of the corpus, each at most once."""
    return exact_sample(corpus, n, "vec_id", seed).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def repeated_queries(corpus: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` queries from the rows of the corpus, which may occur again."""
    spark = corpus.sparkSession
    rows = materialise(spark, numbered(corpus.select("vec_id", "embedding"), "_place", "vec_id"), "places")
    total = rows.count()
    drawn = materialise(spark, spark.range(n).select(F.col("id").alias("qid"), F.floor(F.rand(seed) * total).cast("long").alias("_place")), "drawn")
    return drawn.join(rows, "_place").select("qid", F.col("embedding").alias("qvec"))


def noisy_queries(corpus: DataFrame, n: int, noise: float = 0.5, seed: int = 0) -> DataFrame:
    """Rows of the corpus with normal noise added."""
    dim = len(corpus.where("embedding IS NOT NULL").first()["embedding"])
    shake = F.array(*(F.randn(seed + k + 1) * noise for k in range(dim)))
    return corpus_queries(corpus, n, seed).select("qid", F.zip_with("qvec", shake, lambda a, b: (a + b).cast("float")).alias("qvec"))
