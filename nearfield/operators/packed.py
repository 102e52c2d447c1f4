"""Several values packed in one field: one row per value, with its place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.packing import Tokenizer, fold, solid
from nearfield.sources.tables import materialise

#: A reference of at most so many names is sent to every executor; beyond it the names
#: that occur are found by a join.
MAX_BROADCAST_NAMES = 200_000
#: A text that more rows hold, and more than a thousandth of all, is joined in salted shares.
HOT_ROWS, SALTS = 100_000, 32


def few_names(names: DataFrame, column: str, limit: int) -> list[str] | None:
    """The names, or none if there are more than ``limit``."""
    rows = names.where(F.col(column).isNotNull()).select(column).limit(limit + 1).toArrow().column(0).to_pylist()
    return rows if len(rows) <= limit else None


def known_stretches(spark: SparkSession, texts: DataFrame, names: DataFrame, column: str, key: Callable[[str], str] = fold, measure: Callable[[str], int] = solid, slack: int = 1) -> tuple[DataFrame, int]:
    """``(texts(text, n, known), longest)``: per text the keys of its stretches that are names.

    ``texts(text, n)`` holds different texts and how many rows each has. Names and
    stretches meet in a join, so neither is sent to every executor. ``longest`` is
    ``slack`` times the largest name, as ``measure`` counts.
    """

    @F.pandas_udf("string")
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(key)

    @F.pandas_udf("long")
    def measured(values: pd.Series) -> pd.Series:
        return values.map(measure)

    listed = names.where(F.col(column).isNotNull()).select(keyed(F.col(column)).alias("key"))
    longest = slack * (listed.agg(F.max(measured("key"))).first()[0] or 0)

    @F.pandas_udf("array<string>")
    def spans(values: pd.Series) -> pd.Series:
        tokenizer = Tokenizer((), longest, key, measure=measure)
        return values.map(tokenizer.spans)

    occurring = texts.select("text", F.explode(spans("text")).alias("key")).join(listed.where("key <> ''").distinct(), "key", "left_semi")
    found = occurring.groupBy("text").agg(F.collect_set("key").alias("known"))
    return texts.join(found, "text", "left"), longest


def join_texts(rows: DataFrame, column: str, id_column: str, texts: DataFrame, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``out``, the ``known`` of their text in ``texts(text, n, known)``.

    A text that many rows hold is met in ``SALTS`` shares. At most a thousand texts are
    as frequent as that, so their list is sent to every executor.
    """
    total = texts.agg(F.sum("n")).first()[0] or 0
    hot = [r["text"] for r in texts.where(F.col("n") > max(hot_rows, total // 1000)).select("text").collect()]  # at most 1,000
    right = texts.select(F.col("text").alias(column), F.col("known").alias(out))
    if not hot:
        return rows.join(right, column, "left")
    listed = F.broadcast(rows.sparkSession.createDataFrame([(t, True) for t in hot], f"`{column}` string, __hot boolean"))
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(listed, column, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    mine = F.when(F.col("__hot"), F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    return rows.join(listed, column, "left").withColumn("__salt", mine).drop("__hot").join(right, [column, "__salt"], "left").drop("__salt")


def split_packed(
    spark: SparkSession,
    df: DataFrame,
    column: str,
    id_column: str,
    names: DataFrame | None = None,
    name_column: str = "name",
    out: str = "value",
    max_broadcast_names: int = MAX_BROADCAST_NAMES,
) -> DataFrame:
    """One row ``(id_column, pos, out, n_values)`` per value of ``column``.

    ``names`` lists values that are taken whole whatever separators they contain,
    letter case and runs of blanks aside. Up to ``max_broadcast_names`` of them go to
    the executors and no row of ``df`` is shuffled; a larger list is joined with the
    stretches that occur in the data (see ``known_stretches``), so nothing that grows is
    broadcast, and a text that a third of the rows hold is joined in shares.

    A null, empty or blank field gives no row; empty values between separators are
    skipped and not counted; repeated values and repeated rows stay; other columns of
    ``df`` are not looked at, so their names can't clash. ``pos`` counts from 1.
    """
    rows = df.select(F.col(id_column).alias("__id"), F.col(column).cast("string").alias("__text")).where(F.col("__text").isNotNull())
    kind = dict(rows.dtypes)["__id"]
    listed = [] if names is None else few_names(names, name_column, max_broadcast_names)
    if listed is not None:
        keys = frozenset(k for k in map(fold, listed) if k)
        shared, longest = spark.sparkContext.broadcast(keys), max(map(solid, keys), default=0)
    else:
        texts = materialise(spark, rows.groupBy(F.col("__text").alias("text")).agg(F.count("*").alias("n")), "texts")
        texts, longest = known_stretches(spark, texts, names, name_column)
        rows = join_texts(rows, "__text", "__id", materialise(spark, texts, "known"), "__known")
        shared = None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value if shared else (), longest)
        for batch in batches:
            places, pos, values, sizes = [], [], [], []
            known = None if shared else batch.column("__known").to_pylist()
            for at, text in enumerate(batch.column("__text").to_pylist()):
                if known:
                    tokenizer.known = set(known[at] or ())
                found = tokenizer.split(text)
                values += found
                pos += range(1, len(found) + 1)
                sizes.append(len(found))
            sizes = np.array(sizes, np.int64)
            places = pa.array(np.repeat(np.arange(len(batch)), sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(places), pa.array(pos, pa.int32()), pa.array(values, pa.string()), pa.array(np.repeat(sizes, sizes).astype(np.int32))], ["id", "pos", "value", "n"]
            )

    found = rows.mapInArrow(split, f"id {kind}, pos int, value string, n int")
    return found.select(F.col("id").alias(id_column), "pos", F.col("value").alias(out), F.col("n").alias("n_values"))
