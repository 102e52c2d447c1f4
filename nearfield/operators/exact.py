"""Exact k nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.arrays import dimension, packed, usable
from nearfield.functions.metrics import check_metric, distance
from nearfield.operators.blocks import nearest, ranked
from nearfield.operators.filters import allow

#: Queries broadcast at once by ``expression_knn``.
BLOCK_QUERIES = 10_000


def exact_knn(
    spark: SparkSession,
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    metric: str = "l2",
    allowed: Column | DataFrame | None = None,
    dim: int | None = None,
) -> DataFrame:
    """``qid, vec_id, rn, dist``: the ``k`` nearest of ``corpus(vec_id, embedding)`` for each of ``queries(qid, qvec)``.

    ``allowed`` is a condition on the corpus or a table of ``vec_id``; it is applied
    before the search, so min(k, allowed) rows come out. Ties go to the smaller id.
    ``k`` of 0 gives no rows. Vectors that are null, hold a null or NaN or have another
    length are left out on both sides; repeated ids are separate rows.
    """
    check_metric(metric)
    if k < 0:
        raise ValueError("k must not be negative")
    dim = dim or dimension(corpus, "embedding")
    base = allow(corpus, allowed)
    return nearest(spark, packed(queries, dim, "qvec", "qid"), packed(base, dim, "embedding", "vec_id"), dim, k, metric)


def expression_knn(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2", dim: int | None = None, max_queries: int | None = None) -> DataFrame:
    """The same by column expressions alone; more than ``max_queries``, if given, are refused.

    The queries are broadcast in blocks of about ``BLOCK_QUERIES``, cut by a hash of
    ``qid``, and the window is limited before its shuffle, so a task passes on k rows a
    query. Slower than ``exact_knn``, which multiplies blocks.
    """
    dim = dim or dimension(corpus, "embedding")
    asked = queries.where(usable(F.col("qvec"), dim)).select("qid", "qvec")
    n = asked.count()
    if max_queries is not None and n > max_queries:
        raise ValueError(f"more than {max_queries} queries; use exact_knn")
    base = corpus.where(usable(F.col("embedding"), dim)).select("vec_id", "embedding")
    blocks, out = max(1, -(-n // BLOCK_QUERIES)), None
    for block in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.coalesce(F.xxhash64("qid"), F.lit(0)), F.lit(blocks)) == block)
        pairs = base.join(F.broadcast(some))
        found = ranked(pairs.select("qid", "vec_id", distance(F.col("qvec"), F.col("embedding"), metric, dim).alias("dist")), k)
        out = found if out is None else out.unionByName(found)
    return out


def nearest_to(point: list[float], corpus: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """``vec_id, dist`` of the k nearest to one point: a sort that keeps k rows a task."""
    q = F.array(*(F.lit(float(x)) for x in point))
    base = corpus.where(usable(F.col("embedding"), len(point)))
    return base.select("vec_id", distance(F.col("embedding"), q, metric, len(point)).alias("dist")).orderBy("dist", "vec_id").limit(k)


def as_queries(corpus: DataFrame) -> DataFrame:
    """Every vector of a corpus as a query."""
    return corpus.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
