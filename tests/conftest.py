import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def vectors(spark, x, **columns):
    """A table ``vec_id, embedding`` and further columns of a matrix."""
    rows = [(i, [float(t) for t in v], *(c[i] for c in columns.values())) for i, v in enumerate(x)]
    kinds = "".join(f", {name} {'string' if isinstance(c[0], str) else 'long'}" for name, c in columns.items())
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + kinds)


@pytest.fixture(scope="session")
def blobs(spark):
    rng = np.random.default_rng(42)
    centers = rng.uniform(-10, 10, (12, 8))
    labels = np.repeat(np.arange(12), 50)
    x = centers[labels] + rng.normal(0, 0.4, (600, 8))
    order = rng.permutation(600)
    return vectors(spark, x[order], label=labels[order].tolist()).cache()


@pytest.fixture(scope="session")
def uniform(spark):
    return vectors(spark, np.random.default_rng(7).random((800, 16))).cache()


@pytest.fixture(scope="session")
def asked(spark, uniform):
    ids = np.random.default_rng(99).choice(800, 40, replace=False).tolist()
    from pyspark.sql import functions as F

    return uniform.where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")).cache()
