"""New vectors of a stream to their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.kmeans import KMeans


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files ``(vec_id, embedding)`` that appear in a folder."""
    return spark.readStream.schema("vec_id long, embedding array<float>").parquet(path)


def append_cells(spark: SparkSession, vectors: DataFrame, model: KMeans, path: str, checkpoint: str) -> StreamingQuery:
    """Append ``vec_id, d2`` below the cell's partition of ``path``, each file once; stateless."""
    assigned = model.predict(spark, vectors)
    return assigned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("cell").trigger(availableNow=True).start()
