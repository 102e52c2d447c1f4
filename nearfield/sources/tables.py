"""Reading the input tables and writing intermediate ones that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: ``spark.checkpoint.dir``.

    Where the session names none, a fresh local folder is set, once, for the session,
    but only if all tasks run on this machine (master ``local``); on a cluster that is
    an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark, "_nearfield_dir", None)
        if folder is None:
            master = spark.sparkContext.master
            if master.split("[")[0] != "local":
                raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
            folder = "file://" + tempfile.mkdtemp(prefix="nearfield-")
            spark._nearfield_dir = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses; ``forget`` deletes it."""
    path = f"{shared_dir(spark)}/nearfield-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialise(spark: SparkSession, df: DataFrame, name: str = "part", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, in folders ``by`` a column if given.

    This cuts the lineage: a lost executor makes Spark read the files again, not
    repeat the work before them. ``forget`` deletes them.
    """
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete what was written to ``new_path``; results that still read it must be saved before."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
