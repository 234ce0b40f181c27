"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder of its own; a cluster's
    executors would not find it, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the application has ended; the folder's owner clears it
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/driftline-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that no later plan reads."""
    _remove(spark, path)


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def stored(df: DataFrame, name: str, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, and a lost executor costs only a read."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.options(**{"compression": "zstd"} | (options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
