"""The ledger of complete and partial files: upserts, versioned snapshots, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import column, fresh

KEY = "relative_path"


def upsert(table: DataFrame, rows: DataFrame, key: str = KEY, order: str | None = None) -> DataFrame:
    """``table`` with rows replaced or added by key; of several new rows of a key the last one wins, by ``order`` or as they come."""
    rest = [column(c) for c in rows.columns if c != key]
    at, r = fresh(rows, "at", "r")
    last = F.max_by(F.struct(*rest), column(order or at))
    news = (rows if order else rows.withColumn(at, F.monotonically_increasing_id())).groupBy(column(key)).agg(last.alias(r)).select(column(key), f"{r}.*")
    return table.join(news.select(column(key)), key, "left_anti").unionByName(news.select(*map(column, rows.columns)))


def completed(complete: DataFrame, partial: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after files were finished: out of partial, into complete."""
    return upsert(complete, done), partial.join(done.select(KEY), KEY, "left_anti")


def progressed(partial: DataFrame, updates: DataFrame) -> DataFrame:
    """Partial rows after progress reports (relative_path, completed_chunks): never back, never beyond the total."""
    (new,) = fresh(partial, "new")
    news = updates.groupBy(KEY).agg(F.max("completed_chunks").alias(new))
    at = F.least("total_chunks", F.greatest("completed_chunks", F.coalesce(new, F.lit(0))))
    return partial.join(news, KEY, "left").withColumn("completed_chunks", at.cast("long")).drop(new)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: A pointer's name tells the version and the folder with its rows.
POINTER = "CURRENT-{version:012d}-{name}"


def save_snapshot(df: DataFrame, folder: str) -> str:
    """Write the next version to a folder of its own, then name it by a new pointer file.

    Nothing is replaced or removed: a reader takes the largest pointer, so it sees the old
    state or the new one, never a part, and of two writers at once one comes last."""
    spark = df.sparkSession
    version = (current_version(spark, folder) or 0) + 1
    name = f"v{version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    fs, made = _fs(spark, f"{folder}/.{name}")
    fs.create(made, True).close()
    if not fs.rename(made, _fs(spark, f"{folder}/{POINTER.format(version=version, name=name)}")[1]):
        raise OSError(f"cannot name version {version} in {folder}")
    return f"{folder}/{name}"


def _current(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    fs, where = _fs(spark, folder)
    if not fs.exists(where):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    found = max((n for n in names if n.startswith("CURRENT-")), default=None)
    return None if found is None else (int(found.split("-")[1]), found.split("-", 2)[2])


def current_version(spark: SparkSession, folder: str) -> int | None:
    found = _current(spark, folder)
    return found and found[0]


def due(mutations: int, force: bool = False, every: int = 1024) -> bool:
    """Whether a snapshot is to be saved after so many changes since the last one."""
    return mutations > 0 and (force or mutations >= every)


def load_snapshot(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The current version; without any, an empty table. A damaged version fails."""
    found = _current(spark, folder)
    return spark.createDataFrame([], schema) if found is None else spark.read.schema(schema).parquet(f"{folder}/{found[1]}")
