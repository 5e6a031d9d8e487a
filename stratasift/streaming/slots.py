"""Results of streaming batches, one folder per batch.

A version's folder gets a marker when all its rows are written, and only marked versions
are read, so a reader sees a whole version or the one before. Batch b may read the version
of batch b - 1; older ones are removed after b is marked. A batch repeated after a failure
writes its folder anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratasift.sources.versions import files as _files
from stratasift.streaming.changelog import description, read_newest

MARKER = "_DONE"


def _folder(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/batch-{batch:012d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batches whose version is complete, in ascending order."""
    fs, place = _files(spark, path)
    if not fs.exists(place):
        return []
    found = []
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), MARKER)
        if name.startswith("batch-") and fs.exists(done):
            found.append(int(name.removeprefix("batch-")))
    return sorted(found)


def _drop(spark: SparkSession, path: str, keep: set[int]) -> None:
    fs, place = _files(spark, path)
    for status in fs.listStatus(place) if fs.exists(place) else []:
        name = status.getPath().getName()
        if name.startswith("batch-") and int(name.removeprefix("batch-")) not in keep:
            fs.delete(status.getPath(), True)


def write_slot(result: DataFrame, path: str, batch: int) -> None:
    """Store the complete result as of ``batch``."""
    spark = result.sparkSession
    if batch == 0:  # a new stream: forget what an earlier one left
        _drop(spark, path, set())
    folder = _folder(path, batch)
    result.write.mode("overwrite").parquet(folder)
    fs, done = _files(spark, f"{folder}/{MARKER}")
    fs.create(done, True).close()
    _drop(spark, path, {batch - 1, batch})


def read_slot(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The result as of ``batch``, which must be the last or the last but one."""
    return spark.read.parquet(_folder(path, batch))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete result, of whole versions or of a log of changes."""
    if description(spark, path) is not None:
        return read_newest(spark, path)
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no batch result under {path}")
    return read_slot(spark, path, found[-1])
