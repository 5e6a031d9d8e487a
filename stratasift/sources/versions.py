"""Folders of table versions that appear whole or not at all.

A version is written to a folder with a hidden name and renamed when all its rows are there.
The rename is the commit: before it readers see nothing of the version, after it all of it,
and a writer that dies leaves only a hidden folder. On file systems whose renames are atomic
(HDFS, local disks) two writers of one version cannot both succeed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = files(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names in a folder that begin with ``prefix``, in ascending order."""
    fs, place = files(spark, path)
    if not fs.exists(place):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(place))
    return sorted(n for n in found if n.startswith(prefix))


def commit(rows: DataFrame, path: str, name: str) -> bool:
    """Write ``rows`` as the folder ``name`` under ``path``; False if it is there already."""
    spark = rows.sparkSession
    root = path.rstrip("/")
    if exists(spark, f"{root}/{name}"):
        return False
    hidden = f"{root}/_staging-{uuid.uuid4().hex}"  # a name with "=" would not be hidden
    rows.write.parquet(hidden)
    fs, source = files(spark, hidden)
    target = files(spark, f"{root}/{name}")[1]
    if not fs.exists(target) and fs.rename(source, target):
        return True
    fs.delete(source, True)
    return False


def drop(spark: SparkSession, path: str, name: str) -> None:
    fs, place = files(spark, f"{path.rstrip('/')}/{name}")
    fs.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or absent."""
    fs, place = files(spark, path)
    hidden = files(spark, f"{path}._{uuid.uuid4().hex}")[1]
    out = fs.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    fs.rename(hidden, place)


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]
