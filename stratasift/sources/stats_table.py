"""Statistics stored between the two phases.

A stored table is a folder of committed versions. Replacing the table adds a snapshot and
readers go over to it; the one before stays for readers that have begun, older ones are
removed. Appending adds a numbered version; a number that is there already is left as it is,
so a writer that is run again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.sources.versions import commit, drop, names

VERSION = "version"
SNAPSHOT = "snapshot="
APPENDED = "version="


def write_stats(stats: DataFrame, path: str, version: int | None = None) -> bool:
    """Store statistics: replace the table, or append one version of it.

    False if the version was there already, or another writer replaced the table meanwhile.
    """
    spark = stats.sparkSession
    if version is not None:
        return commit(stats, path, f"{APPENDED}{version}")
    held = names(spark, path, SNAPSHOT)
    number = int(held[-1].removeprefix(SNAPSHOT)) + 1 if held else 0
    done = commit(stats, path, f"{SNAPSHOT}{number:012d}")
    for old in held[:-1]:
        drop(spark, path, old)
    return done


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were appended, in ascending order."""
    return sorted(int(n.removeprefix(APPENDED)) for n in names(spark, path, APPENDED))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics as they were stored: the newest snapshot, or all appended versions with
    their number as a column. A folder of plain Parquet files is read as it is."""
    root = path.rstrip("/")
    if snapshots := names(spark, root, SNAPSHOT):
        return spark.read.parquet(f"{root}/{snapshots[-1]}")
    if numbers := versions(spark, root):
        folders = [f"{root}/{APPENDED}{n}" for n in numbers]
        table = spark.read.option("basePath", root).parquet(*folders)
        return table.withColumn(VERSION, F.col(VERSION).cast("bigint"))
    return spark.read.parquet(root)
