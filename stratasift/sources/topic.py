"""Kafka topics.

The functions that shape records work on any DataFrame with the columns of Spark's
Kafka source, so they also serve files that hold such records. Reading and writing
a topic needs the spark-sql-kafka package on the cluster's class path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATS_SCHEMA = "stratum string, mean double, std double, n bigint"


def long_key(number: Column) -> Column:
    """A number as 8 big-endian bytes, as Kafka's own Long serializer writes it."""
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), 16, "0"))


def key_number(key: Column) -> Column:
    """The number in 8 big-endian bytes; other lengths give NULL."""
    # A negative target base makes conv() read the digits as a signed number.
    text = F.conv(F.hex(key), 16, -10)
    return F.when(F.octet_length(key) == 8, text.cast("bigint"))


def to_records(lines: DataFrame, partitions: int) -> DataFrame:
    """Records from numbered lines (``key``, ``value``), dealt evenly to partitions."""
    if partitions < 1:
        raise ValueError(f"a topic has at least one partition, not {partitions}")
    return lines.select(
        long_key(F.col("key")).alias("key"),
        F.col("value").cast("string").alias("value"),
        F.pmod(F.col("key"), F.lit(partitions)).cast("int").alias("partition"),
    )


def from_records(records: DataFrame) -> DataFrame:
    """``key`` as bigint and ``value`` as text beside topic, partition and offset."""
    return records.select(
        key_number(F.col("key")).alias("key"),
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
    )


def write_records(records: DataFrame, brokers: str, topic: str) -> None:
    """Append records to a topic."""
    (
        records.write.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("topic", topic)
        .save()
    )


def read_topic(spark: SparkSession, brokers: str, topic: str, stream: bool = False) -> DataFrame:
    """All records of a topic from the earliest offset, decoded."""
    reader = spark.readStream if stream else spark.read
    raw = (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return from_records(raw)


def stats_to_records(stats: DataFrame) -> DataFrame:
    """Statistics rows as JSON values."""
    return stats.select(
        F.to_json(F.struct(*stats.columns), {"ignoreNullFields": "false"}).alias("value")
    )


def stats_from_records(records: DataFrame, schema: str = STATS_SCHEMA) -> DataFrame:
    """Statistics rows from JSON values."""
    parsed = F.from_json(F.col("value").cast("string"), schema)
    return records.select(parsed.alias("_row")).select("_row.*")
