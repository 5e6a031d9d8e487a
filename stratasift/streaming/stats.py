"""Stratum statistics of a stream, kept up to date incrementally."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stratasift.functions.columns import group_columns, resolve
from stratasift.operators.clean import clean
from stratasift.operators.stats import stratum_stats
from stratasift.streaming.changelog import append, describe, newest

ARRIVED = "_arrived"


def with_arrival(stream: DataFrame, name: str = "arrived") -> DataFrame:
    """The time a row was read; it never runs backwards, so no row is late by it."""
    return stream.withColumn(name, F.current_timestamp())


def arriving(stream: DataFrame, by: list[str | int], value: str | int, on_bad: str = "drop") -> DataFrame:
    """Cleaned rows with their arrival as the stream's event time, watermark delay 0.

    The arrival of the newest row is the clock of the whole stream, whatever its stratum.
    """
    rows = clean(stream, by, value, on_bad=on_bad)
    return with_arrival(rows, ARRIVED).withWatermark(ARRIVED, "0 seconds")


def stats_writer(
    stream: DataFrame,
    by: Iterable[str | int],
    value: str | int,
    path: str,
    checkpoint: str,
    on_bad: str = "drop",
) -> DataStreamWriter:
    """A writer that keeps the statistics of all rows so far.

    Every batch adds the strata that it changed to a log of changes; read the newest row of
    each with :func:`stratasift.streaming.slots.read_latest`. The caller picks the trigger:
    ``availableNow`` for input that ends.
    """
    groups = group_columns(stream, by)
    rows = arriving(stream, groups, value, on_bad)
    stats = stratum_stats(rows, groups, resolve(stream, value))

    def fold(log: DataFrame) -> DataFrame:
        return newest(log, groups)

    def store(batch: DataFrame, number: int) -> None:
        if number == 0:
            describe(batch.sparkSession, path, {"by": groups})
        append(batch, path, number, fold)

    return (
        stats.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
