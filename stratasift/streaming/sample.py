"""Stratified samples of a stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stratasift.functions.columns import resolve_all
from stratasift.functions.priority import SPAN, priority
from stratasift.operators.joins import attach, table_bytes
from stratasift.operators.sample import P, bucket_counts, bucketed, take_smallest
from stratasift.operators.skip import prune_partitions
from stratasift.session import materialize
from stratasift.sources.positions import place_in_partition
from stratasift.streaming.slots import read_latest, read_slot, write_slot


def sample_writer(
    stream: DataFrame,
    allocation: DataFrame,
    by: Iterable[str],
    ids: Iterable[str],
    path: str,
    checkpoint: str,
    seed: int = 0,
    hasher: str = "xxhash64",
    place: str | None = None,
) -> DataStreamWriter:
    """A writer that keeps, after every batch, the sample of all rows so far.

    A full stratum admits only rows below the largest priority it keeps, so a batch
    is cut to the few rows that can enter before anything is shuffled; strata still
    filling up are cut by reservoirs per input partition. The result equals the
    sample drawn from all rows at once with the same seed. Read it with
    :func:`read_sample`.

    ``place`` names a column to be added that tells a batch's rows apart, for streams
    without row ids: with ``ids`` naming the row's file (which is in one batch only), equal
    rows are drawn independently of each other. A batch that is run again may then draw
    other rows, and replaces its version as a whole.
    """
    groups = resolve_all(stream, by)
    keys = [*resolve_all(stream, ids), *([place] if place else [])]
    columns = [*stream.columns, *([place] if place else [])]
    strata = materialize(
        allocation.where(F.col("si") > 0).select(
            *groups,
            F.col("si").alias("_si"),
            F.col("n").alias("_n"),
            F.monotonically_increasing_id().alias("_sid"),
        )
    )
    unlimited = strata.withColumn("_limit", F.lit(SPAN).cast("bigint"))
    size = unlimited.agg(table_bytes(unlimited, groups)).first()[0]

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = unlimited
        kept = read_slot(spark, path, number - 1) if number else None
        if kept is not None:
            bars = kept.groupBy(*groups).agg(
                F.count("*").alias("_kept"), (F.max(P) + 1).alias("_above")
            )
            full = F.col("_kept") >= F.col("_si")
            limit = F.when(full, F.col("_above")).otherwise(SPAN)
            table = materialize(
                strata.join(bars, groups, "left")
                .withColumn("_limit", limit)
                .drop("_kept", "_above")
            )
        told_apart = batch.withColumn(place, place_in_partition()) if place else batch
        keyed = told_apart.withColumn(P, priority(seed, keys, hasher))
        near = attach(keyed, table, groups, P, "_limit", size=size)
        entering = prune_partitions(near, "_sid", "_si", P)
        if kept is not None:
            entering = entering.unionByName(attach(kept, table, groups, P, size=size))
        expected = F.greatest("_si", F.col("_n") * (F.col("_limit") / SPAN))
        found = materialize(bucketed(entering, expected))
        picked = take_smallest(found, bucket_counts(found, groups), groups, keys)
        write_slot(picked.select(*columns, P), path, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """The newest sample."""
    return read_latest(spark, path).drop(P)
