"""Per-stratum statistics: compute, sort, merge, keep the newest."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.functions.columns import group_columns, stratum
from stratasift.operators.clean import clean
from stratasift.session import materialize


def stratum_stats(
    df: DataFrame, by: Iterable[str | int], value: str | int, on_bad: str = "drop"
) -> DataFrame:
    """Count, mean and population standard deviation of ``value`` per stratum.

    Columns: the group columns, ``mean``, ``std``, ``n``. Aggregates partially
    before the shuffle, so a hot stratum sends one row per map task.
    """
    groups = group_columns(df, by)
    rows = clean(df, groups, value, on_bad=on_bad)
    number = F.col(rows.columns[-1])
    return rows.groupBy(*groups).agg(
        F.avg(number).alias("mean"),
        F.stddev_pop(number).alias("std"),
        F.count(number).alias("n"),
    )


def sort_stats(stats: DataFrame, by: Iterable[str]) -> DataFrame:
    """Statistics in ascending stratum order (range-partitioned sort)."""
    groups = group_columns(stats, by)
    return stats.orderBy(stratum(groups), *groups)


def round_stats(stats: DataFrame, digits: int) -> DataFrame:
    """Mean and deviation rounded, so that later steps repeat on any engine."""
    return stats.withColumns(
        {c: F.round(F.col(c), digits) for c in ("mean", "std")}
    )


def merge_stats(stats: DataFrame, by: Iterable[str]) -> DataFrame:
    """Combine partial statistics: coarser strata, or the same strata of several days.

    The spread is taken around the merged mean, which keeps its digits where
    E[x^2] - E[x]^2 would cancel. Empty parts (n = 0) take no part.
    """
    groups = group_columns(stats, by)
    # Read twice below; the means must be the same both times, and the source be read once.
    parts = materialize(stats.where(F.col("n") > 0).select(*groups, "mean", "std", "n"))
    centre = parts.groupBy(*groups).agg(
        F.sum("n").alias("_n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"),
    )
    off = F.col("mean") - F.col("_mean")
    spread = F.sum(F.col("n") * (F.col("std") * F.col("std") + off * off))
    return (
        parts.join(centre, groups)
        .groupBy(*groups, "_mean", "_n")
        .agg(spread.alias("_m2"))
        .select(
            *groups,
            F.col("_mean").alias("mean"),
            F.sqrt(F.col("_m2") / F.col("_n")).alias("std"),
            F.col("_n").alias("n"),
        )
    )


def latest_stats(stats: DataFrame, by: Iterable[str], version: str) -> DataFrame:
    """The newest row of each stratum in an append-only statistics table.

    If a version holds a stratum twice, one of the two rows is taken whole.
    """
    groups = group_columns(stats, by)
    newest = stats.groupBy(*groups).agg(F.max(F.struct(version, "n", "mean", "std")).alias("_row"))
    return newest.select(*groups, *[F.col("_row")[c].alias(c) for c in ("mean", "std", "n", version)])
