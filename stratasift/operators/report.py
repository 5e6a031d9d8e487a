"""Sample statistics beside stratum statistics, as tables and as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasift.functions.columns import FIGURES, group_columns, resolve, stratum
from stratasift.operators.ranking import global_rank
from stratasift.session import materialize

CHUNK_ROWS = 10_000


def steady_mean(number: Column) -> Column:
    """Aggregate: the mean of doubles, hardly touched by the order in which they are added.

    Whole parts add up exactly (below 2^53 in all) and fractions lose next to nothing, so the
    mean of decimal amounts does not move across a rounding border with the partitioning.
    """
    whole = F.rint(number)
    small = F.abs(number) < float(1 << 52)  # false for NaN and infinities
    fraction = F.when(small, number - whole).when(number.isNotNull(), 0.0)
    return (F.sum(whole) + F.sum(fraction)) / F.count(number)


def sample_stats(sample: DataFrame, by: Iterable[str], value: str) -> DataFrame:
    """Size, mean and population standard deviation of each stratum's sample."""
    name = resolve(sample, value)
    number = F.col(name)
    mean = steady_mean if sample.schema[name].dataType.typeName() == "double" else F.avg
    return sample.groupBy(*group_columns(sample, by)).agg(
        F.count(number).alias("sample_n"),
        mean(number).alias("sample_mean"),
        F.stddev_pop(number).alias("sample_std"),
    )


def sample_report(
    sample: DataFrame, allocation: DataFrame, by: Iterable[str], value: str
) -> DataFrame:
    """One row per sampled stratum: its statistics, its size, its sample's statistics.

    ``n`` is the count the allocation was made from, also if the data changed since.
    """
    groups = group_columns(sample, by)
    drawn = sample_stats(sample, groups, value)
    return allocation.join(drawn, groups).select(*groups, *FIGURES)


def nested_report(
    sample: DataFrame,
    allocation: DataFrame,
    by: Iterable[str],
    value: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """:func:`sample_report` with the sampled values as arrays.

    A stratum's values in ascending order are cut into arrays of ``chunk_rows``, one
    row per array: ``chunk`` counts 0, 1, ... and a row's values are at most as many.
    """
    groups = group_columns(sample, by)
    values = sample.select(*groups, F.col(value).cast("double").alias("value"))
    order = [*map(F.col, groups), F.col("value")]
    ranked = materialize(global_rank(values, order, "_at", sample.count()))
    starts = ranked.groupBy(*groups).agg(F.min("_at").alias("_from"))
    place = (F.col("_at") - F.col("_from")) / chunk_rows
    chunks = (
        ranked.join(starts, groups)
        .groupBy(*groups, F.floor(place).cast("bigint").alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("value"))).alias("sample"))
    )
    return sample_report(sample, allocation, groups, value).join(chunks, groups)


def _text(number: Column, digits: int | None) -> Column:
    if digits is not None:
        number = number.cast(f"decimal(38,{digits})")
    return number.cast("string")


def report_lines(
    sample: DataFrame,
    report: DataFrame,
    by: Iterable[str],
    value: str,
    ids: Iterable[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """The report as sorted text lines: ``stratum``, ``part``, ``line``.

    Each stratum has a header (part 0), one line per sampled row (part 1, in order
    of ``ids``) and an empty line (part 2). One line is one row, so no stratum
    needs to fit in one string. ``digits`` fixes the decimals of real numbers.
    """
    groups = group_columns(sample, by)
    keys = [resolve(sample, c) for c in ids]
    reals = ["mean", "std", "sample_mean", "sample_std"]
    figures = [
        _text(F.col(c), digits if c in reals else None) for c in FIGURES
    ]
    header = F.concat(F.concat_ws(", ", stratum(groups), *figures), F.lit(", "))
    record = F.concat_ws(
        ", ", *[F.col(c).cast("string") for c in groups], _text(F.col(value), digits)
    )
    places = [f"_g{i}" for i in range(len(groups))]

    def part(rows: DataFrame, number: int, line: Column, at: Column) -> DataFrame:
        shown = [F.col(c).alias(p) for c, p in zip(groups, places)]
        return rows.select(
            stratum(groups).alias("stratum"), *shown,
            F.lit(number).alias("part"), at.alias("_at"), line.alias("line"),
        )

    order = F.struct(*[F.col(c) for c in keys or [resolve(sample, value)]])
    records = part(sample, 1, record, order)
    nowhere = F.lit(None).cast(records.schema["_at"].dataType)
    headers = part(report, 0, header, nowhere)
    blanks = part(report, 2, F.lit(""), nowhere)
    return (
        headers.unionByName(records)
        .unionByName(blanks)
        .orderBy("stratum", *places, "part", "_at")
        .select("stratum", "part", "line")
    )
