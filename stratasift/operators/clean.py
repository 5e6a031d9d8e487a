"""From raw rows to (group columns, numeric value) tuples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.functions.columns import filled, resolve, resolve_all


def project(df: DataFrame, columns: Iterable[str | int]) -> DataFrame:
    """Keep columns given by name or 1-based position, in the listed order."""
    return df.select(*resolve_all(df, columns))


def _complete(df: DataFrame, names: list[str]):
    kept = F.lit(True)
    for name in names:
        kept = kept & filled(df, name)
    return kept


def clean(
    df: DataFrame,
    by: Iterable[str | int],
    value: str | int,
    keep: Iterable[str | int] = (),
    on_bad: str = "drop",
) -> DataFrame:
    """Group columns, the value as double, and any columns to keep.

    Rows with an empty group field or an empty value are dropped. A value that is
    text but no number is dropped (``on_bad='drop'``) or fails the query
    (``'fail'``); :func:`rejected` lists such rows.
    """
    if on_bad not in ("drop", "fail"):
        raise ValueError(f"on_bad must be 'drop' or 'fail', not {on_bad!r}")
    groups = resolve_all(df, by)
    name = resolve(df, value)
    if name in groups:
        raise ValueError(f"{name} is both the value and a group column")
    extra = [resolve(df, c) for c in keep]
    number = F.col(name).try_cast("double")
    if on_bad == "fail":
        message = F.concat(F.lit(f"{name} is not a number: "), F.col(name).cast("string"))
        number = F.when(number.isNotNull(), number).otherwise(F.raise_error(message).cast("double"))
    picked = [c for c in dict.fromkeys([*groups, *extra]) if c != name]
    rows = df.where(_complete(df, [*groups, name])).select(*picked, number.alias(name))
    return rows.where(F.col(name).isNotNull())


def rejected(df: DataFrame, by: Iterable[str | int], value: str | int) -> DataFrame:
    """Complete rows whose value is not a number."""
    groups = resolve_all(df, by)
    name = resolve(df, value)
    return df.where(_complete(df, [*groups, name]) & F.col(name).try_cast("double").isNull())
