"""Column names, ordinals and the stratum key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(df: DataFrame, column: str | int) -> str:
    """A column name, given by name or by 1-based position."""
    if isinstance(column, int):
        if not 1 <= column <= len(df.columns):
            raise ValueError(f"column {column} is not between 1 and {len(df.columns)}")
        return df.columns[column - 1]
    if column not in df.columns:
        raise ValueError(f"no column {column!r} among {df.columns}")
    return column


def resolve_all(df: DataFrame, columns: str | int | Iterable[str | int]) -> list[str]:
    """Column names in the listed order; at least one, none twice."""
    if isinstance(columns, (str, int)):
        columns = [columns]
    names = [resolve(df, c) for c in columns]
    if not names:
        raise ValueError("at least one group column is needed")
    if len(set(names)) != len(names):
        raise ValueError(f"group columns repeat: {names}")
    return names


# Names of result columns.
FIGURES = ["mean", "std", "n", "si", "sample_n", "sample_mean", "sample_std"]


def group_columns(df: DataFrame, columns: str | int | Iterable[str | int]) -> list[str]:
    """Names of group columns, which results show beside :data:`FIGURES`."""
    names = resolve_all(df, columns)
    taken = sorted({*FIGURES, "gamma", "share", "weight"}.intersection(names))
    if taken:
        raise ValueError(f"rename the group columns {taken}: results use these names")
    return names


def stratum(by: list[str]) -> Column:
    """The group values joined with ','; for display and ordering only.

    Joins and groupings use the columns themselves, since ('a,b', 'c') and
    ('a', 'b,c') give one and the same text.
    """
    return F.concat_ws(",", *[F.col(c).cast("string") for c in by])


def filled(df: DataFrame, column: str) -> Column:
    """True where the column is neither NULL nor, for text, empty."""
    present = F.col(column).isNotNull()
    if isinstance(df.schema[column].dataType, (T.StringType, T.VarcharType, T.CharType)):
        present = present & (F.col(column) != "")
    return present
