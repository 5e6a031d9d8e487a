"""Floating-point division that gives inf and NaN instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def divide(a: Column, b: Column) -> Column:
    """``a / b`` on doubles as IEEE 754 has it; ANSI mode would raise on b = 0.

    Spark orders NaN above every number, so NaN is tested before the signs.
    """
    return (
        F.when(b != 0, a / b)
        .when(F.isnan(a) | (a == 0), F.lit(NAN))
        .when(a > 0, F.lit(INF))
        .when(a < 0, F.lit(-INF))
    )
