"""Seeded priorities: the randomness of every sample.

A row's priority depends only on the seed and the row's id, so retries, another
partitioning or another input order cannot change a sample, and the smallest k
priorities of a stratum are a uniform k-subset of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priorities are integers in [0, 2^52), exact as doubles too.
SPAN = 1 << 52


def priority(seed: int, ids: list[str], hasher: str = "xxhash64") -> Column:
    """A 52-bit integer drawn from the seed and the id columns.

    ``xxhash64`` takes the upper bits of Spark's own 64-bit hash. ``md5`` takes the
    first 13 hex digits of md5('seed:id1:id2...'), which any SQL engine can
    recompute, at about ten times the cost.
    """
    if hasher == "md5":
        text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    if hasher == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in ids]), 12)
    raise ValueError(f"unknown hasher {hasher!r}")
