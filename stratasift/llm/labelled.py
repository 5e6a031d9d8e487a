"""A bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_sample(labels: DataFrame, label: str, per_class: int, only: Column | None = None, key: str = "doc_id") -> DataFrame:
    """(key, label): at most ``per_class`` keys of each label 0 and 1, the least by hash.

    Rows without key or label, or outside ``only``, are left out; a key with both labels
    counts as 0. The result has at most 2 * ``per_class`` rows, so it can be broadcast.
    """
    one = _one_per_key(labels, label, only, key)
    parts = [
        one.where(F.col("label") == y).orderBy(F.xxhash64("key"), "key").limit(per_class) for y in (0, 1)
    ]
    return parts[0].unionAll(parts[1])


def class_totals(labels: DataFrame, label: str, only: Column | None = None, key: str = "doc_id") -> dict[int, int]:
    """How many keys of each label 0 and 1 ``label_sample`` draws from."""
    rows = _one_per_key(labels, label, only, key).groupBy("label").count().collect()
    return {0: 0, 1: 0} | {r["label"]: r["count"] for r in rows}


def _one_per_key(labels: DataFrame, label: str, only: Column | None, key: str) -> DataFrame:
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    if only is not None:
        rows = rows.where(only)
    return rows.groupBy(F.col(key).alias("key")).agg(F.min(F.col(label)).cast("int").alias("label"))
