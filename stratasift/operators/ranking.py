"""Global row numbers without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasift.session import materialize

SMALL_RANK = 20_000


def global_rank(
    df: DataFrame, order: list[Column], name: str, rows: int, small: int = SMALL_RANK
) -> DataFrame:
    """Add the 1-based position of each row in the total ``order``.

    ``rows`` is the counted size of ``df``. Up to ``small`` rows one task numbers
    them. Beyond, the rows are range-partitioned, numbered inside each partition
    and shifted by the sizes of the partitions before it.
    """
    if rows <= small:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint"))
    part = "_part"
    ranged = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(part, F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(part).orderBy(*order))
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(offsets), part)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop(part, "_inside", "_offset")
    )
