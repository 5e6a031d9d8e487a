"""Row ids for tables without one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.functions.columns import resolve_all

FEW_COPIES = 1_000
PIECE_COPIES = 100_000


def number_copies(
    df: DataFrame,
    columns: Iterable[str | int],
    name: str = "copy_no",
    few: int = FEW_COPIES,
    piece: int = PIECE_COPIES,
) -> DataFrame:
    """The chosen columns with equal rows numbered 1, 2, ...

    The columns and the number together are a unique id that does not depend on
    partitioning or order. Equal rows are counted before the shuffle and written
    out again after it, so a value with very many copies is no hot key. Rows with
    more than ``few`` copies are cut in pieces that are dealt to a fixed number of
    partitions; adaptive execution, which sees only the small pieces, could put all
    of them in one task.
    """
    names = resolve_all(df, columns)
    spark = df.sparkSession
    partitions = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    counted = df.groupBy(*names).agg(F.count("*").alias("_copies"))
    first, one = F.col("_first"), F.lit(1).cast("bigint")

    in_place = counted.where(F.col("_copies") <= few).select(
        *names, F.explode(F.sequence(one, F.col("_copies"))).alias(name)
    )
    starts = F.sequence(one, F.col("_copies"), F.lit(piece).cast("bigint"))
    pieces = (
        counted.where(F.col("_copies") > few)
        .select(*names, "_copies", F.explode(starts).alias("_first"))
        .repartition(partitions, *names, "_first")
    )
    last = F.least(F.col("_copies"), first + (piece - 1))
    dealt = pieces.select(*names, F.explode(F.sequence(first, last)).alias(name))
    return in_place.unionByName(dealt)
