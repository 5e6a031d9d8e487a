"""Text lines with their line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasift.operators.joins import BROADCAST_BYTES, table_bytes
from stratasift.session import materialize


def read_lines(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """``key`` (1, 2, ... without gaps, in file order) and ``value`` (the line).

    Files are split and read in parallel, once: the lines are kept in the checkpoint
    folder, as another reading may split them elsewhere. The lines of every split are
    counted; running sums of these counts give each split its first number, so no line
    moves. Files go by name, numbers in names by their value. ``header`` skips the first
    line of every file.
    """
    place = ["_file", "_start"]
    digits = F.regexp_extract_all("_file", F.lit(r"\d+|\D+"), F.lit(0))
    padded = F.transform(digits, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x))
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    lines = materialize(read)
    # One row per split. A file's header is the first line of its first split.
    splits = lines.groupBy(*place).agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    skipped = F.when(F.col("_start") == 0, 1).otherwise(0) if header else F.lit(0)
    earlier = W.orderBy(padded, *place).rowsBetween(W.unboundedPreceding, -1)
    kept = F.col("_lines") - skipped
    offsets = materialize(
        splits.select(
            *place,
            "_first",
            skipped.alias("_skipped"),
            F.coalesce(F.sum(kept).over(earlier), F.lit(0)).alias("_before"),
        )
    )
    size, skips = offsets.agg(table_bytes(offsets, place), F.sum("_skipped")).first()
    if size <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    inside = F.col("_id") - F.col("_first") + 1 - F.col("_skipped")
    numbered = lines.join(offsets, place).where(inside > 0)
    if numbered.count() != lines.count() - (skips or 0):
        raise RuntimeError("lines were lost while they were numbered")
    return numbered.select((F.col("_before") + inside).alias("key"), "value")
