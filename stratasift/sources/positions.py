"""Row ids from the places of rows in files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE, PLACE = "row_file", "row_place"
POSITION = [FILE, PLACE]


def place_in_partition() -> Column:
    """A number that no other row has; the same in every attempt of a task."""
    return F.monotonically_increasing_id()


def with_position(df: DataFrame) -> DataFrame:
    """Add ``row_file`` and ``row_place``, which together identify a row, without a shuffle.

    ``df`` comes straight from ``spark.read`` or ``spark.readStream`` over files. In Parquet
    files the place is the row's index in its file, so ids never change while the files do
    not. In text files it is the row's number in its task's input, which stays the same in
    retries but depends on how files are split; a stream of text files gets ``row_file``
    only, and its places batch by batch (``place`` of ``sample_writer``). Equal rows have
    different ids; no file, no rows.
    """
    if taken := sorted(set(POSITION).intersection(df.columns)):
        raise ValueError(f"rename the columns {taken}: positions have these names")
    named = F.col("_metadata.file_path").alias(FILE)
    try:
        return df.select("*", named, F.col("_metadata.row_index").alias(PLACE))
    except AnalysisException:
        if df.isStreaming:
            return df.select("*", named)
        return df.select("*", named, place_in_partition().alias(PLACE))
