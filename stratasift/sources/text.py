"""Reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_lines(lines: DataFrame, path: str) -> None:
    """Store the ``line`` column as text files; their names sort in report order."""
    lines.select("line").write.mode("overwrite").text(path)


def show_stats(stats: DataFrame) -> None:
    """Print every row of statistics or reports to standard output, tab-separated.

    Rows come partition by partition, so the driver holds one partition at a time.
    """
    print(*stats.columns, sep="\t")
    for row in stats.toLocalIterator():
        print(*row, sep="\t")


def console(stream: DataFrame, mode: str = "complete"):
    """A writer that prints every batch of a streaming result."""
    return stream.writeStream.format("console").outputMode(mode).option("truncate", "false")
