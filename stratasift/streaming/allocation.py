"""Sample sizes from statistics that arrive as a stream.

The newest statistics of every stratum are kept in a log of changes. When no statistics came
for a while they are taken for complete: sizes are worked out and committed as one version.
Later statistics lead to later versions; a version is there whole or not at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from stratasift.functions.columns import group_columns
from stratasift.operators.allocate import allocate
from stratasift.sources.stats_table import APPENDED, VERSION, versions, write_stats
from stratasift.streaming.changelog import NUMBER, append, describe, newest
from stratasift.streaming.quiet import await_idle
from stratasift.streaming.slots import read_latest


def latest_stats_writer(
    stream: DataFrame, by: Iterable[str], path: str, checkpoint: str, version: str | None = None
) -> DataStreamWriter:
    """A writer that keeps the newest statistics row of every stratum.

    ``stream`` has the group columns, ``mean``, ``std`` and ``n``, and may number its rows in
    the column ``version``; without one a later batch's row is the newer. A row of an older
    version than the one kept changes nothing. Of rows that tie, the largest (n, mean, std)
    is taken whole. Read them with :func:`stratasift.streaming.slots.read_latest`.
    """
    groups = group_columns(stream, by)
    number = [version] if version else []
    order = [F.col(c).desc() for c in [*number, "n", "mean", "std"]]

    def latest(rows: DataFrame) -> DataFrame:
        first = W.partitionBy(*groups).orderBy(*order)
        return rows.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")

    def fold(log: DataFrame) -> DataFrame:
        return newest(log, groups)

    def store(batch: DataFrame, at: int) -> None:
        spark = batch.sparkSession
        if at == 0:
            describe(spark, path, {"by": groups})
        found = latest(batch.select(*groups, "mean", "std", "n", *number))
        if version and at:
            known = read_latest(spark, path).select(*groups, F.col(version).alias("_known"))
            found = found.join(known, groups, "left").where(f"_known IS NULL OR `{version}` >= _known").drop("_known")
        append(found, path, at, fold)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)


def allocate_when_idle(
    spark: SparkSession,
    query: StreamingQuery,
    path: str,
    target: str,
    by: Iterable[str],
    budget: int,
    weights: DataFrame | Sequence[float] | None = None,
    cv: str = "signed",
    quiet_ms: int = 200,
    limit_s: float | None = None,
    after: float = 0.0,
) -> int:
    """Commit the sizes of the newest statistics once no more of them come; the version's number.

    ``query`` was started from :func:`latest_stats_writer` on ``path``. Call again, with the
    time of the last call as ``after``, for the next wave of statistics.
    """
    if not await_idle(query, quiet_ms, limit_s, after):
        raise TimeoutError("the statistics did not go quiet")
    groups = list(by)
    done = versions(spark, target)
    number = done[-1] + 1 if done else 0
    sizes = allocate(read_latest(spark, path).select(*groups, "mean", "std", "n"), groups, budget, weights, cv)
    if not write_stats(sizes, target, number):
        raise RuntimeError(f"another allocator committed version {number} under {target}")
    return number


def read_allocation(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The sizes of one committed version, the newest by default."""
    done = versions(spark, target)
    if not done or (version is not None and version not in done):
        raise FileNotFoundError(f"no such version of sizes under {target}")
    return spark.read.parquet(f"{target.rstrip('/')}/{APPENDED}{done[-1] if version is None else version}")


def allocation_stream(spark: SparkSession, target: str, like: DataFrame) -> DataFrame:
    """Committed versions as a stream, with the columns of ``like`` and their version.

    ``like`` has the group columns, ``mean``, ``std``, ``n`` and ``si``; the folder may be
    empty or absent as yet.
    """
    from stratasift.sources.versions import files

    fs, place = files(spark, target)
    fs.mkdirs(place)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields if f.name != VERSION)
    return spark.readStream.schema(f"{fields}, {VERSION} bigint").option("basePath", target).parquet(target)
