"""Results of a stream that has gone quiet."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stratasift.functions.columns import resolve, resolve_all
from stratasift.operators.clean import clean
from stratasift.sources.stats_table import read_stats, versions, write_stats
from stratasift.sources.versions import exists
from stratasift.streaming.quiet import await_idle
from stratasift.streaming.sample import read_sample
from stratasift.streaming.slots import read_latest

# Send this module's code along with the tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PARTS = ["n", "mean", "m2"]
MERGE_ROWS = 50_000
FLUSH_ROWS = 500_000


def _summed(frame: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Partial statistics (n, mean, m2) of equal groups combined; NaN stays NaN."""
    grouped = frame.groupby(by, sort=False, dropna=False)
    at = grouped.ngroup().to_numpy()
    n = frame["n"].to_numpy(dtype=float)
    mean = frame["mean"].to_numpy(dtype=float)
    rows = np.bincount(at, weights=n)
    centre = np.bincount(at, weights=n * mean) / rows
    spread = np.bincount(at, weights=frame["m2"].to_numpy(dtype=float) + n * (mean - centre[at]) ** 2)
    out = frame.loc[~frame.duplicated(by), by].reset_index(drop=True)
    return out.assign(n=rows.astype("int64"), mean=centre, m2=spread)


def partial_stats(
    rows: DataFrame,
    by: list[str],
    value: str,
    merge_rows: int = MERGE_ROWS,
    flush_rows: int = FLUSH_ROWS,
) -> DataFrame:
    """Few (n, mean, m2) rows per group and input partition, with no shuffle."""
    fields = [rows.schema[c] for c in by]
    fields += [T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType())]
    fields += [T.StructField("m2", T.DoubleType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held, merge_at = [], 0, merge_rows
        for batch in batches:
            if batch.empty:
                continue
            single = batch[by].assign(n=1, mean=batch[value].astype(float), m2=0.0)
            parts.append(_summed(single, by))
            held += len(parts[-1])
            if held >= merge_at:
                total = _summed(pd.concat(parts), by)
                if len(total) > flush_rows:  # very many groups: hand them on
                    yield total
                    parts, held, merge_at = [], 0, merge_rows
                else:
                    parts, held = [total], len(total)
                    merge_at = max(merge_rows, 2 * held)
        if parts:
            yield _summed(pd.concat(parts), by)

    return rows.select(*by, value).mapInPandas(run, T.StructType(fields))


class IdleStats(StatefulProcessor):
    """Adds up a stratum and emits it once, when it got no row for ``timeout_ms``."""

    def __init__(self, by: list[str], timeout_ms: int):
        self.by = by
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "stats", "n bigint, mean double, m2 double, timer bigint, emitted boolean"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, emitted = None, False
        parts = [part[PARTS] for part in rows]
        if self.state.exists():
            n, mean, m2, timer, emitted = self.state.get()
            parts.append(pd.DataFrame({"n": [n], "mean": [mean], "m2": [m2]}))
        one = _summed(pd.concat(parts).assign(_one=0), ["_one"]).iloc[0]
        if timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        if not emitted:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(timer)
        self.state.update((int(one["n"]), float(one["mean"]), float(one["m2"]), timer, emitted))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, mean, m2, _, _ = self.state.get()
        self.state.update((n, mean, m2, None, True))
        row = dict(zip(self.by, key)) | {"mean": mean, "std": float(np.sqrt(m2 / n)), "n": n}
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def idle_stats(
    stream: DataFrame, by: Iterable[str | int], value: str | int, timeout_ms: int = 1000
) -> DataFrame:
    """Statistics of every stratum, each emitted once after ``timeout_ms`` without rows.

    Rows are added up per input partition first, so a hot stratum reaches its state
    as one row per partition and batch. Rows that come after a stratum was emitted
    count in its state but are not emitted. Write the result in ``update`` mode under
    a processing-time trigger. The gap is per stratum; for a gap of the whole stream, with
    built-in aggregates, see :func:`emit_when_idle`.
    """
    groups = resolve_all(stream, by)
    number = resolve(stream, value)
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"timers need {PROVIDER} = {ROCKSDB}")
    parts = partial_stats(clean(stream, groups, number), groups, number)
    fields = [parts.schema[c] for c in groups]
    fields += [T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())]
    fields += [T.StructField("n", T.LongType())]
    return parts.groupBy(*groups).transformWithStateInPandas(
        statefulProcessor=IdleStats(groups, timeout_ms),
        outputStructType=T.StructType(fields),
        outputMode="Update",
        timeMode="ProcessingTime",
    )


def sample_when_idle(
    spark: SparkSession,
    query: StreamingQuery,
    path: str,
    quiet_ms: int = 1000,
    limit_s: float | None = None,
) -> DataFrame:
    """The sample of a stream once the whole stream is quiet.

    ``query`` was started from :func:`stratasift.streaming.sample.sample_writer` on ``path``.
    """
    if not await_idle(query, quiet_ms, limit_s):
        raise TimeoutError("the stream did not go quiet")
    return read_sample(spark, path)


def publish_when_idle(
    spark: SparkSession,
    query: StreamingQuery,
    path: str,
    target: str,
    quiet_ms: int = 1000,
    limit_s: float | None = None,
) -> DataFrame:
    """Store a query's statistics in ``target`` once the whole stream is quiet.

    ``query`` was started from :func:`stratasift.streaming.stats.stats_writer` on
    ``path``. A stratum stays open while any stratum gets rows. Readers of the stored table
    go over from the old snapshot to the new one, whole; the sampling phase reads only that
    table.
    """
    if not await_idle(query, quiet_ms, limit_s):
        raise TimeoutError("the stream did not go quiet")
    result = read_latest(spark, path)
    if result.isEmpty():
        raise RuntimeError(f"the stream has no statistics; {target} stays as it is")
    write_stats(result, target)
    return read_stats(spark, target)


def emit_when_idle(
    spark: SparkSession,
    query: StreamingQuery,
    path: str,
    target: str,
    by: Iterable[str],
    quiet_ms: int = 1000,
    limit_s: float | None = None,
    after: float = 0.0,
) -> DataFrame:
    """Emit every stratum once, after the whole stream was quiet for ``quiet_ms``.

    ``query`` was started from :func:`stratasift.streaming.stats.stats_writer` on ``path``.
    The strata that ``target`` does not have yet are added to it as its next version; those
    it has are left as they were emitted, though rows that came since count in the log of the
    stream. Call again, with the time of the last call as ``after``, to emit the strata of
    later rows. Returns all that was emitted so far.
    """
    groups = list(by)
    if not await_idle(query, quiet_ms, limit_s, after):
        raise TimeoutError("the stream did not go quiet")
    found = read_latest(spark, path)
    number = 0
    if exists(spark, target) and (done := versions(spark, target)):
        number = done[-1] + 1
        found = found.join(read_stats(spark, target).select(*groups), groups, "left_anti")
    if number == 0 or not found.isEmpty():
        write_stats(found, target, number)
    return read_stats(spark, target).drop("version")
