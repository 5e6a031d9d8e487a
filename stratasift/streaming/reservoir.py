"""The sample of a stream in keyed state, with sizes that arrive as a stream too.

Rows and allocations are two inputs of one stateful operator, keyed by stratum and salt (a
hot stratum is held by several tasks). Rows wait in a list until their stratum's allocation
comes and are released then; rows that come later go straight on. Whoever waits can be few:
no allocation can ask for more rows of a stratum than the whole budget, so of the waiting
rows only the ``budget`` smallest priorities are kept.

The state of a stratum that has its size holds priorities only. A row whose priority is not
below the largest one kept is no candidate and leaves no trace; the others are emitted and
their priorities appended to the state, which is cut to the smallest when it has doubled. So
a batch costs its candidates, and in all there are about ``si * (1 + ln(n / si))`` of them.
They go to a log of changes; the sample is the smallest of the log, by the newest sizes, and
equals the sample drawn from all rows at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from stratasift.functions.columns import resolve_all
from stratasift.functions.priority import SPAN, priority
from stratasift.operators.joins import attach, table_bytes
from stratasift.operators.sample import P, bucket_counts, bucketed, take_smallest
from stratasift.session import materialize
from stratasift.streaming.changelog import NUMBER, append, describe, description, read_log
from stratasift.streaming.idle import PROVIDER, ROCKSDB

# Send this module's code along with the tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SALT, SIZE, VERSION, ROW = "_salt", "_size", "_version", "_row"
#: Rows as text in the state and the log: every type comes back as it was.
AS_TEXT = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
#: Columns of both inputs behind the group columns and the salt.
INPUT = [P, SIZE, VERSION, ROW]
SLACK = 64


def smallest(found: pd.DataFrame, most: int) -> pd.DataFrame:
    """The rows of the ``most`` smallest priorities; rows that tie with the last are kept."""
    if len(found) <= most:
        return found
    if most <= 0:
        return found.iloc[:0]
    p = found["p"].to_numpy()
    return found[p <= np.partition(p, most - 1)[most - 1]]


class Reservoir(StatefulProcessor):
    """Candidates of one stratum and salt."""

    def __init__(self, columns: list[str], budget: int, revisable: bool, span: int):
        self.columns = columns
        self.budget = budget
        self.revisable = revisable
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        # size -1: no allocation yet; rows at or above the limit are no candidates
        self.about = handle.getValueState("about", "size bigint, version bigint, bar bigint, held bigint")
        self.waiting = handle.getListState("waiting", "p bigint, row string")
        self.kept = handle.getListState("kept", "p bigint")

    def _cut(self, state, names: list[str], most: int) -> tuple[int, int]:
        """Keep the smallest of a list; returns the new limit and how many are kept."""
        left = smallest(pd.DataFrame(list(state.get()), columns=names), most)
        state.put([tuple(r) for r in left.itertuples(index=False)])
        bar = int(left["p"].max()) + 1 if most and len(left) >= most else self.span if most else 0
        return bar, len(left)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, version, bar, held = self.about.get() if self.about.exists() else (-1, -1, self.span, 0)
        was_waiting = size < 0
        most = self.budget if was_waiting or self.revisable else size
        parts, pending = [], 0
        for frame in rows:
            # names that begin with an underscore do not reach the task
            frame = frame.set_axis([*self.columns, *INPUT], axis=1)
            sizes = frame[frame["_size"] >= 0]
            if len(sizes):
                newest = sizes.loc[sizes["_version"].idxmax()]
                # sizes that only grow cannot be met unless the whole budget was kept
                if int(newest["_version"]) > version:
                    version = int(newest["_version"])
                    size = int(newest["_size"]) if size < 0 or self.revisable else min(size, int(newest["_size"]))
            data = frame[(frame["_size"] < 0) & (frame["_p"] < bar)]
            if len(data):
                parts.append(pd.DataFrame({"p": data["_p"], "row": data["_row"]}))
                pending += len(data)
                if pending > 2 * most + 10_000:
                    parts = [smallest(pd.concat(parts), most)]
                    pending = len(parts[0])
        fresh = pd.concat(parts) if parts else pd.DataFrame({"p": [], "row": []})
        if size >= 0:
            most = self.budget if self.revisable else size
        fresh = smallest(fresh, most)
        if size < 0:
            if len(fresh):
                self.waiting.appendList(list(zip(fresh["p"].tolist(), fresh["row"].tolist())))
                held += len(fresh)
            if held > 2 * most + SLACK:
                bar, held = self._cut(self.waiting, ["p", "row"], most)
        else:
            if was_waiting:  # the allocation is here: release whoever waited
                if self.waiting.exists():
                    waited = pd.DataFrame(list(self.waiting.get()), columns=["p", "row"])
                    fresh = smallest(pd.concat([waited, fresh]) if len(fresh) else waited, most)
                    self.waiting.clear()
                held = 0
            if len(fresh):
                self.kept.appendList([(p,) for p in fresh["p"].astype("int64").tolist()])
                held += len(fresh)
                yield self._emitted(key, fresh)
            if held > 2 * most + SLACK:
                bar, held = self._cut(self.kept, ["p"], most)
            elif not most:
                bar = 0
        self.about.update((size, version, bar, held))

    def _emitted(self, key, found: pd.DataFrame) -> pd.DataFrame:
        out = {name: [value] * len(found) for name, value in zip(self.columns, key)}
        return pd.DataFrame(out | {"_p": found["p"].astype("int64").tolist(), "_row": found["row"].tolist()})

    def close(self) -> None:
        """The state's handles close with the task."""


def candidates(
    stream: DataFrame,
    allocations: DataFrame,
    by: Iterable[str],
    ids: Iterable[str],
    budget: int,
    seed: int = 0,
    hasher: str = "xxhash64",
    salts: int = 8,
    revisable: bool = False,
) -> DataFrame:
    """Rows that may be in the sample, as they become known: group columns, salt, ``_p``, ``_row``.

    ``allocations`` is a stream of the group columns, ``si`` and ``version``; rows of a
    stratum without one wait. A stratum's first size is final, a smaller one of a later
    version cuts it. With ``revisable`` sizes may also grow: the ``budget`` smallest rows of
    every stratum stay candidates. Group columns may not be null; see
    :func:`stratasift.operators.clean.clean`.
    """
    groups, keys = resolve_all(stream, by), resolve_all(stream, ids)
    if taken := sorted({SALT, P, SIZE, VERSION, ROW}.intersection(stream.columns)):
        raise ValueError(f"rename the columns {taken}: the sample is worked out with these names")
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"lists in state need {PROVIDER} = {ROCKSDB}")
    none = F.lit(-1).cast("bigint")
    rows = stream.select(
        *groups,
        F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int").alias(SALT),
        priority(seed, keys, hasher).alias(P),
        none.alias(SIZE),
        none.alias(VERSION),
        F.to_json(F.struct(*stream.columns), AS_TEXT).alias(ROW),
    )
    sizes = allocations.select(
        *[F.col(c).cast(stream.schema[c].dataType).alias(c) for c in groups],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(SALT),
        none.alias(P),
        F.col("si").cast("bigint").alias(SIZE),
        F.col("version").cast("bigint").alias(VERSION),
        F.lit(None).cast("string").alias(ROW),
    )
    fields = [T.StructField(c, stream.schema[c].dataType) for c in groups]
    fields += [T.StructField(SALT, T.IntegerType()), T.StructField(P, T.LongType()), T.StructField(ROW, T.StringType())]
    return (
        rows.unionByName(sizes)
        .groupBy(*groups, SALT)
        .transformWithStateInPandas(
            statefulProcessor=Reservoir([*groups, SALT], budget, revisable, SPAN),
            outputStructType=T.StructType(fields),
            outputMode="Append",
            timeMode="None",
        )
    )


def reservoir_writer(
    stream: DataFrame,
    allocations: DataFrame,
    by: Iterable[str],
    ids: Iterable[str],
    budget: int,
    path: str,
    checkpoint: str,
    seed: int = 0,
    hasher: str = "xxhash64",
    salts: int = 8,
    revisable: bool = False,
) -> DataStreamWriter:
    """A writer that logs the candidates of every batch; see :func:`candidates`.

    Read the sample with :func:`read_reservoir`.
    """
    groups, keys = resolve_all(stream, by), resolve_all(stream, ids)
    found = candidates(stream, allocations, groups, keys, budget, seed, hasher, salts, revisable)
    about = {"by": groups, "ids": keys, "schema": stream.schema.simpleString()}

    def fold(log: DataFrame) -> DataFrame:
        most = log.select(*groups).distinct().withColumn("si", F.lit(budget).cast("bigint"))
        return _smallest(log, most, groups, [ROW])

    def store(batch: DataFrame, number: int) -> None:
        if number == 0:
            describe(batch.sparkSession, path, about)
        append(batch.drop(SALT), path, number, fold)

    return found.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(store)


def _smallest(log: DataFrame, allocation: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """The ``si`` rows of smallest priority of every stratum of a log, by priority buckets."""
    columns = log.columns
    held = log.groupBy(*groups).agg(F.count("*").alias("_n"), (F.max(P) + 1).alias("_limit"))
    strata = materialize(
        allocation.where(F.col("si") > 0).select(*groups, F.col("si").cast("bigint").alias("_si")).join(held, groups)
    )
    size = strata.agg(table_bytes(strata, groups)).first()[0]
    found = materialize(bucketed(attach(log, strata, groups, P, size=size), F.col("_n")))
    return take_smallest(found, bucket_counts(found, groups), groups, order).select(*columns)


def read_reservoir(spark: SparkSession, path: str, allocation: DataFrame) -> DataFrame:
    """The sample of all rows so far by the sizes of ``allocation``, with the stream's columns."""
    about = description(spark, path)
    if about is None:
        raise FileNotFoundError(f"no batch result under {path}")
    log = read_log(spark, path).drop(NUMBER)
    kind = T._parse_datatype_string(about["schema"])
    rows = log.withColumn(ROW, F.from_json(ROW, kind, AS_TEXT))
    for c in about["ids"]:
        rows = rows.withColumn(f"_id_{c}", F.col(ROW)[c])
    drawn = _smallest(rows, allocation, about["by"], [f"_id_{c}" for c in about["ids"]])
    return drawn.select(f"{ROW}.*")
