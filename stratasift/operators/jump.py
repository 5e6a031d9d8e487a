"""Stratified samples by jumping over rows: no priority per row.

A reservoir of k rows that has seen n is changed by one row in about n / k, and how many rows
lie between two changes can be drawn outright (Algorithm L). So a task that reads a stratum's
rows draws the position of the next row that enters, jumps there, and looks at no row
between. Work on random numbers is k * (1 + ln(n / k)) per stratum and task, not n.

Each input partition ends with a uniform sample of its rows per stratum and the number of rows
it has seen. Two such samples are merged exactly: how many of the k rows of the union come
from each side is hypergeometric in the rows seen, and which of a side's rows they are is
uniform. So every partition's sample is put in a random order, and the merge takes its first
rows, as many as the draw by counts says: every k-subset of the stratum is equally likely. The
counts are few, one per stratum and partition.

The sample depends on the seed and on how the input is partitioned; runs over the same
partitions repeat it. For samples that do not depend on partitions see
:func:`stratasift.operators.sample.draw_sample`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.functions.columns import resolve_all
from stratasift.operators.joins import attach, table_bytes
from stratasift.session import materialize

# Send this module's code along with the tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART, SEEN, PLACE, SID, SIZE = "_jpart", "_jseen", "_jplace", "_jsid", "_jsize"
INTERNAL = {PART, SEEN, PLACE, SID, SIZE, "_jspread", "_n", "_take"}


class Jumps:
    """Which positions of a sequence of unknown length enter a reservoir of ``size`` places."""

    def __init__(self, size: int, rng: np.random.Generator):
        self.size = size
        self.rng = rng
        self.seen = 0
        self.drawn = 0  # random numbers used, for tests and reports
        self.weight = 1.0
        self.next = size - 1
        if size:
            self._jump()

    def _unit(self) -> float:
        self.drawn += 1
        return 1.0 - self.rng.random()  # in (0, 1]

    def _jump(self) -> None:
        self.weight *= self._unit() ** (1.0 / self.size)
        if self.weight <= 0.0:
            self.next = np.iinfo(np.int64).max
            return
        gap = np.log(self._unit()) / np.log1p(-self.weight) if self.weight < 1.0 else 0.0
        self.next = int(min(self.next + np.floor(gap) + 1, 2.0**62))

    def take(self, rows: int) -> list[tuple[int, int]]:
        """(position, place) of each of the next ``rows`` rows that enters; a later one may
        take the same place."""
        start, end = self.seen, self.seen + rows
        self.seen = end
        out = [(i - start, i) for i in range(start, min(end, self.size))]
        while self.size and self.next < end:
            place = int(self.rng.integers(self.size))
            self.drawn += 1
            out.append((self.next - start, place))
            self._jump()
        return out


def partition_reservoirs(rows: DataFrame, sid: str, size: str, seed: int) -> DataFrame:
    """Per stratum and input partition a uniform sample in random order.

    ``sid`` numbers the strata and ``size`` tells the places. Adds the partition, how many
    rows of the stratum it has seen, and the row's place in the random order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        jumps: dict[int, Jumps] = {}
        kept: dict[int, list] = {}  # stratum -> places, each (number of a stored row)
        store: list[pa.RecordBatch] = []
        stored = 0
        for batch in batches:
            strata = batch.column(sid).to_numpy(zero_copy_only=False)
            sizes = batch.column(size).to_numpy(zero_copy_only=False)
            order = np.argsort(strata, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(strata[order]) != 0])) if len(order) else []
            chosen: list[int] = []
            for a, b in zip(heads, [*heads[1:], len(order)]):
                s = int(strata[order[a]])
                if s not in jumps:
                    rng = np.random.default_rng([seed, s & (2**63 - 1), part])
                    jumps[s] = Jumps(int(sizes[order[a]]), rng)
                    kept[s] = []
                places = kept[s]
                for at, place in jumps[s].take(int(b - a)):
                    number = stored + len(chosen)
                    chosen.append(int(order[a + at]))
                    if place < len(places):
                        places[place] = number
                    else:
                        places.append(number)
            if chosen:
                store.append(batch.take(pa.array(chosen)))
                stored += len(chosen)
            live = sum(map(len, kept.values()))
            if stored > 2 * live + 100_000:  # drop the rows that lost their place
                numbers = np.array([n for p in kept.values() for n in p], dtype=np.int64)
                table = pa.Table.from_batches(store).take(pa.array(numbers)).combine_chunks()
                store, stored, at = table.to_batches(), len(numbers), 0
                for s, p in kept.items():
                    kept[s] = list(range(at, at + len(p)))
                    at += len(p)
        if not stored:
            return
        numbers, place, seen = [], [], []
        for s, p in kept.items():
            order = jumps[s].rng.permutation(len(p))
            numbers += [p[i] for i in order]
            place += range(len(p))
            seen += [jumps[s].seen] * len(p)
        out = pa.Table.from_batches(store).take(pa.array(numbers, pa.int64()))
        out = out.append_column(PART, pa.array([part] * len(numbers), pa.int32()))
        out = out.append_column(SEEN, pa.array(seen, pa.int64())).append_column(PLACE, pa.array(place, pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, {PART} int, {SEEN} long, {PLACE} long")


def shares_of(seen: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``size`` rows drawn from all come from each part, by the parts' rows.

    Different numbers below the sum of all rows are drawn and counted by part, whatever the
    sum is; of a draw of more than half, what is left out is drawn.
    """
    total = int(seen.sum())
    wanted = min(size, total)
    few = min(wanted, total - wanted)
    picks = np.zeros(0, dtype=np.int64)
    while len(picks) < few:
        picks = np.unique(np.concatenate([picks, rng.integers(total, size=few - len(picks))]))
    counts = np.diff(np.searchsorted(picks, np.concatenate([[0], np.cumsum(seen)])))
    return counts if few == wanted else seen - counts


def _taken(counts: DataFrame, seed: int) -> DataFrame:
    """Rows to take from each (stratum, partition): one task per group of strata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, parts, seen, take = [], [], [], []
            for row in batch.to_pylist():
                each = sorted((p["part"], p["seen"]) for p in row["parts"])
                rng = np.random.default_rng([seed, row[SID] & (2**63 - 1), 2**31])
                held = np.array([n for _, n in each], dtype=np.int64)
                for (p, _), n in zip(each, shares_of(held, row[SIZE], rng).tolist()):
                    sids.append(row[SID])
                    parts.append(p)
                    take.append(n)
            yield pa.RecordBatch.from_pydict(
                {SID: pa.array(sids, pa.int64()), PART: pa.array(parts, pa.int32()), "_take": pa.array(take, pa.int64())}
            )

    listed = counts.groupBy(SID, SIZE).agg(
        F.collect_list(F.struct(F.col(PART).alias("part"), F.col(SEEN).alias("seen"))).alias("parts")
    )
    return listed.mapInArrow(run, f"{SID} long, {PART} int, _take long")


def draw_by_jumps(
    data: DataFrame, allocation: DataFrame, by: Iterable[str], seed: int = 0
) -> DataFrame:
    """``si`` rows of every stratum (all, where it has fewer), with the columns of ``data``.

    Rows need no id: equal rows are different rows. The data is read once; a partition's
    samples are written to the checkpoint folder, and of each the first rows of its random
    order are taken, as many as the merge asks for. Strata without an allocation are left out.
    """
    groups = resolve_all(data, by)
    columns = data.columns
    if taken := sorted(INTERNAL.intersection(columns)):
        raise ValueError(f"rename the columns {taken}: the sample is worked out with these names")
    strata = materialize(
        allocation.where(F.col("si") > 0).select(
            *groups, F.col("si").cast("bigint").alias(SIZE), F.col("n").alias("_n"),
            F.monotonically_increasing_id().alias(SID),
        )
    )
    size = strata.agg(table_bytes(strata, groups)).first()[0]
    keyed = data.withColumn("_jspread", F.monotonically_increasing_id())
    rows = attach(keyed, strata, groups, "_jspread", size=size).drop("_jspread", "_n")
    held = materialize(partition_reservoirs(rows, SID, SIZE, seed))
    wanted = _taken(held.select(SID, SIZE, PART, SEEN).distinct(), seed)
    drawn = held.join(wanted.where("_take > 0"), [SID, PART]).where(F.col(PLACE) < F.col("_take"))
    return drawn.select(*columns)
