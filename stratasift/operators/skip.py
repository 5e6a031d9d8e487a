"""Reservoirs per input partition: skip rows that can no longer enter a sample."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Send this module's code along with the tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PRUNE_ROWS = 100_000
FLUSH_ROWS = 400_000
HOLD_BYTES = 32 << 20


class Reservoirs:
    """The smallest ``size`` priorities of each stratum in one partition.

    A full stratum has a bar, its ``size``-th smallest priority so far; rows above
    the bar are skipped on one comparison. Rows at the bar stay, since equal
    priorities are ranked later by row id. When the rows held pass ``hold`` bytes, they
    are handed on and only their stratum, size and priority are kept, which raise the
    bars as before. When the rows so kept or held pass ``flush``, all are handed on and
    only the bars are kept: the bars stay valid, so memory is bounded, however wide the
    rows are, and the rows handed on still hold every row of the sample.
    """

    def __init__(
        self, columns: tuple[str, str, str], prune: int, flush: int, hold: int = HOLD_BYTES
    ):
        self.columns = columns
        self.prune_rows, self.flush_rows, self.hold_bytes = prune, flush, hold
        self.bars: dict[int, int] = {}
        self.held: list[pa.Table] = []
        self.bytes = 0
        self.sent = np.empty((3, 0), dtype=np.int64)  # of rows handed on
        self.rows = 0  # held, and those in sent

    def _numbers(self, table: pa.Table) -> np.ndarray:
        """Stratum, size and priority: a copy, which keeps no other column in memory."""
        return np.stack([table.column(c).to_numpy() for c in self.columns])

    def _all_numbers(self) -> np.ndarray:
        return np.concatenate([self.sent, *map(self._numbers, self.held)], axis=1)

    def add(self, batch: pa.RecordBatch) -> None:
        table = pa.Table.from_batches([batch])
        stratum, _, priority = self._numbers(table)
        strata, at = np.unique(stratum, return_inverse=True)
        top = np.iinfo(np.int64).max
        bars = np.array([self.bars.get(s, top) for s in strata.tolist()], dtype=np.int64)
        enters = priority <= bars[at]
        if enters.any():
            kept = table if enters.all() else table.filter(pa.array(enters))
            self.held.append(kept)
            self.rows += kept.num_rows
            self.bytes += kept.nbytes

    def prune(self) -> None:
        """Raise the bars and drop what they exclude."""
        if not self.rows:
            return
        stratum, size, priority = self._all_numbers()
        order = np.lexsort((priority, stratum))
        starts = np.flatnonzero(np.r_[True, np.diff(stratum[order]) != 0])
        lengths = np.diff(np.r_[starts, len(order)])
        for start, length in zip(starts.tolist(), lengths.tolist()):
            first = order[start]
            want = int(size[first])
            if length >= want:
                bar = int(priority[order[start + want - 1]])
                key = int(stratum[first])
                self.bars[key] = min(bar, self.bars.get(key, bar))
        top = np.iinfo(np.int64).max
        keys = stratum[order[starts]].tolist()
        bars = np.repeat(np.array([self.bars.get(k, top) for k in keys], dtype=np.int64), lengths)
        keep = np.zeros(len(order), dtype=bool)
        keep[order] = priority[order] <= bars
        at = self.sent.shape[1]
        self.sent = self.sent[:, keep[:at]]
        for i, table in enumerate(self.held):
            stays = keep[at : at + table.num_rows]
            at += table.num_rows
            if not stays.all():
                self.held[i] = table.filter(pa.array(stays))
        self.held = [table for table in self.held if table.num_rows]
        self.bytes = sum(table.nbytes for table in self.held)
        self.rows = int(keep.sum())

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        """The rows held; one table after the other leaves memory."""
        self.sent = self._all_numbers()
        self.bytes = 0
        while self.held:
            yield from self.held.pop(0).to_batches()

    def run(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pruned = 0  # rows that the last pruning left
        for batch in batches:
            self.add(batch)
            full = self.bytes > self.hold_bytes
            if self.rows >= max(0 if full else self.prune_rows, 2 * pruned):
                self.prune()
                pruned = self.rows
            if self.bytes > self.hold_bytes or pruned > self.flush_rows:
                yield from self.hand_on()
            if pruned > self.flush_rows:
                self.sent = self.sent[:, :0].copy()
                self.rows = pruned = 0
        self.prune()
        yield from self.hand_on()


def prune_partitions(
    rows: DataFrame,
    stratum: str,
    size: str,
    priority: str,
    prune: int = PRUNE_ROWS,
    flush: int = FLUSH_ROWS,
) -> DataFrame:
    """Rows that can be among the ``size`` smallest priorities of their stratum.

    All three columns are integers; ``size`` is the same for all rows of a stratum.
    Nothing is shuffled.
    """
    columns = (stratum, size, priority)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Reservoirs(columns, prune, flush).run(batches)

    return rows.mapInArrow(run, rows.schema)
