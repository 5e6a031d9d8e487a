"""Packing of tokenized documents into sequences of a fixed length, by sums of squares.

Open sequences are known by their gap, the tokens they have left. N(g) is the number of open
sequences of gap g. A piece of s tokens goes to the open sequence for which the sum of all
N(g)^2, after the move, is smallest: gaps stay varied, so that later pieces find one that
they fill to the end. Ties go to the smaller gap. Pieces come longest first, and a sequence
is begun only where no open one has room; the rule for pieces in unknown order would also
begin one wherever that makes the sum smaller, which takes one per cent more sequences here.

Documents longer than a sequence are cut; all their pieces but the first are full and need
no packing. The others are dealt evenly to groups of a bounded number, each packed by a task.
Sequences that came out full are done. The pieces of the others are dealt anew, to fewer
groups as they are fewer, until one group holds them or a round leaves nearly as many as it
found: the loss by grouping shrinks to that of the last, small round.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.llm.common import map_arrow, map_slices, stored, text_input
from stratasift.llm.token_files import encoder

LENGTH = 1024
#: Pieces that a task packs together.
GROUP = 16_384
#: Another round is worth while if it has at most this share of the last one's pieces.
SHRINKS = 0.7
#: Bits of a sequence's number below its round's.
ROUND_BITS = 57


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, and the gap left in each sequence.

    ``lengths`` are from 1 to ``capacity``.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)  # N(g); a full sequence is not open
    waiting: dict[int, list[int]] = defaultdict(list)
    gaps: list[int] = []
    sequence = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        room = np.flatnonzero(counts[s:])  # gaps of open sequences, less s: the gaps they would get
        if len(room):
            # N(g) falls by one and, unless the sequence is filled, N(g - s) grows by one
            change = 1 - 2 * counts[room + s] + np.where(room > 0, 1 + 2 * counts[room], 0)
            gap = int(room[change.argmin()]) + s
            at = waiting[gap].pop()
            counts[gap] -= 1
        else:
            at, gap = len(gaps), capacity
            gaps.append(capacity)
        sequence[i], offset[i] = at, capacity - gap
        gaps[at] = gap - s
        if gap > s:
            counts[gap - s] += 1
            waiting[gap - s].append(at)
    return sequence, offset, np.array(gaps, dtype=np.int64)


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = LENGTH,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    ids: bool = False,
) -> DataFrame:
    """Every document's ids, ``end_id`` behind them, cut into pieces of at most ``length``.

    Columns: key, piece, start, length, ids_crc32 and, if ``ids``, the ids as little-endian
    unsigned 32-bit integers. Only the first piece of a document may be shorter.
    """
    if length < 1:
        raise ValueError("a sequence holds at least one token")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found, counts = encoder(definition.value).flat(part.column("text"))
        tokens = np.insert(found, np.cumsum(counts), end_id).astype("<u4")
        total = counts + 1
        number = -(-total // length)
        doc = np.repeat(np.arange(len(part)), number)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
        head = (total - length * (number - 1))[doc]
        start = np.where(piece > 0, head + length * (piece - 1), 0)
        size = np.where(piece > 0, length, head)
        raw = memoryview(tokens.tobytes())
        begin = 4 * (start + (np.cumsum(total) - total)[doc])
        spans = [raw[a:b] for a, b in zip(begin.tolist(), (begin + 4 * size).tolist())]
        columns = {
            "key": part.column("key").take(pa.array(doc)),
            "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(size, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(s) for s in spans], pa.int64()),
        }
        if ids:
            columns["ids"] = pa.array([bytes(s) for s in spans], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    rows = text_input(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return map_slices(rows, work, schema, limit=2 << 20).withColumnRenamed("key", key)


def _packed(rows: DataFrame, length: int, groups: int, number: int) -> DataFrame:
    """The pieces dealt to groups and packed: sequence_id, offset, and the sequence's gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        sequence, offset, gaps = pack(table.column("length").to_numpy(), length)
        first = (number << ROUND_BITS) + (TaskContext.get().partitionId() << 33)
        table = table.append_column("sequence_id", pa.array(first + sequence))
        table = table.append_column("offset", pa.array(offset)).append_column("gap", pa.array(gaps[sequence]))
        yield from table.to_batches(max_chunksize=4096)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartition(groups)  # evenly, whatever the keys are
    return map_arrow(dealt, run, f"{fields}, sequence_id long, offset long, gap long")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = LENGTH,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    ids: bool = False,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: the columns of :func:`pieces`, sequence_id and offset.

    Pieces of a sequence lie one behind the other from offset 0 and take at most ``length``
    tokens; numbers of sequences are unique but not dense. Null and empty texts have only the
    end id. Repeated rows, equal and null keys are packed like any others, as pieces are dealt
    out by number, not by key. An empty table gives no rows; only the key and these columns
    are returned. The pieces and each round's result are written to the shared folder.
    """
    cut = stored(pieces(docs, tokenizer_path, length, end_id, key, text, ids), "pieces")
    whole = cut.where(F.col("length") == length)
    out = whole.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    left, number = cut.where(F.col("length") < length), 1
    rows = left.count()
    while rows:
        groups = -(-rows // group)
        done = stored(_packed(left, length, groups, number), f"packed-{number}")
        unfilled = done.where("gap > 0")
        again = unfilled.count() if groups > 1 else 0
        if groups == 1 or again > SHRINKS * rows:
            out = out.unionByName(done.drop("gap"))
            break
        out = out.unionByName(done.where("gap = 0").drop("gap"))
        left, rows, number = unfilled.drop("sequence_id", "offset", "gap"), again, number + 1
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of the result of :func:`pack_documents` with ``ids=True``.

    A sequence has at most as many pieces as tokens, so no group is large.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
