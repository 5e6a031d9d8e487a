"""Reading tables, batches of text in tasks, shared folders, vectorised word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.session import checkpoint_dir

SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between executor and worker. Spark's own limit is 64 MB, and its
#: buffers double as they grow: every task may take several times that beside the heap.
BATCH_BYTES = 8 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_stratasift_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="stratasift-code-")) / "stratasift_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._stratasift_shipped = True


def release() -> None:
    """Give freed memory back to the system.

    A worker lives on after its task; what glibc and Arrow keep for it counts as used in all
    later stages, beside their own.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of BATCH_BYTES, or of what the session sets; tasks leave no
    freed memory behind. Also for columns with dots in their names, which it cannot resolve."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set(BATCH_LIMIT, spark.conf.get(BATCH_LIMIT, f"{BATCH_BYTES}b"))
    names = df.columns
    dotted = any("." in c for c in names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if dotted:
            batches = (pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)
        try:
            yield from run(batches)
        finally:
            release()

    return (df.toDF(*[f"c{i}" for i in range(len(names))]) if dotted else df).mapInArrow(task, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again: survives lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo; a null counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def text_input(df: DataFrame, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Key and text under fixed names; null texts as empty, other columns left behind."""
    filled = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{key}`").alias("key"), filled.alias("text"), *more)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """The batch in runs of rows of about ``limit`` bytes of text; one long text stands alone."""
    array = batch.column(column)
    if not len(array):
        return
    ends = np.cumsum(np.asarray(pc.binary_length(array).fill_null(0), dtype=np.int64))
    at, done = 0, 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def map_slices(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    column: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``work`` over every slice of the rows, inside ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield work(part)

    return map_arrow(df, run, schema)


# ---- words and their hashes, without a Python object per word ------------------------------

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_SPAN = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.full(max(size, _SPAN + 4096), base, dtype=np.uint64)
        table[0] = 1
        np.cumprod(table, out=table)
        if len(table) <= 4 * _SPAN:
            _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw_text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; nulls have no bytes."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    n, at = len(array), array.offset
    _, places, data = array.buffers()
    offsets = np.frombuffer(places, kind)[at : at + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _byte_classes(separators: set[int]) -> np.ndarray:
    """Byte -> 0 for a separator, else a non-zero code with A-Z as a-z."""
    table = np.arange(1, 257).astype(np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    for b in separators:
        table[b] = 0
    return table


#: Words as runs without ASCII blanks, A-Z lower-cased.
BLANKS = _byte_classes({0x20, *range(0x09, 0x0E)})
#: Words as runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased.
ALNUM = _byte_classes({b for b in range(128) if not chr(b).isalnum()})


def hash_spans(codes: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; ``first`` and ``after`` ascend."""
    hashes = np.empty(len(first), dtype=np.uint64)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(after, first[a] + _SPAN, "right")))
        low, high = first[a], after[b - 1]
        up, down = _power_table(_ODD, high - low + 1), _power_table(_INVERSE, high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(codes[low:high].astype(np.uint64) * up[: high - low], out=sums[1:])
        hashes[a:b] = (sums[after[a:b] - low] - sums[first[a:b] - low]) * down[first[a:b] - low]
        a = b
    return mix(hashes)


def words_of(array: pa.Array, classes: np.ndarray):
    """All words of all texts: (text's place, hash, first byte, byte after the last).

    The hash of a word depends on its bytes only, in every task and on every machine.
    """
    data, offsets = raw_text(array)
    codes = classes[data]
    inside = codes != 0
    edge = np.zeros(len(codes) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(begins)
    after = np.flatnonzero(stops) + 1
    place = np.searchsorted(offsets, first, "right") - 1
    return place, hash_spans(codes, first, after), first, after


def shingles_of(place: np.ndarray, hashes: np.ndarray, n_texts: int, width: int = 5):
    """(text's place, hash) of every run of ``width`` words; shorter texts give one run of all."""
    counts = np.bincount(place, minlength=n_texts)
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    whole = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        whole[: max(0, n - j)] = whole[: max(0, n - j)] * factor + hashes[j:]
    room = starts[place + 1] - np.arange(n)
    out_place, out = place[room >= width], whole[room >= width]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        runs = []
        for t in short:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in hashes[starts[t] : starts[t + 1]]:
                    h = h * factor + x
                runs.append(h + np.uint64(counts[t]))
        out_place = np.concatenate([out_place, short])
        out = np.concatenate([out, np.array(runs, dtype=np.uint64)])
        order = np.argsort(out_place, kind="stable")
        out_place, out = out_place[order], out[order]
    return out_place, mix(out)
