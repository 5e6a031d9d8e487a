"""Fingerprints of improbable features.

Every window of 32 bytes has an entropy. How often each entropy occurs over all texts of the
corpus ranks the windows: the rarer, the better. A window is selected if it is the best of
at least ``POPULAR`` of the 32 neighbourhoods of 32 windows it lies in. The selected
windows' hashes go into a chain of Bloom filters of 2,048 bits, a new filter after every
``PER_FILTER`` features. Two fingerprints are compared filter by filter by the bits they
share beyond what chance gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.llm.common import map_arrow, map_slices, mix, raw_text, slices, text_input

WINDOW, POPULAR, PER_FILTER, BITS, HASHES = 32, 8, 160, 2048, 5
#: Entropy is measured in whole steps: bins 0 ... LEVELS.
LEVELS = 1000
#: Windows of nearly one repeated byte say nothing about a text.
LEAST_LEVEL = 100

_COUNT = np.arange(WINDOW + 2, dtype=np.float64)
#: n * log2(n) in whole units, so that sums do not depend on the order of adding.
_TERM = np.round(_COUNT * np.log2(np.maximum(_COUNT, 1)) * 4096).astype(np.int32)
_MOST = int(_TERM[WINDOW])
_NONE = 1 << 20


def window_levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of every window of ``data``; one less than a window has no windows."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int32)
    # equal bytes in the windows that end and that start at each byte
    before, after = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = _TERM[np.bincount(data[:WINDOW], minlength=256)].sum()
    # a byte leaves: its count c falls to c - 1; then a byte comes: its count rises
    leaves = after[: n - WINDOW] + 1
    comes = before[WINDOW:]
    change = _TERM[leaves - 1] - _TERM[leaves] + _TERM[comes + 1] - _TERM[comes]
    total = np.empty(n - WINDOW + 1, dtype=np.int64)
    total[0] = first
    np.cumsum(change, out=total[1:])
    total[1:] += first
    return ((_MOST - total) * LEVELS // _MOST).astype(np.int32)


def _pieces(array: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Runs of whole texts of about ``limit`` bytes: (bytes, offsets, place of the first)."""
    data, offsets = raw_text(array)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at
        at = to


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which windows of joined texts lie in one text."""
    ok = np.ones(n, dtype=bool)
    for edge in offsets[1:-1]:
        ok[max(0, edge - WINDOW + 1) : edge] = False
    return ok


def level_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(level, n): how many windows of all texts have each entropy level."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(LEVELS + 1, dtype=np.int64)
        for data, offsets, _ in _pieces(part.column("text")):
            levels = window_levels(data)
            total += np.bincount(levels[_inside(offsets, len(levels))], minlength=LEVELS + 1)
        seen = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["level", "n"])

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return map_slices(rows, count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))


def rank_table(counts: DataFrame) -> np.ndarray:
    """Rank of each level, the rarest first (at most LEVELS + 1 rows come to the driver)."""
    n = np.zeros(LEVELS + 1, dtype=np.int64)
    for row in counts.collect():
        n[row["level"]] = row["n"]
    ranks = np.empty(LEVELS + 1, dtype=np.int32)
    ranks[np.lexsort((np.arange(LEVELS + 1), n))] = np.arange(LEVELS + 1)
    ranks[:LEAST_LEVEL] = _NONE
    return ranks


def select_windows(ranks: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Starts of the windows that win at least POPULAR neighbourhoods (leftmost of equals).

    Only neighbourhoods inside one text count.
    """
    n, w = len(ranks), WINDOW
    if n < w:
        return np.zeros(0, np.int64)
    size = -(-n // w) * w
    key = np.full(size, np.int64(_NONE) << 32, dtype=np.int64)
    key[:n] = np.where(ok, ranks, _NONE).astype(np.int64) << 32 | np.arange(n)
    blocks = key.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    best = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    outside = np.concatenate([[0], np.cumsum(~ok)])
    best = best[(best >> 32 < _NONE) & (outside[w:] == outside[:-w])] & 0xFFFFFFFF
    wins = np.bincount(best, minlength=n)
    return np.flatnonzero(wins >= POPULAR)


def feature_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the window at each start."""
    h = np.full(len(starts), np.uint64(0x2545F4914F6CDD1D))
    if not len(starts):
        return h
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[starts]
    for word in np.ascontiguousarray(windows).view("<u8").T:
        h = mix(h ^ word)
    return h


def _short_hash(text: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.sha1(text).digest()[:8], "<u8")


def filters_of(hashes: np.ndarray, place: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters of many texts: (bits per filter, first filter of each text)."""
    counts = np.bincount(place, minlength=n_texts)
    chains = -(-counts // PER_FILTER)
    first = np.concatenate([[0], np.cumsum(chains)])
    starts = np.concatenate([[0], np.cumsum(counts)])
    number = first[place] + (np.arange(len(place)) - starts[place]) // PER_FILTER
    bits = np.zeros((first[-1], BITS), dtype=np.uint8)
    for i in range(HASHES):
        bits[number, ((hashes >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1), first


def fingerprints(array: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, one row of 256 bytes each; an empty text has none.

    A text shorter than a window is one feature; one without a winning window gives its rarest.
    """
    out: list[np.ndarray] = []
    for data, offsets, _ in _pieces(array):
        n_texts = len(offsets) - 1
        levels = window_levels(data)
        ok = _inside(offsets, len(levels))
        rank = ranks[levels] if len(levels) else levels
        starts = select_windows(rank, ok)
        place = np.searchsorted(offsets, starts, "right") - 1
        hashes = feature_hashes(data, starts)
        have = np.bincount(place, minlength=n_texts)
        more_place, more = [], []
        for t in np.flatnonzero((have == 0) & (np.diff(offsets) > 0)):
            a, b = offsets[t], offsets[t + 1]
            if b - a < WINDOW:
                more.append(_short_hash(data[a:b].tobytes()))
            else:
                best = a + int(np.argmin(rank[a : b - WINDOW + 1]))
                more.append(feature_hashes(data, np.array([best])))
            more_place.append(t)
        if more:
            place = np.concatenate([place, more_place])
            hashes = np.concatenate([hashes, *more])
            order = np.argsort(place, kind="stable")
            place, hashes = place[order], hashes[order]
        packed, first = filters_of(hashes, place, n_texts)
        out += [packed[first[t] : first[t + 1]] for t in range(n_texts)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean, over the shorter chain's filters, of the best bit overlap beyond chance, 0 to 1.

    Chance is what two filters of so many bits share when nothing is alike. Two empty
    fingerprints are alike (1), an empty one and another are not (0).
    """
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    wide_a, wide_b = np.ascontiguousarray(a).view("<u8"), np.ascontiguousarray(b).view("<u8")
    in_a, in_b = np.bitwise_count(wide_a).sum(1), np.bitwise_count(wide_b).sum(1).astype(np.float64)
    total = 0.0
    for row, n in zip(wide_a, in_a):
        shared = np.bitwise_count(row & wide_b).sum(1)
        chance = n * in_b / BITS
        most = np.minimum(n, in_b)
        total += float(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(a)


def to_text(filters: np.ndarray) -> str:
    """A fingerprint as text: the number of filters, then their bytes in base64."""
    return f"{len(filters)}:" + base64.b64encode(filters.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def digest(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint of each row's whole text (null: as empty)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [to_text(f) for f in fingerprints(part.column("text"), ranks)]
        return pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.string())], names=[key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return map_slices(text_input(docs, key, text), work, f"`{key}` {kind}, fingerprint string")


# ---- each document beside its successor ----------------------------------------------------


def in_ranges(docs: DataFrame, key: str, rows_per_range: int) -> tuple[DataFrame, int]:
    """Rows with ``tie`` and ``range``: ranges of (key, tie) ascending, and how many there are.

    ``tie`` is a hash of the text from 0 to below 1; null keys come first. The borders are
    percentiles, at most 10,000 (larger inputs have larger ranges, which are sorted on disk
    and read as a stream), of a number that grows with key and tie: integers plus the tie.
    A key of very many different texts so fills several ranges, as long as it is below 2^50.
    """
    from pyspark.ml.feature import Bucketizer

    whole = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    tie = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    known = F.col(key).cast("double") + (F.col("tie") if whole else F.lit(0.0))
    placed = docs.withColumn("tie", tie).withColumn("at", F.coalesce(known, -1e300 * (2 - F.col("tie"))))
    n = docs.count()
    many = max(1, min(10_000, -(-n // rows_per_range)))
    shares = [i / many for i in range(1, many)]
    borders = placed.agg(F.percentile_approx("at", shares, 100_000)).first()[0] if shares else []
    borders = sorted(set(borders or []))
    if not borders:
        return placed.withColumn("range", F.lit(0)).drop("at"), 1
    cut = Bucketizer(splits=[-float("inf"), *borders, float("inf")], inputCol="at", outputCol="_range")
    ranged = cut.transform(placed).withColumn("range", F.col("_range").cast("int"))
    return ranged.drop("at", "_range"), len(borders) + 1


def digest_report(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_range: int = 2000) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next document's, in ascending order of key (nulls first, equal keys by a hash
    of the text, then by text); after the last comes the first. A single document is its own
    successor. The key is a number, or text of one.

    Rows are dealt by ranges of key and hash and sorted in their range. The first row of each
    range is also sent to the range before it, so that no row needs another task.
    """
    rows = text_input(docs, key, text)
    ranks = rank_table(level_counts(rows))
    ranged, many = in_ranges(rows, "key", rows_per_range)
    least = F.min(F.struct(F.col("key").isNotNull().alias("known"), "key", "tie")).alias("low")
    lows = sorted((r["range"], r["low"]["key"], r["low"]["tie"]) for r in ranged.groupBy("range").agg(least).collect())
    spark = docs.sparkSession
    # the range before each, in a circle; borders of ranges without rows are skipped
    to = {row[0]: lows[i - 1][0] for i, row in enumerate(lows)}
    kind = rows.schema["key"].dataType.simpleString()
    firsts = spark.createDataFrame([(*row, to[row[0]]) for row in lows], f"range int, low {kind}, low_tie double, to int")
    heads = (
        ranged.join(F.broadcast(firsts), "range")
        .where(F.col("key").eqNullSafe(F.col("low")) & (F.col("tie") == F.col("low_tie")))
        .groupBy("range", "to", "key", "tie")
        .agg(F.min("text").alias("text"))
    )
    columns = ["key", "tie", "text"]
    sent = heads.select(*columns, F.col("to").alias("range"), F.lit(True).alias("guest"))
    both = ranged.select(*columns, "range", F.lit(False).alias("guest")).unionByName(sent)
    dealt = both.repartitionById(many, F.col("range")).sortWithinPartitions("range", "guest", *columns)
    dealt = dealt.drop("tie")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                table = pa.Table.from_batches([part])
                held = table if held is None else pa.concat_tables([held, table])
                if held.num_rows > 1:
                    yield _beside(held.combine_chunks().to_batches()[0], key, ranks)
                    held = held.slice(held.num_rows - 1)

    schema = (
        f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return map_arrow(dealt, work, schema)


def _beside(rows: pa.RecordBatch, key: str, ranks: np.ndarray) -> pa.RecordBatch:
    """Results of all rows but the last, and none for guests; each row's next is its successor."""
    texts = rows.column("text").to_pylist()
    guest = rows.column("guest").to_pylist()
    edited = []
    for a, b in zip(texts, texts[1:]):
        half = len(a) // 2
        edited.append(a[: len(a) - half] + b[:half])
    own = fingerprints(rows.column("text"), ranks)
    new = fingerprints(pa.array(edited, pa.string()), ranks)
    keep = [i for i in range(len(edited)) if not guest[i]]
    return pa.RecordBatch.from_arrays(
        [
            rows.column("key").take(pa.array(keep, pa.int64())),
            pa.array([len(texts[i]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
            pa.array([to_text(own[i]) for i in keep], pa.string()),
            pa.array([to_text(new[i]) for i in keep], pa.string()),
            pa.array([likeness(own[i], new[i]) for i in keep], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in keep], pa.float64()),
        ],
        names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
