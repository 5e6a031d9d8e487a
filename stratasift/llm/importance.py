"""Importance resampling: draw the rows whose word runs look most like a target table's.

Every run of one to three words of a text is a feature, hashed to a bucket. A bucket's gain
is the log ratio of its share in the target and in all rows (with one added to each count);
a text's weight is the sum of its features' gains, and the rows with the largest weight plus
Gumbel noise are drawn, which samples without replacement in proportion to exp(weight).

Corpora repeat lines (licences, menus, headers), so counting works on lines. Newlines separate
words, hence a text's features are those inside its lines and those that span a newline.
Equal lines are counted before and after one shuffle, the features of a distinct line are
made once and multiplied by its occurrences, and the features across newlines, which only
the first and last two words of a line can be part of, are added from the texts.

No feature becomes a string: the crc32 of words joined by blanks follows from the crc32 of
the words, as appending bytes is linear over the bits of the checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.llm.common import map_arrow, map_slices, raw_text, slices, stored, text_input
from stratasift.operators.ranking import global_rank

BUCKETS = 10_000
RUN = 3

_BYTES = np.arange(256, dtype=np.uint8)
_WORD = (_BYTES >= 128) | np.array([chr(b).isalnum() for b in range(256)])
_LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)

# ---- crc32 -----------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()
#: Words up to this many bytes use tables made beforehand.
TABLED = 64


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map over bits, given by the images of the single bits."""
    out = np.zeros(len(values), dtype=np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@lru_cache(maxsize=4096)
def _zeros(length: int) -> np.ndarray:
    """What appending ``length`` zero bytes does to each byte of a checksum, as four tables."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    power = (bits >> np.uint32(8)) ^ _CRC[bits & np.uint32(255)]
    total, left = bits, length
    while left:
        if left & 1:
            total = _apply(power, total)
        power, left = _apply(power, power), left >> 1
    places = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(total, places << np.uint32(8 * k)) for k in range(4)])


@lru_cache(maxsize=1)
def _tabled() -> np.ndarray:
    return np.concatenate([_zeros(n).reshape(-1) for n in range(TABLED + 2)])


def append(crc: np.ndarray, tail: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of two strings joined: of the first, of the second, bytes of the second."""
    table = _tabled()
    at = np.minimum(lengths, TABLED + 1) * 1024
    out = tail.copy()
    for k in range(4):
        out ^= table[at + (crc >> np.uint32(8 * k) & np.uint32(255)) + 256 * k]
    far = np.flatnonzero(lengths > TABLED + 1)
    for n in np.unique(lengths[far]):
        i, own = far[lengths[far] == n], _zeros(int(n))
        out[i] = tail[i]
        for k in range(4):
            out[i] ^= own[k][crc[i] >> np.uint32(8 * k) & np.uint32(255)]
    return out


def word_crcs(data: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each word: one byte of all words at a time, longest words first."""
    out = np.zeros(len(first), dtype=np.uint32)
    order = np.argsort(np.minimum(lengths, TABLED + 1).astype(np.uint16), kind="stable")[::-1]
    n_far = int((lengths > TABLED).sum())
    for i in order[:n_far].tolist():
        out[i] = zlib.crc32(data[first[i] : first[i] + lengths[i]])
    order = order[n_far:]
    at, size = first[order], lengths[order]
    live = np.cumsum(np.bincount(size, minlength=TABLED + 1)[::-1])[::-1]  # words of j bytes or more
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(TABLED):
        n = int(live[j + 1]) if j + 1 < len(live) else 0
        if not n:
            break
        c = crc[:n]
        crc[:n] = _CRC[(c ^ data[at[:n] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out[order] = ~crc
    return out


# ---- words, lines, features ------------------------------------------------------------


@dataclass
class Words:
    """Words in reading order: the text and the line each belongs to, checksum, bytes."""

    text: np.ndarray
    line: np.ndarray
    crc: np.ndarray
    length: np.ndarray


def words_in(array: pa.Array, borders: bool = False) -> Words:
    """All words of some texts, or only the first and last two of each line of texts with several.

    Line numbers ascend and differ between texts.
    """
    raw, offsets = raw_text(array)
    data = _LOWER[raw]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    first, after = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    text = np.searchsorted(offsets, first, "right") - 1
    line = text + np.searchsorted(np.flatnonzero(data == ord("\n")), first)
    if borders and len(first):
        new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        size = np.diff(np.append(new, len(line)))
        rank = np.arange(len(line)) - np.repeat(new, size)
        several = np.bincount(text[new], minlength=len(array)) > 1
        keep = ((rank < RUN - 1) | (rank >= np.repeat(size, size) - (RUN - 1))) & several[text]
        first, after, text, line = first[keep], after[keep], text[keep], line[keep]
    return Words(text, line, word_crcs(data, first, after - first), after - first)


def features(words: Words, across: bool, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the word runs inside lines, or of those across lines of one text."""
    blank = np.full(len(words.crc), zlib.crc32(b" "), dtype=np.uint32)
    spaced = append(blank, words.crc, words.length)  # " word"
    crc = words.crc
    texts, found = ([], []) if across else ([words.text], [crc])
    for n in range(1, RUN):
        if len(words.crc) <= n:
            break
        crc = append(crc[:-1], spaced[n:], words.length[n:] + 1)
        same = words.line[n:] == words.line[:-n]
        fits = (words.text[n:] == words.text[:-n]) & ~same if across else same
        texts.append(words.text[:-n][fits])
        found.append(crc[fits])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(texts), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def _tally(across: bool, buckets: int):
    """Bucket counts of a task: of distinct lines times their occurrences, or across lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                text, bucket = features(words_in(part.column("text"), borders=across), across, buckets)
                if across:
                    total += np.bincount(bucket, minlength=buckets)
                else:
                    times = part.column("n").to_numpy(zero_copy_only=False)
                    total += np.bincount(bucket, weights=times[text], minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    return run


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; at most ``buckets`` rows.

    Equal lines meet in one shuffle that counts them beforehand in every task; a line of a
    third of the corpus sends one row per task.
    """
    texts = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("text")).where("text != ''")
    distinct = lines.groupBy("text").agg(F.count("*").alias("n"))
    inside = map_arrow(distinct, _tally(False, buckets), "bucket int, n long")
    across = map_arrow(texts, _tally(True, buckets), "bucket int, n long")
    return inside.unionAll(across).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, for every bucket."""
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _counts(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, dtype=np.int64)
    for row in bucket_counts(docs, text, buckets).collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_features, weight): the sum of the gains of each text's features.

    Lines that repeat within a batch of texts are weighed once.
    """
    buckets = len(gain)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        array = part.column("text")
        rows = len(array)
        split = pc.split_pattern(array, "\n")
        lines = split.flatten().dictionary_encode()
        which = lines.indices.to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(rows), split.value_lengths().to_numpy(zero_copy_only=False))
        words = words_in(lines.dictionary)
        line, bucket = features(words, False, buckets)
        weight = np.bincount(line, weights=gain[bucket], minlength=len(lines.dictionary))
        n_words = np.bincount(words.text, minlength=len(lines.dictionary))
        total = np.bincount(of, weights=weight[which], minlength=rows)
        count = np.bincount(of, weights=n_words[which], minlength=rows).astype(np.int64)
        place, bucket = features(words_in(array, borders=True), True, buckets)
        total += np.bincount(place, weights=gain[bucket], minlength=rows)
        n_features = sum(np.maximum(count - n, 0) for n in range(RUN))
        return pa.RecordBatch.from_arrays(
            [part.column("key"), pa.array(n_features, pa.int64()), pa.array(total.astype(np.int64))],
            names=["key", "n_features", "weight"],
        )

    rows = text_input(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    return map_slices(rows, work, f"key {kind}, n_features long, weight long").withColumnRenamed("key", key)


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of ``docs``: key, n_features, weight, score, rank (1, 2, ...; null if not drawn).

    ``target`` has a column called ``text`` as well. Of the rows with ``least_words`` words or
    more, ``percent`` per cent (rounded down) with the highest scores are drawn, ties to the
    smaller key, a null key last; equal rows get neighbouring ranks. Noise comes from the
    sha256 of "seed:key", a null key as empty text. Null texts have no features, weight 0. An
    empty target or table is no error. Other columns of ``docs`` are not returned.

    Only bucket counts reach the driver. Weights are written to the shared folder once; ranks
    come from a range partitioning of keys and scores.
    """
    gain = gains(_counts(docs, text, buckets), _counts(target, text, buckets))
    weighed = weigh(docs, gain, key, text)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    draw = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(draw))).cast("long")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "scored")
    # w words have w + (w - 1) + (w - 2) features
    enough = F.col("n_features") >= sum(max(least_words - n, 0) for n in range(RUN))
    able = scored.where(enough)
    rows = able.count()
    order = [F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last()]
    ranked = global_rank(able, order, "rank", rows)
    drawn = F.when(F.col("rank") <= percent * rows // 100, F.col("rank"))
    none = F.lit(None).cast("long")
    return ranked.withColumn("rank", drawn).unionByName(scored.where(~enough).withColumn("rank", none))
