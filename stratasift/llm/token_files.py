"""Token ids as flat binary files, memory-mapped.

A part of the rows (a range of keys) becomes three files: ``.ids`` (little-endian unsigned
ids of all its documents, 16 bits wide if the vocabulary fits, else 32), ``.offsets`` (unsigned 64-bit, one more than
documents: where each document's ids start in the part) and ``.keys`` (signed 64-bit keys).
A part's base, the ids in all parts before it, is the prefix sum of the parts' counts.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.llm.common import map_arrow, mix, raw_text, shared_folder, slices, text_input

#: White space at which no pre-token of the tokenizer goes on (fixed values: Unicode White_Space).
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_BLANK}]", c))
#: Bytes that are white space by themselves, and those that begin a longer one.
_BLANK_BYTE = np.array([chr(b) in _BLANKS and b < 128 for b in range(256)])
_WIDE = [c.encode() for c in sorted(_BLANKS) if ord(c) > 127]
_WIDE_LEAD = np.isin(np.arange(256), [w[0] for w in _WIDE])
#: 1 for an ASCII letter, 2 for a digit, 3 for other ASCII but white space, else 0.
_SORT = np.array([(1 if c.isalpha() else 2 if c.isdigit() else 0 if c in _BLANKS else 3) * (b < 128) for b, c in ((b, chr(b)) for b in range(256))], np.uint8)
MEMORY, POOL = 800_000, 16_000_000
#: Stretches of up to this many bytes are compared as three 64-bit numbers.
SHORT = 24
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches begin: at each text's first byte, where white space follows other bytes,
    and behind an ASCII letter or digit that ASCII of another kind follows."""
    blank = _BLANK_BYTE[data]
    lead = np.flatnonzero(_WIDE_LEAD[data])
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        for wide in _WIDE:
            at = lead[padded[lead] == wide[0]]
            for j, byte in enumerate(wide[1:], 1):
                at = at[padded[at + j] == byte]
            for j in range(len(wide)):
                blank[at + j] = True
    begins = blank
    begins[1:] &= ~blank[:-1]
    kinds = _SORT[data]
    before, here = kinds[:-1], kinds[1:]
    begins[1:] |= (before != here) & (here > 0) & ((before == 1) | (before == 2))
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[filled] = True
    return np.flatnonzero(begins)


class Encoder:
    """A byte-level tokenizer file; remembers the ids of stretches between blanks.

    A byte-level pre-token never goes on into white space that follows another character,
    so a text's ids are those of its stretches one after the other. Letters and digits never
    share a pre-token with what follows them. Names of special tokens inside a text are
    ordinary text. Known stretches are found by their bytes in an
    open hash table, all of a batch at once; only new ones become Python strings.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        #: The narrowest unsigned type that holds every id.
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        # one character of a byte-level piece stands for one byte
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.pool = np.zeros(0, self.kind)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        #: Bytes of each entry as three numbers, its length; entry of each slot, -1 if free.
        self.words = np.zeros((0, 3), np.uint64)
        self.lengths = np.zeros(0, np.int64)
        self.slots = np.full(1 << 16, -1, np.int32)
        self.long: dict[bytes, int] = {}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new stretches. Those that begin with a blank are encoded as one text, which
        is cut again by the bytes that each id stands for."""
        joined = [s for s in new if s[0] in _BLANKS and s[-1] not in _BLANKS]
        lone = [s for s in new if not (s[0] in _BLANKS and s[-1] not in _BLANKS)]
        found = self.tokenizer.encode_batch_fast(lone, add_special_tokens=False)
        learnt = {s: np.array(e.ids, dtype=self.kind).tobytes() for s, e in zip(lone, found)}
        for a in range(0, len(joined), 20_000):
            some = joined[a : a + 20_000]
            ids = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype=self.kind)
            ends = np.cumsum(self.widths[ids])
            stops = np.cumsum([len(s.encode()) for s in some])
            cuts = (np.searchsorted(ends, stops) + 1) * ids.itemsize
            raw, at = ids.tobytes(), 0
            for s, cut in zip(some, cuts.tolist()):
                learnt[s] = raw[at:cut]
                at = cut
        return learnt

    @staticmethod
    def _hash(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        h = words[:, 0] ^ (words[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[:, 2] * np.uint64(0xC2B2AE3D27D4EB4F))
        return mix(h + lengths.astype(np.uint64))

    def _find(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Entry of each short stretch, -1 where it is new."""
        mask = len(self.slots) - 1
        slot = (self._hash(words, lengths) & np.uint64(mask)).astype(np.int64)
        entry = self.slots[slot]
        if not len(self.words):
            return entry
        waiting = np.flatnonzero(entry >= 0)
        while len(waiting):
            e = entry[waiting]
            same = self.lengths[e] == lengths[waiting]
            same &= (self.words[e] == words[waiting]).all(axis=1)
            waiting = waiting[~same]
            slot[waiting] = (slot[waiting] + 1) & mask
            entry[waiting] = self.slots[slot[waiting]]
            waiting = waiting[entry[waiting] >= 0]
        return entry

    def _place(self, entries: np.ndarray) -> None:
        """Give each entry the first free slot from its hash on."""
        mask = len(self.slots) - 1
        slot = (self._hash(self.words[entries], self.lengths[entries]) & np.uint64(mask)).astype(np.int64)
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]  # one of several that want a slot gets it
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & mask

    def _add(self, raw: list[bytes]) -> None:
        """Take up new stretches."""
        texts = [r.decode() for r in raw]
        learnt = self._learn(texts)
        ids = [learnt[t] for t in texts]
        count = np.array([len(i) for i in ids], np.int64) // np.dtype(self.kind).itemsize
        old = len(self.count)
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), self.kind)])
        lengths = np.array([len(r) for r in raw], np.int64)
        self.lengths = np.concatenate([self.lengths, lengths])
        padded = np.frombuffer(b"".join(r[:SHORT].ljust(SHORT, b"\0") for r in raw), "<u8").reshape(-1, 3)
        self.words = np.concatenate([self.words, padded.astype(np.uint64)])
        for r, entry in zip(raw, range(old, old + len(raw))):
            if len(r) > SHORT:
                self.long[r] = entry
        if 2 * len(self.count) > len(self.slots):
            self.slots = np.full(4 * len(self.slots) * max(1, len(raw) * 2 // len(self.slots)), -1, np.int32)
            self.slots = self.slots[: 1 << (len(self.slots).bit_length() - 1)]
            old, lengths = 0, self.lengths
        fresh = np.arange(old, len(self.count), dtype=np.int32)
        self._place(fresh[lengths <= SHORT])

    def flat(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if len(self.count) > MEMORY or len(self.pool) > POOL:
            self._forget()
        data, offsets = raw_text(array)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(array), np.int64)
        first = stretches(data, offsets)
        after = np.append(first[1:], len(data))
        lengths = after - first
        padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
        view = np.ndarray((len(data) + SHORT - 7,), "<u8", padded, strides=(1,))
        words = np.empty((len(first), 3), np.uint64)
        for j in range(3):
            held = np.clip(lengths - 8 * j, 0, 8)
            words[:, j] = view[np.minimum(first + 8 * j, len(data))] & _MASKS[held]
        short = lengths <= SHORT
        entry = self._find(words, lengths)
        entry[~short] = -1
        raw = data.tobytes()
        for i in np.flatnonzero(~short).tolist():
            entry[i] = self.long.get(raw[first[i] : after[i]], -1)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            names = [raw[a:b] for a, b in zip(first[missing].tolist(), after[missing].tolist())]
            new = list(dict.fromkeys(names))
            where = dict(zip(new, range(len(self.count), len(self.count) + len(new))))
            self._add(new)
            entry[missing] = [where[n] for n in names]
        counts = self.count[entry]
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(self.begin[entry] - (ends - counts), counts) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(first, offsets)]
        return ids, np.diff(upto)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``kind``."""
        ids, counts = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@lru_cache(maxsize=2)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


@contextmanager
def mapped(folder: str, name: str, kind: str):
    """A file as a memory-mapped array; a file in a remote store is mapped from a copy."""
    fs, base = _open(folder)
    path, copy = f"{base}/{name}", None
    if not isinstance(fs, pafs.LocalFileSystem):
        copy = path = tempfile.mkstemp(suffix=".map")[1]
        with fs.open_input_stream(f"{base}/{name}") as source, open(path, "wb") as target:
            shutil.copyfileobj(source, target, 1 << 20)
    try:
        empty = not os.path.getsize(path)
        yield np.zeros(0, kind) if empty else np.memmap(path, dtype=kind, mode="r")
    finally:
        if copy:
            os.unlink(copy)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
) -> DataFrame:
    """Encode whole texts into ``folder``; one row per part: part, kind, n_docs, n_tokens, base.

    Rows are dealt to parts by ranges of key and text hash and written in that order (nulls
    first, as key -2^63), so the order of all ids is that of the keys, and a key of very many
    rows fills several parts. The key must be an integer, or text of one.
    Every document ends with ``end_id``; a null or empty text has only that. A task writes
    under a name of its own and renames at the end, so a repeated task replaces a part by the
    same part. Only the list of parts (one row each) comes to the driver. ``folder`` must be
    reachable by every executor (a local path or any URI that pyarrow's file systems open).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = f"part-{context.partitionId():06d}"
        fs, base = _open(folder)
        mine = f"{base}/_{part}-{context.taskAttemptId()}"
        enc = encoder(definition.value)
        at = docs_done = 0
        with (
            fs.open_output_stream(f"{mine}.ids") as ids,
            fs.open_output_stream(f"{mine}.offsets") as offsets,
            fs.open_output_stream(f"{mine}.keys") as keys,
        ):
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                for rows in slices(batch, limit=2 << 20):
                    found, counts = enc.flat(rows.column("text"))
                    ends = np.cumsum(counts)
                    ids.write(np.insert(found, ends, end_id).tobytes())
                    offsets.write((at + ends + np.arange(1, len(ends) + 1)).astype("<u8").tobytes())
                    keys.write(rows.column("key").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    at += int(counts.sum()) + len(counts)
                    docs_done += len(counts)
        for kind in ("ids", "offsets", "keys"):
            if docs_done:
                fs.move(f"{mine}.{kind}", f"{base}/{part}.{kind}")
            else:
                fs.delete_file(f"{mine}.{kind}")
        if docs_done:
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "kind": [enc.kind], "n_docs": [docs_done], "n_tokens": [at]}
            )

    ready = text_input(docs, key, text).withColumn("key", F.coalesce(F.col("key").cast("long"), F.lit(-(1 << 63))))
    ready = ready.withColumn("h", F.xxhash64("text"))
    ordered = ready.repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text")
    parts = sorted(map_arrow(ordered, write, "part string, kind string, n_docs long, n_tokens long").collect())
    bases = [0, *accumulate(p.n_tokens for p in parts)]
    rows = [(p.part, p.kind, p.n_docs, p.n_tokens, b) for p, b in zip(parts, bases)]
    return spark.createDataFrame(rows, "part string, kind string, n_docs long, n_tokens long, base long")


def read_token_files(spark: SparkSession, parts: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, start, n_tokens, ids_crc32, read through memory maps.

    The checksum is of the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                with (
                    mapped(folder, f"{part}.ids", row["kind"]) as ids,
                    mapped(folder, f"{part}.offsets", "<u8") as offsets,
                    mapped(folder, f"{part}.keys", "<i8") as keys,
                ):
                    at = offsets.astype(np.int64)
                    for a in range(0, len(keys), 10_000):
                        b = min(a + 10_000, len(keys))
                        crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4")) for i in range(a, b)]
                        k = np.array(keys[a:b])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(k, pa.int64(), mask=k == -(1 << 63)),
                                pa.array(row["base"] + at[a:b]),
                                pa.array(np.diff(at[a : b + 1])),
                                pa.array(crc, pa.int64()),
                            ],
                            names=[key, "start", "n_tokens", "ids_crc32"],
                        )

    n = max(1, parts.count())
    spread = parts.repartition(min(n, 10_000), "part")
    return map_arrow(spread, read, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files into a new shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    parts = write_token_files(docs, tokenizer_path, folder, key, text)
    return read_token_files(docs.sparkSession, parts, folder, key)
