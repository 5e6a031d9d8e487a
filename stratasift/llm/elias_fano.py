"""Elias-Fano sequences and an n-gram trie of two levels over them, in memory-mapped files.

A monotone sequence of n numbers below u keeps the low log2(u / n) bits of each number as
they are and the high bits in unary: 2 + log2(u / n) bits a number. All look-ups here take
many queries at once.
"""

from __future__ import annotations

import json

import numpy as np

U64 = np.uint64
#: Bits of a context's hash in the second level.
CONTEXT_BITS = 40


class EliasFano:
    """A monotone sequence. ``arrays`` is what is stored; nothing else is needed to read it."""

    def __init__(self, arrays: dict[str, np.ndarray], n: int, low_bits: int):
        self.arrays, self.n, self.low_bits = arrays, n, low_bits

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(U64)
        high = (values >> U64(low_bits)).astype(np.int64)
        ones = high + np.arange(n)
        size = (n + (universe >> low_bits) + 2 + 63) // 64
        bits = np.zeros(size * 64, dtype=np.uint8)
        bits[ones] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        ranks = np.zeros(size + 1, dtype="<u4")
        ranks[1:] = np.cumsum(counts)
        return cls({"low": _pack(values, low_bits), "high": words, "ranks": ranks}, n, low_bits)

    def low(self, i: np.ndarray) -> np.ndarray:
        return _unpack(self.arrays["low"], i, self.low_bits)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th one (or zero) in the high bits."""
        ranks, words = self.arrays["ranks"], self.arrays["high"]
        before = ranks if ones else np.arange(len(ranks), dtype=np.int64) * 64 - ranks
        word = np.searchsorted(before, k, "right") - 1
        rest = (k - before[word]).astype(np.int64)
        value = words[word] if ones else ~words[word]
        place = np.zeros(len(word), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            mask = U64((1 << half) - 1)
            inside = np.bitwise_count((value >> place.astype(U64)) & mask).astype(np.int64)
            up = rest >= inside
            rest -= np.where(up, inside, 0)
            place += np.where(up, half, 0)
        return word * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(U64)
        return (high << U64(self.low_bits)) | self.low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first number not below each x (n if there is none)."""
        x = x.astype(U64)
        if not self.n or not len(x):
            return np.full(len(x), self.n, dtype=np.int64)
        high = (x >> U64(self.low_bits)).astype(np.int64)
        low = x & U64((1 << self.low_bits) - 1)
        # numbers with a smaller high part end at the zero numbered high - 1
        zeros = len(self.arrays["high"]) * 64 - self.n
        beyond = high >= zeros - 1
        high = np.minimum(high, zeros - 2)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        last = self._select(high, False) - high
        lo, hi = first.copy(), last.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = self.low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return np.where(beyond, self.n, lo)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, side by side."""
    n = len(values)
    out = np.zeros((n * bits + 63) // 64 + 1, dtype="<u8")
    if bits and n:
        low = values & U64((1 << bits) - 1) if bits < 64 else values
        at = np.arange(n, dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(U64)
        np.bitwise_or.at(out, word, low << shift)
        over = (shift.astype(np.int64) + bits) > 64
        np.bitwise_or.at(out, word[over] + 1, low[over] >> (U64(64) - shift[over]))
    return out


def _unpack(packed: np.ndarray, i: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), dtype=U64)
    at = i.astype(np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(U64)
    value = packed[word] >> shift
    over = shift > 0
    value = value | np.where(over, packed[word + 1] << (U64(64) - np.where(over, shift, U64(1))), U64(0))
    return value & U64((1 << bits) - 1) if bits < 64 else value


def quantise(x: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Codes and a codebook: bins of equal width, each read back as the mean of its numbers."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1, np.float64)
    low, width = x.min(), max(x.max() - x.min(), 1e-12)
    bins = np.minimum(((x - low) / width * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    filled = np.maximum(np.bincount(bins, minlength=1 << bits), 1)
    return bins.astype(np.uint8), np.bincount(bins, weights=x, minlength=1 << bits) / filled


class Trie:
    """Words, and below each word the contexts it was seen after.

    ``words`` are sorted 64-bit hashes. Level 1 holds them with their log10 probabilities;
    ``pointers`` are where each word's contexts begin; level 2 holds the contexts of all words
    as one monotone sequence (a context's hash plus the rank of its word times 2^40), so a
    look-up is a successor search relative to the word.
    """

    def __init__(self, words: EliasFano, pointers: EliasFano, contexts: EliasFano, codes: dict[str, np.ndarray]):
        self.words, self.pointers, self.contexts, self.codes = words, pointers, contexts, codes

    @classmethod
    def build(cls, words, word_log, starts, contexts, context_log) -> Trie:
        """``starts``: first context of each word, and the number of contexts."""
        rank = np.repeat(np.arange(len(words)), np.diff(starts)).astype(U64)
        joined = (rank << U64(CONTEXT_BITS)) | contexts
        codes = {}
        codes["word_code"], codes["word_book"] = quantise(word_log)
        codes["context_code"], codes["context_book"] = quantise(context_log)
        return cls(
            EliasFano.build(words, 1 << 64),
            EliasFano.build(np.asarray(starts), int(starts[-1]) + 1),
            EliasFano.build(joined, max(1, len(words)) << CONTEXT_BITS),
            codes,
        )

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 if it is not there."""
        at = self.words.successor(hashes)
        inside = at < self.words.n
        found = np.full(len(hashes), -1, dtype=np.int64)
        same = np.flatnonzero(inside)
        found[same] = np.where(self.words.get(at[same]) == hashes[same].astype(U64), at[same], -1)
        return found

    def find_contexts(self, rank: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Place of each context below the word of the given rank, -1 if it is not there."""
        first, after = self.pointers.get(rank), self.pointers.get(rank + 1)
        x = (rank.astype(U64) << U64(CONTEXT_BITS)) | contexts.astype(U64)
        at = self.contexts.successor(x)
        inside = (at >= first.astype(np.int64)) & (at < after.astype(np.int64))
        found = np.full(len(rank), -1, dtype=np.int64)
        some = np.flatnonzero(inside)
        found[some] = np.where(self.contexts.get(at[some]) == x[some], at[some], -1)
        return found

    def word_log(self, rank: np.ndarray) -> np.ndarray:
        return self.codes["word_book"][self.codes["word_code"][rank]]

    def context_log(self, place: np.ndarray) -> np.ndarray:
        return self.codes["context_book"][self.codes["context_code"][place]]

    # ---- one file: a line of JSON that tells the arrays, then the arrays

    def to_bytes(self) -> bytes:
        head: dict = {"arrays": [], "sequences": {}}
        body = []
        named = dict(self.codes)
        for name in ("words", "pointers", "contexts"):
            sequence = getattr(self, name)
            head["sequences"][name] = [sequence.n, sequence.low_bits]
            named |= {f"{name}.{k}": a for k, a in sequence.arrays.items()}
        at = 0
        for name, a in named.items():
            raw = np.ascontiguousarray(a).tobytes()
            raw += b"\0" * (-len(raw) % 8)
            head["arrays"].append([name, a.dtype.str, len(a), at])
            body.append(raw)
            at += len(raw)
        line = json.dumps(head).encode()
        line += b" " * (-(len(line) + 1) % 8) + b"\n"
        return line + b"".join(body)

    @classmethod
    def from_map(cls, raw: np.ndarray) -> Trie:
        """From the bytes of a mapped file; nothing is copied."""
        end = 0
        while raw[end] != 10:
            end += 1
        head = json.loads(raw[:end].tobytes())
        arrays = {}
        for name, kind, n, at in head["arrays"]:
            a = end + 1 + at
            arrays[name] = raw[a : a + n * np.dtype(kind).itemsize].view(kind)
        sequences = [
            EliasFano({k.split(".")[1]: v for k, v in arrays.items() if k.startswith(f"{name}.")}, n, low)
            for name, (n, low) in head["sequences"].items()
        ]
        return cls(*sequences, {k: v for k, v in arrays.items() if "." not in k})
