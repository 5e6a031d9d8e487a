"""SentencePiece encoding as a shortest path through a weighted transducer.

The model file is compiled into three transducers: the normaliser (a blank in front, U+2581
counts as a blank), the lexicon (a trie whose final arcs emit a piece at its cost) and byte
fallback (an arc for any single character the lexicon lacks, emitting its UTF-8 bytes).
Composing them with an input gives a lattice over the input's positions; the encoding is
its shortest path in the tropical semiring (costs add along a path, the least wins).

* Unigram models: a piece costs minus its score.
* BPE models: pieces cost nothing, and the lattice is composed with an acceptor over
  neighbouring pieces. A sequence of pieces is what merging would build exactly when every
  neighbouring pair is what merging builds from the pair's own text, so all other pairs
  cost infinity and one finite path is left.

No piece goes on past a blank that follows another character, so the lattice falls apart
there, as it does between any two characters that no piece holds side by side. Each
stretch is solved once and remembered.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratasift.llm.common import map_arrow, map_slices, text_input

#: How the model file writes a blank; blanks stay blanks in here.
MARK = "\u2581"
#: Stretches remembered per worker process, and the longest that is.
MEMORY, MEMORABLE = 800_000, 48

# Fixed values of the model file's format: piece kinds and model kinds.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes):
    """(field number, value) pairs of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        head = number()
        kind = head & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value = raw[at : at + size]
            at += size
        yield head >> 3, value


class Transducer:
    """A compiled model: :meth:`encode` to ids, :meth:`decode` back to text."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        kind, self.prefix, self.squeeze = UNIGRAM, True, True
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("models with a character map are not supported")
                self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
                if not rules.get(5, 1):
                    raise ValueError("models that keep blanks unescaped are not supported")
        if kind not in (UNIGRAM, BPE) or {USER, UNUSED} & set(self.kinds):
            raise ValueError("only unigram and BPE models of plain pieces are supported")
        self.merging = kind == BPE
        self.scores = scores
        self.ids = {p.replace(MARK, " "): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = [-1] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.byte_ids[int(self.pieces[i][3:-1], 16)] = i
        self.fallback = -1 not in self.byte_ids
        self.other_cost = UNKNOWN_PENALTY - min((scores[i] for i in self.ids.values()), default=0.0)
        # the lexicon: arcs of each state, and the piece that ends there
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                nxt = self.arcs[state].get(c)
                if nxt is None:
                    nxt = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(-1)
                state = nxt
            self.ends[state] = i
        crosses = any(re.search("[^ ] ", p) for p in self.ids)
        self.separable = self.merging or self.fallback
        self.stretch = re.compile("(?s).+" if crosses else " *[^ ]+| +")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.order = {p: -scores[i] for p, i in self.ids.items()}
        times: dict[float, int] = {}
        for p in self.order:
            times[self.order[p]] = times.get(self.order[p], 0) + 1
        self.tied = {p for p in self.order if times[self.order[p]] > 1}
        self.known = _Memory(self)
        self.bytes_of = [self._piece_bytes(i) for i in range(len(self.pieces))]

    # ---- the three transducers applied to one input

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (" " if self.prefix else "") + text.replace(MARK, " ")

    def _emit(self, label: int | str) -> list[int]:
        if isinstance(label, int):
            return [label]
        if self.fallback:
            return [self.byte_ids[b] for b in label.encode()]
        return [self.unknown]

    def shortest_path(self, s: str) -> list[int]:
        """Ids of the cheapest path through the lattice of one normalised stretch."""
        n = len(s)
        cost = [math.inf] * (n + 1)
        cost[0] = 0.0
        back: list[tuple[int, int | str]] = [(0, -1)] * (n + 1)
        arcs, ends, scores, merging = self.arcs, self.ends, self.scores, self.merging
        pairs = self.pairs
        for at in range(n):
            here = cost[at]
            if here == math.inf:
                continue
            before = s[back[at][0] : at]
            state, to, single = 0, at, False
            while to < n:
                state = arcs[state].get(s[to])
                if state is None:
                    break
                to += 1
                piece = ends[state]
                if piece < 0:
                    continue
                if to == at + 1:
                    single = True
                through = here if merging else here - scores[piece]
                if through < cost[to]:
                    if merging:
                        key = (before, s[at:to])
                        fits = pairs.get(key)
                        if not (self._fits(*key) if fits is None else fits):
                            continue
                    cost[to], back[to] = through, (at, piece)
            if not single:
                through = here if merging else here + self.other_cost
                if through < cost[at + 1] and (not merging or self._fits(before, s[at])):
                    cost[at + 1], back[at + 1] = through, (at, s[at])
        path, at = [], n
        while at:
            at, label = back[at]
            path.append(label)
        path.reverse()
        if not merging and not self.fallback:  # neighbouring unknown characters are one unknown
            path = [x for i, x in enumerate(path) if not (i and isinstance(x, str) and isinstance(path[i - 1], str))]
        return [i for label in path for i in self._emit(label)]

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging leaves exactly this pair of neighbours (or this piece alone)."""
        key = (left, right)
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            fits = self.pairs[key] = self._stays(left, right)
        return fits

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes the piece; none for what merging never makes."""
        known = self.halves.get(piece, 0)
        if known == 0:
            known = None
            if len(piece) > 1:
                parts = self.merged(piece, stop=2)
                if len(parts) == 2 and "".join(parts) in self.ids:
                    known = (parts[0], parts[1])
            self.halves[piece] = known
        return known

    def _stays(self, left: str, right: str) -> bool:
        """Undo the later of the two pieces' merges, step by step: at no step may an earlier
        merge have been open across the border."""
        if len(left) + len(right) == 1:
            return True
        if not left:
            return self.merged(right) == [right]
        if left in self.tied or right in self.tied or (left + right) in self.tied:
            return self.merged(left + right) == [left, right]
        for piece in (left, right):
            if len(piece) > 1 and self._halves(piece) is None:
                return False
        order = self.order
        bound, bound_wins_ties = math.inf, False
        while True:
            across = order.get(left + right)
            if across is not None and (across < bound or (across == bound and not bound_wins_ties)):
                return False
            a = order[left] if len(left) > 1 else -1
            b = order[right] if len(right) > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                # the left piece's last merge stands further left: it wins a tie
                bound, bound_wins_ties, left = a, True, self._halves(left)[1]
            else:
                bound, bound_wins_ties, right = b, False, self._halves(right)[0]

    def merged(self, s: str, stop: int = 1) -> list[str]:
        """BPE by its definition: join the best-scored neighbours, leftmost first, until ``stop`` parts are left."""
        parts: list[str | None] = list(s)
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and (piece := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[piece], i, parts[i] + parts[j]))

        for i in range(len(s)):
            offer(i)
        count = len(s)
        while heap and count > stop:
            _, i, text = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != text:
                continue
            parts[i], parts[j], right[i] = text, None, right[j]
            count -= 1
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            offer(left[i])
        return [p for p in parts if p is not None]

    # ---- whole texts

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.stretch.findall(self.normalise(text))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def _piece_bytes(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:-1], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else self.pieces[i].replace(MARK, " ").encode()

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Memory(dict):
    """Stretch -> ids; forgets everything when full."""

    def __init__(self, owner: Transducer):
        self.owner = owner

    def __missing__(self, stretch: str) -> bytes:
        beside, cut = self.owner.beside, 0
        parts = []
        for i in range(1, len(stretch)):
            if stretch[i - 1 : i + 1] not in beside:  # no piece holds these two side by side
                parts.append(stretch[cut:i])
                cut = i
        if parts and self.owner.separable:
            parts.append(stretch[cut:])
            ids = b"".join(map(self.__getitem__, parts))
        else:
            ids = struct.pack(f"<{len(path := self.owner.shortest_path(stretch))}i", *path)
        if len(stretch) <= MEMORABLE:
            if len(self) >= MEMORY:
                self.clear()
            self[stretch] = ids
        return ids


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def piece_encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ids, n_tokens and round_trip (decoding the ids gives the text back) per row.

    One row out per row in, also for repeated and null keys. A null or empty text has no
    ids. Texts are encoded whole; a long stretch without blanks takes memory in proportion
    to its length. Where the text itself holds U+2581, decoding gives a blank: the model
    cannot tell them apart, and ``round_trip`` compares with that in mind.
    """
    model = Path(model_path).read_bytes()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        fst = compiled(model)
        ids, same = [], []
        for t in part.column("text").to_pylist():
            ids.append(np.frombuffer(fst.encode_bytes(t), "<i4"))
            want = fst.normalise(t)
            same.append(fst.decode(ids[-1].tolist()) == (want[1:] if fst.prefix else want))
        counts = np.array([len(x) for x in ids], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays(
            [part.column("key"), lists, pa.array(counts), pa.array(same)],
            names=[key, "ids", "n_tokens", "round_trip"],
        )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>, n_tokens long, round_trip boolean"
    return map_slices(text_input(docs, key, text), work, schema)


def piece_decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and text of rows of ids; null ids give a null text."""
    model = Path(model_path).read_bytes()

    def run(batches):
        fst = compiled(model)
        for batch in batches:
            texts = [None if x is None else fst.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids")
    return map_arrow(rows, run, f"`{key}` {kind}, text string")
