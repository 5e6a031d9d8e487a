"""Text quality by a generalised additive model with pairwise interactions.

A text becomes a few numbers (lengths, shares of kinds of characters, repetition). Each
number has a lookup table over bins of its range, and some pairs of numbers have a table
over coarser bins; a text's score is the sigmoid of the sum of its entries. The tables are
learnt by boosting: round after round, one shallow tree on one number after the other, each
a small step towards the labels, then the same with the pairs that promise most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasift.llm.common import ALNUM, BLANKS, crc_remainder, map_slices, raw_text, shingles_of, text_input, words_of
from stratasift.llm.labelled import class_totals, label_sample

#: Labelled rows of each class the model learns from, at most.
PER_CLASS = 10_000
#: Text that is made into features at once; the arrays on the way are many times as large.
FEATURE_BYTES = 1 << 20
BINS, PAIR_BINS, PAIRS = 64, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 250, 80, 0.1, 4

# Kinds of bytes whose shares are features.
_SYMBOLS = set(b"#$%&*|<>{}[]^~_=+\\@/")
_KINDS = {
    "upper": set(range(65, 91)),
    "digit": set(range(48, 58)),
    "blank": {9, 10, 11, 12, 13, 32},
    "symbol": _SYMBOLS,
    "mark": set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)) - _SYMBOLS,
    "wide": set(range(128, 256)),
    "control": set(range(32)) - {9, 10, 13},
}
FEATURES = [
    "log_size", *(f"share_{k}" for k in _KINDS), "word_size", "marked_words", "short_words", "lone_marks",
    "distinct_words", "top_word", "echo", "distinct_lines", "log_line", "repeated_runs", "stops",
]


def _member(values: set[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


_TABLES = {k: _member(v) for k, v in _KINDS.items()}
_LINES = np.where(_member({10}), 0, np.arange(1, 257).astype(np.uint8)).astype(np.uint8)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repetition(place: np.ndarray, hashes: np.ndarray, n: int):
    """(distinct, occurrences of the most frequent, occurrences of repeated ones) per text."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, place))
    p, h = place[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (h[1:] != h[:-1])]))
    times, owner = np.diff(np.append(new, len(h))), p[new]
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, owner, times)
    again = np.bincount(owner, weights=np.where(times > 1, times, 0), minlength=n)
    return np.bincount(owner, minlength=n), most, again


def features(array: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; whole texts, nulls and empty ones as zeros."""
    data, offsets = raw_text(array)
    n = len(array)
    size = np.diff(offsets)
    per = lambda x, y: x / np.maximum(y, 1)
    out = [np.log1p(size)]
    out += [per(_per_text(t[data], offsets), size) for t in _TABLES.values()]
    place, words, first, after = words_of(array, BLANKS)
    count = np.bincount(place, minlength=n)
    length = after - first
    alnum = ALNUM[data] != 0
    inside = np.concatenate([[0], np.cumsum(alnum, dtype=np.int64)])
    letters = inside[after] - inside[first]
    out.append(per(np.bincount(place, weights=length, minlength=n), count))
    out.append(per(np.bincount(place, weights=~alnum[after - 1] if len(after) else None, minlength=n), count))
    out.append(per(np.bincount(place, weights=length <= 3, minlength=n), count))
    out.append(per(np.bincount(place, weights=letters == 0, minlength=n), count))
    distinct, most, _ = _repetition(place, words, n)
    # fewer distinct words are to be expected of longer texts
    out.append(per(distinct, np.maximum(count, 1) ** 0.8))
    out.append(per(most, count))
    echo = np.flatnonzero((words[1:] == words[:-1]) & (place[1:] == place[:-1]))
    out.append(per(np.bincount(place[echo], minlength=n), count))
    lines, line_words, line_first, line_after = words_of(array, _LINES)
    line_count = np.bincount(lines, minlength=n)
    line_distinct, _, _ = _repetition(lines, line_words, n)
    out.append(per(line_distinct, line_count))
    out.append(np.log1p(per(np.bincount(lines, weights=line_after - line_first, minlength=n), line_count)))
    runs, run_hash = shingles_of(place, words, n, 3)
    run_count = np.bincount(runs, minlength=n)
    out.append(per(_repetition(runs, run_hash, n)[2], run_count))
    out.append(per(_per_text(_member({46, 63, 33})[data], offsets), count))
    return np.column_stack(out).astype(np.float64) if n else np.zeros((0, len(FEATURES)))


def _tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree of LEAVES leaves over ordered bins: the step of each bin."""
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    # weights are p (1 - p); a leaf holds at least 0.01 of them, so one unsure row may be a leaf
    leaves = [(0, len(gradient))]

    def value(a, b):
        return (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)

    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(leaves):
            cut = np.arange(a + 1, b)
            if not len(cut):
                continue
            gain = value(a, cut) + value(cut, b) - value(a, b)
            gain[(w[cut] - w[a] < 0.01) | (w[b] - w[cut] < 0.01)] = 0
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (gain[j], i, cut[j])
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(gradient))
    for a, b in leaves:
        step[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return step


def _tree_2d(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that cuts one axis and then each half on the other; its step and its gain."""
    best: tuple[float, np.ndarray | None] = (0.0, None)
    for turned in (False, True):
        G, W = (gradient.T, weight.T) if turned else (gradient, weight)
        g, w = G.cumsum(0), W.cumsum(0)
        whole = g[-1].sum() ** 2 / (w[-1].sum() + 1.0)
        for i in range(len(G) - 1):
            total, step = -whole, np.zeros_like(G)
            for a, b, gg, ww in ((0, i + 1, g[i], w[i]), (i + 1, len(G), g[-1] - g[i], w[-1] - w[i])):
                cg, cw = gg.cumsum(), ww.cumsum()
                left = cg**2 / (cw + 1.0) + (cg[-1] - cg) ** 2 / (cw[-1] - cw + 1.0)
                j = int(np.argmax(left[:-1])) if len(left) > 1 else 0
                total += left[j]
                step[a:b, : j + 1] = cg[j] / (cw[j] + 1.0)
                step[a:b, j + 1 :] = (cg[-1] - cg[j]) / (cw[-1] - cw[j] + 1.0)
            if total > best[0]:
                best = (total, step.T if turned else step)
    return (np.zeros_like(gradient) if best[1] is None else best[1]), best[0]


class Additive:
    """Bins, tables of single features and of pairs, and a base."""

    def __init__(self, edges, tables, pairs, base):
        self.edges, self.tables, self.pairs, self.base = edges, tables, pairs, base

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]) if len(x) else np.zeros(x.shape, int)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for i, j, table in self.pairs:
            total += table[_coarse(bins[:, i]), _coarse(bins[:, j])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(self.bins(x)))


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // BINS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> Additive:
    """Learn from rows of FEATURES and labels 0/1; one class alone gives a constant near it.

    ``times``: how many labelled rows each row stands for, as far as rows differ in it.
    """
    k = x.shape[1]
    # as many rows as there are, so that steps are shrunk alike at any size
    times = np.ones(len(y)) if times is None or not len(y) else times / times.mean()
    share = ((times * y).sum() + 1) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(share / max(1 - share, 1e-3)))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(k)]
    model = Additive(edges, [np.zeros(BINS) for _ in range(k)], [], base)
    if len(np.unique(y)) < 2:
        return model
    bins = model.bins(x)
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j in range(k):
            p = _sigmoid(total)
            g = np.bincount(bins[:, j], weights=times * (y - p), minlength=BINS)
            w = np.bincount(bins[:, j], weights=times * p * (1 - p), minlength=BINS)
            step = RATE * _tree(g, w)
            model.tables[j] += step
            total += step[bins[:, j]]
    coarse = _coarse(bins)

    def sums(i, j):
        p = _sigmoid(total)
        at = coarse[:, i] * PAIR_BINS + coarse[:, j]
        size = PAIR_BINS * PAIR_BINS
        shape = (PAIR_BINS, PAIR_BINS)
        return (
            np.bincount(at, weights=times * (y - p), minlength=size).reshape(shape),
            np.bincount(at, weights=times * p * (1 - p), minlength=size).reshape(shape),
        )

    gains = sorted(((-_tree_2d(*sums(i, j))[1], i, j) for i in range(k) for j in range(i)))
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * _tree_2d(*sums(i, j))[0]
            table += step
            total += step[coarse[:, i], coarse[:, j]]
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, only: Column | None = None, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> Additive:
    """Fit on at most ``per_class`` labelled rows of each class; features are made in tasks.

    Rows are weighted by their class's share of all labels, so scores keep the real ratio of
    the classes however many are sampled.
    """
    totals = class_totals(labels, "quality", only, key)
    sample = label_sample(labels, "quality", per_class, only, key)
    rows = text_input(docs, key, text).join(F.broadcast(sample), "key")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        x = features(part.column("text"))
        ends = np.arange(len(part) + 1, dtype=np.int32) * len(FEATURES)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))
        return pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), lists], names=["key", "label", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    made = map_slices(rows, work, f"key {kind}, label int, x array<double>", limit=FEATURE_BYTES)
    # one row per key, however often it is repeated
    one = made.groupBy("key").agg(F.min(F.struct("label", "x")).alias("r")).select("key", "r.*").orderBy("key")
    got = one.collect()
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(-1, len(FEATURES))
    y = np.array([r["label"] for r in got], dtype=np.float64)
    return fit(x, y, np.array([max(totals[r["label"]] / per_class, 1.0) for r in got]))


def score_quality(docs: DataFrame, model: Additive, *more: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, the columns ``more``, score (0 to 1) and predicted (1 from 0.5 on)."""
    rows = text_input(docs, key, text, *more)
    names = [f.name for f in rows.schema.fields if f.name not in ("key", "text")]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(features(part.column("text")))
        return pa.RecordBatch.from_arrays(
            [part.column("key"), *[part.column(c) for c in names], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            names=[key, *names, "score", "predicted"],
        )

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    kind = rows.schema["key"].dataType.simpleString()
    return map_slices(rows, work, f"`{key}` {kind}{extra}, score double, predicted int", limit=FEATURE_BYTES)


def held_out(key: str = "doc_id") -> Column:
    """Rows the model never learns from: crc32 of the key as text, modulo 3, is 1."""
    return crc_remainder(key, 3) == 1


def drop_low_quality(docs: DataFrame, model: Additive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted 1, all columns as they were.

    The texts pass through the task with their row, so no join is needed.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(model.score(features(part.column(text))) >= 0.5))

    return map_slices(docs, work, docs.schema, text, FEATURE_BYTES)
