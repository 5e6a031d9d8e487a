"""Severity grades of toxic texts by cumulative-link ordinal regression.

Every word is a feature, and so is what it begins with (4, 5 and 6 bytes, for inflected
words); a feature's value is log(1 + occurrences). One weight per feature serves all grades:
P(grade > k) = sigmoid(w . x - t_k) with ordered thresholds t_0 < t_1 < ... The expected
severity is the sum of those probabilities.

``labels`` only says toxic or not. Rows that are not toxic have grade 0. Toxic rows are
ordered by their evidence, the sum over features that are APART times as frequent in toxic as
in other labelled rows of log(1 + occurrences) times the squared correlation of feature and
class, and cut by rank into GRADES - 1 equal shares (rows of equal evidence share a grade).
The correlation measures an effect, not how sure it is, and ranks need no fixed bound, so the
grades mean the same whatever the number of labelled rows. All occur unless a fifth or more of
the toxic rows tie, or there are fewer different amounts than grades.

All features that FEW distinct texts hold are weighed. A ridge penalty shrinks the weak ones:
values are scaled by how far the feature's frequencies in the two classes lie apart (the
correlation of feature and class), whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.llm.common import ALNUM, hash_spans, map_slices, mix, raw_text, text_input, words_of
from stratasift.llm.labelled import label_sample

#: Labelled rows of each class the model learns from, at most.
PER_CLASS = 3_000
GRADES = 4
#: Distinct labelled texts that must hold a feature; the model weighs all such features.
FEW = 3
#: How many times more frequent in toxic rows a feature must be to count for the grades.
APART = 4.0
#: The ridge penalty is that of so many rows.
ROUNDS, RATE, RIDGE = 500, 0.1, 1.0
PREFIXES = (4, 5, 6)


def word_features(array: pa.Array):
    """(text's place, feature's hash) arrays: one pair for words, one for each prefix."""
    place, words, first, after = words_of(array, ALNUM)
    codes = ALNUM[raw_text(array)[0]]
    yield place, words
    for k in PREFIXES:
        longer = after - first > k
        start = first[longer]
        yield place[longer], mix(hash_spans(codes, start, start + k) ^ np.uint64(k))


def word_counts(array: pa.Array):
    """(text's place, feature's hash, occurrences), and the number of words of each text."""
    every = list(word_features(array))
    sizes = np.bincount(every[0][0], minlength=len(array))
    place, words = (np.concatenate(x) for x in zip(*every))
    if not len(words):
        return place, words, np.zeros(0, np.int64), sizes
    order = np.lexsort((words, place))
    p, w = place[order], words[order]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])]))
    return p[new], w[new], np.diff(np.append(new, len(w))), sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Severity:
    """Weights of words (sorted hashes) and thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.words, self.weights, self.thresholds = words, weights, thresholds

    def above(self, array: pa.Array) -> np.ndarray:
        """P(grade > k) for each text (rows) and each k."""
        n, k = len(array), len(self.words)
        found = [np.zeros(0, np.int64)]
        for place, words in word_features(array) if k else ():
            at = np.minimum(np.searchsorted(self.words, words), k - 1)
            hit = self.words[at] == words
            found.append(place[hit] * k + at[hit])
        cells, times = np.unique(np.concatenate(found), return_counts=True)
        value = self.weights[cells % k] * np.log1p(times) if k else np.zeros(0)
        signal = np.bincount(cells // max(k, 1), weights=value, minlength=n)
        return _sigmoid(signal[:, None] - self.thresholds[None, :])


def grade_rows(rows: np.ndarray, words: np.ndarray, times: np.ndarray, sizes: np.ndarray, toxic: np.ndarray):
    """(grade of each row, words to weigh, strength of each): see the module's text."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    vocabulary, code = np.unique(words, return_inverse=True)
    d1 = np.bincount(code, weights=toxic[rows], minlength=len(vocabulary))
    d0 = np.bincount(code, minlength=len(vocabulary)) - d1
    share = (d1 + d0 + 1) / (n1 + n0 + 2)
    apart = (d1 / n1 - d0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    effect = apart / np.sqrt(max(len(sizes), 1))  # the correlation of feature and class
    # what few rows hold may come from copies of one text; what both classes hold is language
    first = _first_copies(rows, words, times, len(sizes))
    held = np.bincount(code, weights=first[rows], minlength=len(vocabulary)) >= FEW
    strength = np.abs(effect[held])
    telling = np.where(held & (d1 / n1 >= APART * d0 / n0), effect, 0.0).clip(0) ** 2
    amount = np.bincount(rows, weights=telling[code] * np.log1p(times), minlength=len(sizes))
    grades = np.zeros(len(sizes), dtype=np.int64)
    grades[toxic] = 1 + _by_rank(amount[toxic])
    return grades, vocabulary[held], strength


def _by_rank(amount: np.ndarray) -> np.ndarray:
    """0 to GRADES - 2 by rank, in shares as equal as ties allow."""
    different, code, count = np.unique(amount.round(9), return_inverse=True, return_counts=True)
    middle = np.cumsum(count) - count / 2  # mean rank of each amount
    place = np.minimum(middle * (GRADES - 1) // max(len(amount), 1), GRADES - 2).astype(np.int64)
    if 0 < len(different) < GRADES:
        place = np.arange(len(different))
    return place[code]


def _first_copies(rows: np.ndarray, words: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Which rows are the first of those with the same features; ``rows`` ascend."""
    prints = np.zeros(n, dtype=np.uint64)
    if len(rows):
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        prints[rows[starts]] = np.add.reduceat(mix(words ^ mix(times.astype(np.uint64))), starts)
    first = np.zeros(n, dtype=bool)
    first[np.unique(prints, return_index=True)[1]] = True
    return first


def fit(rows, words, times, sizes, toxic) -> Severity:
    """Learn from counted words: parallel arrays, and per row its size and label.

    Without rows of both classes every text gets a severity near that class's.
    """
    grades, chosen, strength = grade_rows(rows, words, times, sizes, toxic)
    n, k = len(sizes), GRADES - 1
    thresholds = np.log((1 - (p := np.array([(grades > j).mean() if n else 0.0 for j in range(k)]).clip(0.001, 0.999))) / p)
    thresholds = np.maximum.accumulate(thresholds + np.arange(k) * 1e-3)
    if not len(chosen):
        return Severity(chosen, np.zeros(0), thresholds)
    at = np.minimum(np.searchsorted(chosen, words), len(chosen) - 1)
    hit = chosen[at] == words
    r, c = rows[hit], at[hit]
    x = np.log1p(times[hit]) * strength[c]
    weights = np.zeros(len(chosen))
    first, gaps = thresholds[0], np.log(np.maximum(np.diff(thresholds), 1e-3))
    beyond = (grades[:, None] > np.arange(k)[None, :]).astype(float)
    balance = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    penalty = RIDGE / n
    state = [np.zeros(len(chosen) + k), np.zeros(len(chosen) + k)]
    for step in range(1, ROUNDS + 1):
        t = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        signal = np.bincount(r, weights=x * weights[c], minlength=n)
        # the likelihood of each threshold's yes or no; the weights are shared by all
        error = (_sigmoid(signal[:, None] - t[None, :]) - beyond) * balance[:, None]
        by_row, by_t = error.sum(1), -error.sum(0)
        g_gaps = np.array([by_t[j + 1 :].sum() for j in range(k - 1)]) * np.exp(gaps)
        g_weights = np.bincount(c, weights=x * by_row[r], minlength=len(chosen)) + penalty * weights
        g = np.concatenate([g_weights, [by_t.sum()], g_gaps])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights = weights - move[: len(chosen)]
        first, gaps = first - move[len(chosen)], gaps - move[len(chosen) + 1 :]
    return Severity(chosen, weights * strength, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def learn_severity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> Severity:
    """Fit on at most ``per_class`` labelled rows of each class; counting runs in tasks."""
    sample = label_sample(labels, "toxic", per_class, key=key)
    rows = text_input(docs, key, text).join(F.broadcast(sample), "key")

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        place, words, times, sizes = word_counts(part.column("text"))
        ends = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(part)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (words.view(np.int64), times)]
        return pa.RecordBatch.from_arrays(
            [part.column("key"), part.column("label"), *lists, pa.array(sizes)],
            names=["key", "label", "words", "times", "size"],
        )

    kind = rows.schema["key"].dataType.simpleString()
    counted = map_slices(rows, count, f"key {kind}, label int, words array<long>, times array<long>, size long")
    # one row per key, however often it is repeated
    one = counted.groupBy("key").agg(F.min(F.struct("label", "size", "words", "times")).alias("r")).select("key", "r.*")
    got = one.orderBy("key").toArrow()
    words, times = got.column("words").combine_chunks(), got.column("times").combine_chunks()
    each = np.asarray(pc.list_value_length(words)).astype(np.int64) if len(got) else np.zeros(0, np.int64)
    flat = lambda a: np.asarray(a.flatten()) if len(got) else np.zeros(0, np.int64)
    return fit(
        np.repeat(np.arange(len(each)), each),
        flat(words).view(np.uint64),
        flat(times),
        np.asarray(got.column("size")),
        np.asarray(got.column("label")) == 1,
    )


def grade_severity(docs: DataFrame, model: Severity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, severity (0 to GRADES - 1), grade (the median one), toxic (grade above 0).

    Whole texts; a null or empty text has no words, so only the thresholds speak.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        above = model.above(part.column("text"))
        grade = (above >= 0.5).sum(1)
        return pa.RecordBatch.from_arrays(
            [part.column("key"), pa.array(above.sum(1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0]), pa.array(grade > 0)],
            names=[key, "severity", "grade", "p_toxic", "toxic"],
        )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, severity double, grade int, p_toxic double, toxic boolean"
    return map_slices(text_input(docs, key, text), work, schema)
