"""Benchmark decontamination: BM25 over the test items, searched with block-max WAND.

The items are the indexed side. An item's BM25 weights are divided by their sum, so an
item's score for a passage is the share of the item's weight whose words the passage holds.
Every passage of every text is a query; items with a score of THRESHOLD or more are
retrieved and verified: five-word runs of the question and words of the answer must be in
the passage to VERIFIED or more.

Items are indexed by length class (up to 16, 32, 64, ... words). For a class of L words,
passages are 2 L words long and start every L words, so an item copied in one stretch lies
whole in some passage. A passage is searched only if some item can reach the threshold: the
rarest words of each item, those above ORDINARY of its weight, are its essential words; the
weights of an item's essential words in the passage are added up for all passages at once,
and the rest of the item's weight is granted.

The index goes to every task. It covers at most BLOCK_ITEMS items and about BLOCK_BYTES of
text; a larger benchmark is worked through in blocks, each against all texts. How many
items hold a word, the number of items and their mean length are counted over all items, so
scores do not depend on the blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.llm.common import ALNUM, map_slices, shingles_of, stored, text_input, words_of

THRESHOLD, ORDINARY, VERIFIED, WIDTH = 0.6, 0.2, 0.8, 5
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
K1, B = 1.2, 0.75
POSTINGS_BLOCK = 32
LEAST_CLASS = 16


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's parts: at "Answer:" if it says so, else the last sentence is the answer."""
    named = re.search(r"(?is)^(.*?)\banswer\s*:(.*)$", text)
    if named and named[1].strip():
        return named[1], named[2]
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _words(text: str) -> np.ndarray:
    return words_of(pa.array([text], pa.string()), ALNUM)[1]


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    return np.unique(shingles_of(np.zeros(len(words), np.int64), words, 1, width)[1])


@dataclass(frozen=True)
class ItemCounts:
    """What BM25 needs to know of all items: how many hold words, their mean length in words,
    and for ascending word hashes (at least a block's) how many items hold the word."""

    items: int
    mean: float
    words: np.ndarray
    often: np.ndarray


class LengthClass:
    """Postings of the items of one length class."""

    def __init__(self, length: int, items: list[int], weights: list[dict[int, float]]):
        self.length = length
        lists: dict[int, list[tuple[int, float]]] = {}
        for i, w in sorted(zip(items, weights)):
            for term, x in w.items():
                lists.setdefault(term, []).append((i, x))
        self.terms = np.array(sorted(lists), dtype=np.int64)
        self.items = [np.array([p[0] for p in lists[t]], dtype=np.int64) for t in self.terms]
        self.weights = [np.array([p[1] for p in lists[t]]) for t in self.terms]
        self.most = np.array([w.max() for w in self.weights])
        self.block_most = [np.maximum.reduceat(w, np.arange(0, len(w), POSTINGS_BLOCK)) for w in self.weights]
        self.place = {int(t): k for k, t in enumerate(self.terms)}

    def essentials(self, often: np.ndarray, n_terms: int) -> None:
        """For each word the items it is essential for; and the rest of each item's weight."""
        item = np.concatenate(self.items)
        weight = np.concatenate(self.weights)
        term = np.repeat(self.terms, [len(x) for x in self.items])
        order = np.lexsort((term, often[term], item))
        item, weight, term = item[order], weight[order], term[order]
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        sums = np.cumsum(weight)
        before = sums - weight - np.repeat(sums[first] - weight[first], np.diff(np.append(first, len(item))))
        needed = 1 - before > ORDINARY
        self.numbers = item[first]
        self.rest = 1 - np.add.reduceat(weight * needed, first)
        number = np.searchsorted(self.numbers, item[needed])
        order = np.argsort(term[needed], kind="stable")
        self.ess_item, self.ess_weight = number[order], weight[needed][order]
        self.ess_start = np.concatenate([[0], np.cumsum(np.bincount(term[needed], minlength=n_terms + 1))])

    def promising(self, cell: np.ndarray, term: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """Passages (numbered by their first cell) that some item may reach."""
        size = self.ess_start[term + 1] - self.ess_start[term]
        some = np.flatnonzero(size)
        pairs = np.unique(cell[some] * len(self.ess_start) + term[some])
        cell, term = pairs // len(self.ess_start), pairs % len(self.ess_start)
        size = self.ess_start[term + 1] - self.ess_start[term]
        at = np.repeat(self.ess_start[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell = np.repeat(cell, size)
        item, weight = self.ess_item[at], self.ess_weight[at]
        again = (cell > 0) & (text_of[np.maximum(cell - 1, 0)] == text_of[cell])
        passage = np.concatenate([cell, cell[again] - 1])
        item, weight = np.concatenate([item, item[again]]), np.concatenate([weight, weight[again]])
        keys, code = np.unique(passage * len(self.rest) + item, return_inverse=True)
        sums = np.bincount(code, weights=weight, minlength=len(keys))
        enough = sums + self.rest[keys % len(self.rest)] >= THRESHOLD - 1e-9
        return np.unique(keys[enough] // len(self.rest))

    def search(self, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All items whose weights of ``terms`` add up to the threshold: block-max WAND.

        Cursors stand on postings lists. With the lists in order of their current item, the
        pivot is the first item that the lists up to it could lift over the threshold by
        their largest weights. If the largest weights of the current blocks cannot, all skip
        to the end of the nearest block; else the pivot is scored.
        """
        lists = [k for t in terms.tolist() if (k := self.place.get(t)) is not None]
        at = dict.fromkeys(lists, 0)
        found: list[tuple[int, float]] = []
        bound = threshold - 1e-12
        here = {k: int(self.items[k][0]) for k in lists}
        while here:
            order = sorted(here, key=here.__getitem__)
            total, pivot = 0.0, -1
            for n, k in enumerate(order):
                total += self.most[k]
                if total >= bound:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = here[order[pivot]]
            while pivot + 1 < len(order) and here[order[pivot + 1]] == item:
                pivot += 1
            front = order[: pivot + 1]
            # blocks that may hold the pivot, without moving the cursors
            spots = {k: at[k] + int(np.searchsorted(self.items[k][at[k] :], item)) for k in front}
            blocks = {k: s // POSTINGS_BLOCK for k, s in spots.items() if s < len(self.items[k])}
            if sum(self.block_most[k][b] for k, b in blocks.items()) >= bound:
                score = sum(
                    float(self.weights[k][s]) for k, s in spots.items() if s < len(self.items[k]) and self.items[k][s] == item
                )
                if score >= bound:
                    found.append((item, score))
                target = item + 1
            else:
                ends = [int(self.items[k][min((b + 1) * POSTINGS_BLOCK, len(self.items[k])) - 1]) for k, b in blocks.items()]
                target = max(item, min(ends)) + 1
                if pivot + 1 < len(order):
                    target = max(item + 1, min(target, here[order[pivot + 1]]))
            for k in front:
                s = at[k] + int(np.searchsorted(self.items[k][at[k] :], target))
                if s < len(self.items[k]):
                    at[k], here[k] = s, int(self.items[k][s])
                else:
                    del here[k]
        return found


class ItemIndex:
    """A block of test items: vocabulary, length classes, and what verification needs."""

    def __init__(self, ids: list, texts: list[str], counts: ItemCounts | None = None):
        """``counts`` are those of all items; without them the block is all there is."""
        self.ids = ids
        bags, keep = [], []
        for i, t in enumerate(texts):
            words = _words(t)
            if len(words):
                keep.append(i)
                bags.append(np.unique(words, return_counts=True))
        self.vocabulary = np.unique(np.concatenate([b[0] for b in bags])) if bags else np.zeros(0, np.uint64)
        terms = [np.searchsorted(self.vocabulary, b[0]) for b in bags]
        if counts is None:
            often = np.bincount(np.concatenate(terms), minlength=len(self.vocabulary)) if bags else np.zeros(0)
            total, mean = len(bags), np.mean([b[1].sum() for b in bags]) if bags else 1.0
        else:
            often = counts.often[np.searchsorted(counts.words, self.vocabulary)]
            total, mean = counts.items, counts.mean
        rarity = np.log1p((total - often + 0.5) / (often + 0.5))
        by_class: dict[int, tuple[list[int], list[dict[int, float]]]] = {}
        self.question: dict[int, tuple[int, np.ndarray]] = {}
        self.answer: dict[int, np.ndarray] = {}
        for i, term, (_, times) in zip(keep, terms, bags):
            size = times.sum()
            w = rarity[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * size / mean))
            length = max(LEAST_CLASS, 1 << int(size - 1).bit_length())
            where = by_class.setdefault(length, ([], []))
            where[0].append(i)
            where[1].append(dict(zip(term.tolist(), (w / w.sum()).tolist())))
            asked, answer = question_and_answer(texts[i])
            asked = _words(asked)
            if not len(asked):
                asked, answer = _words(texts[i]), ""
            width = min(WIDTH, len(asked))
            self.question[i] = (width, _runs(asked, width))
            self.answer[i] = np.unique(_words(answer))
        self.classes = [LengthClass(n, *where) for n, where in sorted(by_class.items())]
        for one in self.classes:
            one.essentials(often, len(self.vocabulary))

    def terms_of(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words in the vocabulary; its size for all others."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary))

    def hits(self, array: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(text's place, item, score, question overlap, answer overlap), the best of each."""
        n = len(array)
        place, words, _, _ = words_of(array, ALNUM)
        terms = self.terms_of(words)
        counts = np.bincount(place, minlength=n)
        starts = np.concatenate([[0], np.cumsum(counts)])
        within = np.arange(len(words)) - starts[place]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for one in self.classes:
            step = one.length
            cells = -(-counts // step)
            base = np.concatenate([[0], np.cumsum(cells)])
            cell = base[place] + within // step
            text_of = np.repeat(np.arange(n), cells)
            for k in one.promising(cell, terms, text_of):
                text = int(np.searchsorted(base, k, "right") - 1)
                a = starts[text] + (k - base[text]) * step
                b = min(a + 2 * step, starts[text + 1])
                passage = words[a:b]
                asked = np.unique(terms[a:b])
                for item, score in one.search(asked[asked < len(self.vocabulary)]):
                    q, r = self.verify(item, passage)
                    if q >= VERIFIED and r >= VERIFIED and (q + r, score) > best.get((text, item), (0.0, 0.0, 0.0))[:2]:
                        best[text, item] = (q + r, score, q)
        for (text, item), (total, score, q) in sorted(best.items()):
            yield text, item, score, q, total - q

    def verify(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the question's runs and of the answer's words in a passage."""
        width, runs = self.question[item]
        q = float(np.isin(runs, _runs(passage, width)).mean()) if len(passage) >= width else 0.0
        answer = self.answer[item]
        return q, float(np.isin(answer, passage).mean()) if len(answer) else 1.0


def _item_words(part: pa.RecordBatch) -> pa.RecordBatch:
    """(block, word hash) of each different word of each item."""
    place, words, _, _ = words_of(part.column("text"), ALNUM)
    pairs = np.unique(np.stack([place.astype(np.int64), words.view(np.int64)]), axis=1)
    block = part.column("block").take(pa.array(pairs[0]))
    return pa.RecordBatch.from_arrays([block, pa.array(pairs[1])], names=["block", "word"])


def _item_sizes(part: pa.RecordBatch) -> pa.RecordBatch:
    """The number of words of each item that has any."""
    place, _, _, _ = words_of(part.column("text"), ALNUM)
    sizes = np.bincount(place, minlength=len(part)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(sizes[sizes > 0])], names=["size"])


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[ItemIndex]:
    """Indexes over blocks of the items; each block's size is bounded.

    Of the words' counts over all items, the driver reads those of one block at a time.
    """
    rows = text_input(items, key, text)
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    many = max(1, -(-n // (BLOCK_ITEMS // 2)), -(-(size or 0) // (BLOCK_BYTES // 2)))
    if many == 1:
        got = rows.orderBy("key", "text").collect()
        yield ItemIndex([r["key"] for r in got], [r["text"] for r in got])
        return
    block = F.pmod(F.xxhash64("key", "text"), F.lit(many)).alias("block")
    dealt = stored(rows.select("key", "text", block), "items")
    sizes = map_slices(dealt, _item_sizes, "size long")
    total, length = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    in_block = map_slices(dealt, _item_words, "block long, word long")
    in_block = stored(in_block.groupBy("block", "word").agg(F.count("*").alias("held")), "item-words")
    often = in_block.groupBy("word").agg(F.sum("held").alias("often"))
    words = stored(in_block.select("block", "word").join(often, "word"), "item-counts")
    for b in range(many):
        got = dealt.where(F.col("block") == b).orderBy("key", "text").collect()
        table = words.where(F.col("block") == b).select("word", "often").toArrow()
        hashes = table["word"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        counts = ItemCounts(total, length / max(total, 1), hashes[order], table["often"].to_numpy()[order])
        yield ItemIndex([r["key"] for r in got], [r["text"] for r in got], counts)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(key, item_key, score, question_overlap, answer_overlap) for every leaked item of every row.

    Whole texts. Null and empty texts and items hold nothing; repeated rows are reported
    each, repeated items under each of their keys; without leaks the result is empty.
    """
    rows = text_input(docs, key, text)
    kind, item_kind = (d.schema[k].dataType.simpleString() for d, k in ((docs, key), (items, item_key)))
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, score double, question_overlap double, answer_overlap double"
    found = None
    for index in item_blocks(items, item_key):
        share = docs.sparkSession.sparkContext.broadcast(index)

        def work(part: pa.RecordBatch, share=share) -> pa.RecordBatch:
            hits = list(share.value.hits(part.column("text")))
            keys = part.column("key").take(pa.array([h[0] for h in hits], pa.int64()))
            ids = pa.array([share.value.ids[h[1]] for h in hits], item_type)
            rest = [pa.array([h[i] for h in hits], pa.float64()) for i in (2, 3, 4)]
            return pa.RecordBatch.from_arrays([keys, ids, *rest], names=[key, item_key, "score", "question_overlap", "answer_overlap"])

        item_type = pa.string() if item_kind == "string" else {"int": pa.int32()}.get(item_kind, pa.int64())
        hits = map_slices(rows, work, schema)
        found = hits if found is None else found.unionAll(hits)
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of ``docs`` whose text holds no test item; all columns as they were."""
    kept = docs
    for index in item_blocks(items, item_key):
        share = docs.sparkSession.sparkContext.broadcast(index)

        def work(part: pa.RecordBatch, share=share) -> pa.RecordBatch:
            clean = np.ones(len(part), dtype=bool)
            clean[[h[0] for h in share.value.hits(part.column(text))]] = False
            return part.filter(pa.array(clean))

        kept = map_slices(kept, work, kept.schema, text)
    return kept
