import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratasift.llm import language_model as lm
from stratasift.llm.elias_fano import CONTEXT_BITS, EliasFano, Trie
from stratasift.llm.queries import QUERIES


@pytest.mark.parametrize("universe,n", [(1 << 64, 1000), (1 << 20, 5000), (7, 50), (1 << 40, 1), (1 << 30, 0)])
def test_sequences(universe, n):
    rng = np.random.default_rng(0)
    top = min(universe, 1 << 63)
    values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    ef = EliasFano.build(values, universe)
    assert (ef.get(np.arange(n)) == values).all()
    asked = np.unique(np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 50).astype(np.uint64)]))
    asked = asked[asked < np.uint64(universe - 1)]
    assert (ef.successor(asked) == np.searchsorted(values, asked)).all()


def test_trie_through_a_map():
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    sizes = rng.integers(0, 9, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    contexts = np.concatenate([np.sort(rng.choice(1 << CONTEXT_BITS, k, replace=False)) for k in sizes]).astype(np.uint64)
    logs = -rng.random(len(words)) * 8, -rng.random(len(contexts)) * 8
    raw = Trie.build(words, logs[0], starts, contexts, logs[1]).to_bytes()
    trie = Trie.from_map(np.frombuffer(raw, np.uint8))
    assert (trie.find_words(words) == np.arange(len(words))).all()
    assert (trie.find_words(words + np.uint64(1)) == -1).all()
    rank = np.repeat(np.arange(len(words)), sizes)
    assert (trie.find_contexts(rank, contexts) == np.arange(len(contexts))).all()
    assert (trie.find_contexts(rank, contexts ^ np.uint64(1 << 20)) == -1).mean() > 0.99
    assert np.abs(trie.context_log(np.arange(len(contexts))) - logs[1]).max() < 0.05
    assert len(raw) < 8 * (len(words) + len(contexts)) + 8000


def brute(rows):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    token = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for _, t in rows]
    held = [zlib.crc32(str("" if k is None else k).encode()) % 7 == 2 for k, _ in rows]
    c, c2 = Counter(), Counter()
    for x, h in zip(token, held):
        if not h:
            c.update(x)
            c2.update(zip(x, x[1:]))
    n, v = sum(c.values()), len(c)
    for x, h in zip(token, held):
        p = {w: (c[w] + 1) / (n + v + 1) for w in x}
        score = math.log10(p[x[0]])
        for a, b in zip(x, x[1:]):
            plain = c[a] >= lm.COMMON * n and c[a] > 0
            score += math.log10(p[b] if plain else (c2[a, b] + lm.MU * p[b]) / (c[a] + lm.MU))
        yield h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10(p[w]) for w in x), score


def compare(got, want):
    assert [got[k] for k in ("held_out", "n_tokens", "n_known", "train_tokens")] == list(want[:4])
    assert got["base_score"] == pytest.approx(want[4], rel=1e-9)
    assert got["score"] == pytest.approx(want[5], abs=0.02 * want[1])


@pytest.mark.parametrize("common", [1e-5, 1e-2])
def test_query_against_brute_force(spark, sf, documents, common, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", common)
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    if common == 1e-5:
        got = QUERIES["op2_language_model"](spark, sf)
    else:
        got = lm.score_language_model(documents)
    for r, want in zip(got.orderBy("doc_id").collect(), brute(rows), strict=True):
        compare(r, want)


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted(brute(rows), key=lambda x: (x[1], x[2], x[4]))
    got = sorted(lm.score_language_model(odd).collect(), key=lambda r: (r["n_tokens"], r["n_known"], r["base_score"]))
    for r, w in zip(got, want, strict=True):
        compare(r, w)
    assert lm.score_language_model(empty).collect() == []


def test_every_predecessor_is_a_context(spark, monkeypatch):
    """Brute force without any notion of common words, on texts of few words and one hot pair."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["hot pair"] * int(rng.integers(0, 300)) + [f"w{k}" for k in rng.zipf(1.3, 80) if k < 5000])) for i in range(60)]
    token = {i: [*t.split(), None] for i, t in rows}
    c, c2 = Counter(), Counter()
    for i, x in token.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(x)
            c2.update(zip(x, x[1:]))
    p = lambda w: (c[w] + 1) / (sum(c.values()) + len(c) + 1)
    for listed in (lm.LISTED, 1e-2, 2.0):
        monkeypatch.setattr(lm, "LISTED", listed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["score"] for r in lm.score_language_model(docs).collect()}
        for i, x in token.items():
            want = math.log10(p(x[0])) + sum(math.log10((c2[a, b] + lm.MU * p(b)) / (c[a] + lm.MU)) for a, b in zip(x, x[1:]))
            assert got[i] == pytest.approx(want, abs=0.02 * len(x))
