import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from stratasift.llm import digest as d
from stratasift.llm.queries import QUERIES


def test_levels_are_entropies():
    data = np.random.default_rng(0).integers(97, 105, 900).astype(np.uint8)
    data[100:200] = 65
    levels = d.window_levels(data)
    assert len(levels) == 900 - d.WINDOW + 1
    for i, level in enumerate(levels):
        counts = np.bincount(data[i : i + d.WINDOW])
        assert level == (d._MOST - int(d._TERM[counts].sum())) * d.LEVELS // d._MOST


def test_selected_windows_win_their_neighbourhoods():
    ranks = np.random.default_rng(1).integers(0, 50, 300).astype(np.int32)
    wins = np.zeros(300, int)
    for s in range(300 - d.WINDOW + 1):
        wins[s + int(np.argmin(ranks[s : s + d.WINDOW]))] += 1
    got = d.select_windows(ranks, np.ones(300, bool))
    assert got.tolist() == np.flatnonzero(wins >= d.POPULAR).tolist()


def test_a_fingerprint_does_not_depend_on_its_neighbours():
    ranks = np.arange(d.LEVELS + 1, dtype=np.int32)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh xyz"), rng.integers(0, 900))) for _ in range(40)]
    alone = [d.fingerprints(pa.array([t]), ranks)[0] for t in texts]
    for a, b in zip(alone, d.fingerprints(pa.array(texts), ranks)):
        assert np.array_equal(a, b)
    assert d.from_text(d.to_text(alone[3])).tolist() == alone[3].tolist()
    assert d.likeness(alone[3], alone[3]) == 1.0


def test_query(spark, sf, documents):
    texts = [r["text"] for r in documents.orderBy("doc_id").collect()]
    rows = QUERIES["op5_digests"](spark, sf).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    by_text = {}
    for i, r in enumerate(rows):
        a, b = texts[i], texts[(i + 1) % len(texts)]
        half = len(a) // 2
        assert r["n_chars"] == len(a)
        assert r["edited_sha256"] == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()
        assert by_text.setdefault(a, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.9


def test_ranges_meet(spark):
    rows = [(i * 7 % 101, f"text number {i} " * (i % 9)) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = {tuple(r) for r in d.digest_report(df, rows_per_range=10).collect()}
    assert few == {tuple(r) for r in d.digest_report(df, rows_per_range=1000).collect()}


def naive_levels(data):
    windows = [Counter(data[i : i + d.WINDOW]) for i in range(len(data) - d.WINDOW + 1)]
    return [(d._MOST - sum(int(d._TERM[n]) for n in w.values())) * d.LEVELS // d._MOST for w in windows]


def naive_starts(ranks):
    """The windows of one text that win POPULAR neighbourhoods, else its rarest one."""
    wins = Counter()
    for s in range(len(ranks) - d.WINDOW + 1):
        best = min(range(s, s + d.WINDOW), key=lambda i: (ranks[i], i))
        wins[best] += ranks[best] < d._NONE
    chosen = sorted(i for i, n in wins.items() if n >= d.POPULAR)
    return chosen or [min(range(len(ranks)), key=lambda i: (ranks[i], i))]


def naive_filters(text, rank_of):
    """Filters of one text as sets of bits."""
    data = text.encode()
    if not data:
        return []
    if len(data) < d.WINDOW:
        hashes = [int(x) for x in d._short_hash(data)]
    else:
        starts = naive_starts([rank_of[x] for x in naive_levels(data)])
        hashes = [int(x) for x in d.feature_hashes(np.frombuffer(data, np.uint8), np.array(starts))]
    groups = [hashes[i : i + d.PER_FILTER] for i in range(0, len(hashes), d.PER_FILTER)]
    return [{(h >> 11 * i) % d.BITS for h in g for i in range(d.HASHES)} for g in groups]


def naive_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    best = []
    for x in a:
        each = []
        for y in b:
            chance, most = len(x) * len(y) / d.BITS, min(len(x), len(y))
            each.append(min(1, max(0, (len(x & y) - chance) / max(most - chance, 1e-9))))
        best.append(max(each))
    return sum(best) / len(a)


def test_fingerprints_and_likenesses_against_brute_force(spark, documents):
    """The report's fingerprints and likenesses, window by window and bit by bit."""
    texts = [r["text"] or "" for r in documents.orderBy("doc_id").limit(40).collect()]
    texts = [t[:700] for t in texts] + ["", "short", "ab" * 400, texts[0][:700]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter(x for t in texts for x in naive_levels(t.encode()))
    rank_of = {x: r for r, x in enumerate(sorted(range(d.LEVELS + 1), key=lambda x: (counts[x], x)))}
    rank_of |= {x: d._NONE for x in range(d.LEAST_LEVEL)}
    for i, r in enumerate(d.digest_report(docs, rows_per_range=9).orderBy("doc_id").collect()):
        a, b = texts[i], texts[(i + 1) % len(texts)]
        half = len(a) // 2
        own, new, after = (naive_filters(t, rank_of) for t in (a, a[: len(a) - half] + b[:half], b))
        for column, want in (("fingerprint", own), ("edited_fingerprint", new)):
            bits = np.unpackbits(d.from_text(r[column]), axis=1)
            assert [set(np.flatnonzero(x).tolist()) for x in bits] == want
        assert abs(r["near_edited"] - naive_likeness(own, new)) < 1e-9
        assert abs(r["near_next"] - naive_likeness(own, after)) < 1e-9


def test_a_hot_key_fills_several_ranges(spark):
    """A third of the rows have one key, a third none: order and successors stay whole."""
    keys = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(300)]
    rows = [(k, f"text {i * 31 % 997} of some rows " * 3) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranged, _ = d.in_ranges(d.text_input(df), "key", 20)
    found = ranged.collect()
    size = {}
    for r in found:
        size[r["range"]] = size.get(r["range"], 0) + 1
    assert len(size) > 10 and max(size.values()) < 60
    order = sorted(found, key=lambda r: (r["key"] is not None, r["key"] or 0, r["tie"], r["text"]))
    assert [r["range"] for r in order] == sorted(r["range"] for r in found)
    want = set()
    for a, b in zip(order, order[1:] + order[:1]):
        half = len(a["text"]) // 2
        want.add((a["key"], hashlib.sha256((a["text"][: len(a["text"]) - half] + b["text"][:half]).encode()).hexdigest()))
    got = {tuple(r) for r in d.digest_report(df, rows_per_range=20).select("doc_id", "edited_sha256").collect()}
    assert got == want


def test_odd_rows(odd, empty):
    rows = d.digest_report(odd).collect()
    assert len(rows) == 7 and [r["n_chars"] for r in rows if r["doc_id"] == 3] == [0]
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert d.digest_report(empty).collect() == []
