import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from stratasift.llm import near_dups as nd
from stratasift.llm.components import components
from stratasift.llm.queries import QUERIES


def bag(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    return Counter(runs)


def similar(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(rows):
    bags = [bag(t) for _, t in rows]
    holders = defaultdict(set)
    for i, b in enumerate(bags):
        for run in b:
            holders[run].add(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, b in enumerate(bags):
        near = set().union(*(holders[r] for r in b)) if b else set()
        for j in near:
            if j < i and similar(b, bags[j]) >= 0.8:
                root[find(i)] = find(j)
        for j in range(i) if not b else ():
            if rows[j][1] == rows[i][1]:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    return {k: min(g) for g in groups.values() for k in g}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    a, b = [], []
    for _ in range(150):
        x = list(rng.choice(words, rng.integers(3, 90)))
        y = list(x)
        for _ in range(rng.integers(0, 8)):
            y[rng.integers(len(y))] = rng.choice(words)
        if rng.random() < 0.5:
            x, y = x * 3, y * int(rng.integers(1, 6))
        a.append(" ".join(x))
        b.append(" ".join(y))
    true = np.array([similar(bag(x), bag(y)) for x, y in zip(a, b)])
    assert np.allclose(nd.multiset_similarity(pa.array(a), pa.array(b)), true)
    own, other = (nd.signatures(*nd.weighted_shingles(pa.array(t)), len(t), 256) for t in (a, b))
    share = (own == other).mean(1)
    assert abs((share - true).mean()) < 0.01
    assert np.sqrt(((share - true) ** 2).mean()) < 1.3 * np.sqrt((true * (1 - true) / 256).mean())
    one = nd.signatures(*nd.weighted_shingles(pa.array(a[:1])), 1, 256)
    assert (one[0] == own[0]).all()


def test_query_against_brute_force(spark, sf, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op9_near_dups"](spark, sf).collect()}
    assert got == classes(rows)


def test_a_large_group_of_variants(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(150)] = "".join(rng.choices("ijklmnop", k=5))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(rows)
    assert all(r["keep"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_odd_rows(odd, empty):
    rows = nd.near_duplicates(odd).collect()
    assert len(rows) == 7
    assert {r["class_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    kept = nd.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    # the null text is a copy of the empty one
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4]
    assert nd.near_duplicates(empty).collect() == []


def test_a_group_of_variants_against_brute_force(spark):
    """One text in 250 edited forms, many just below or above the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(250):
        words = list(base)
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            words[at] = f"x{rng.integers(40)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    i, j = np.triu_indices(len(texts), 1)
    similar = nd.multiset_similarity(pa.array([texts[x] for x in i]), pa.array([texts[x] for x in j]))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(i[similar >= 0.8].tolist(), j[similar >= 0.8].tolist()):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: find(x) for x in range(len(texts))}


def test_columns_of_any_name_stay(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, 5, "a", 1, 2, 3), (1, text, 4, "b", 1, 2, 3), (2, text, 3, "c", 1, 2, 3), (None, None, 1, "d", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h0 int, node string, label int, `a.b` int, mark int")
    out = nd.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == 2 and all(r in rows for r in got)
    again = sorted(map(tuple, nd.drop_near_duplicates(docs.orderBy("_h0")).collect()), key=str)
    assert again == got
