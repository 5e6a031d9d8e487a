import re

import numpy as np

from stratasift.llm import decontaminate as dc
from stratasift.llm.common import read_table
from stratasift.llm.queries import QUERIES


def plain(text):
    return " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower()))


def test_search_finds_all_above_the_threshold():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(5, 60)) % 300) for _ in range(150)]
    index = dc.ItemIndex(list(range(150)), texts)
    for one in index.classes:
        for _ in range(12):
            asked = rng.choice(one.terms, min(len(one.terms), int(rng.integers(3, 80))), replace=False)
            sums: dict[int, float] = {}
            for t in asked:
                k = one.place[int(t)]
                for i, w in zip(one.items[k], one.weights[k]):
                    sums[int(i)] = sums.get(int(i), 0.0) + w
            for threshold in (0.1, 0.3, 0.6):
                want = {i: round(s, 9) for i, s in sums.items() if s >= threshold - 1e-12}
                assert {i: round(s, 9) for i, s in one.search(asked, threshold)} == want


def test_query_against_brute_force(spark, sf, documents):
    items = read_table(spark, sf, "benchmark").collect()
    want = {
        (d["doc_id"], i["item_id"])
        for d in documents.collect()
        for i in items
        if f" {plain(i['text'])} " in f" {plain(d['text'])} "
    }
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_leaks"](spark, sf).collect()}
    assert want and got == want


def test_parts_and_order(spark):
    item = "what is the tallest of all the hills in this land? Answer: the green hill by the sea"
    q, a = dc.question_and_answer(item)
    assert q.startswith("what") and "sea" in a
    filler = " ".join(f"f{i}" for i in range(400))
    rows = [
        (1, f"{filler} {item.upper()} {filler}"),
        (2, f"{filler} {q} {filler}"),  # without the answer
        (3, f"{filler} the green hill by the sea {filler}"),  # without the question
        (4, " ".join(reversed(item.split()))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (8, "unlike " * 40), (7, None), (6, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect()] == [(1, 9)]
    assert sorted(r["doc_id"] for r in dc.drop_leaks(docs, items).collect()) == [2, 3, 4]


def test_blocks_of_items_give_the_same(spark, sf, documents, monkeypatch):
    items = read_table(spark, sf, "benchmark")
    whole = {(r[0], r[1]) for r in dc.find_leaks(documents, items).collect()}
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 20)
    assert {(r[0], r[1]) for r in dc.find_leaks(documents, items).collect()} == whole


def test_scores_do_not_depend_on_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [" ".join(f"w{int(x) % 400}" for x in rng.zipf(1.2, rng.integers(12, 40))) for _ in range(60)]
    items = spark.createDataFrame([*enumerate(words), (60, None), (61, ""), (62, words[0])], "item_id long, text string")
    # copies of the first 85% to 100% of an item, around the threshold of 0.6 and above it
    texts = [" ".join(t.split()[: int(len(t.split()) * share)]) for t in words for share in (0.6, 0.85, 0.9, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def scores():
        return sorted((r[0], r[1], round(r[2], 12)) for r in dc.find_leaks(docs, items).collect())

    once = scores()
    assert len(once) >= 60
    for block in (40, 4):  # 4 and 32 blocks
        monkeypatch.setattr(dc, "BLOCK_ITEMS", block)
        assert scores() == once


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b c"), (None, "word " * 20)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.find_leaks(odd, items).collect() if r["item_id"]) == [(1, 1), (1, 1)]
    kept = dc.drop_leaks(odd, items.where("item_id = 1"))
    assert kept.columns == odd.columns and kept.count() == 5
    assert dc.find_leaks(empty, items).collect() == []
    assert dc.find_leaks(odd, items.limit(0)).collect() == []
