import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratasift.llm.common import read_table
from stratasift.llm.importance import append, bucket_counts, features, gains, resample, word_crcs, words_in
from stratasift.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def buckets_of(text, buckets=10_000):
    words = WORD.findall((text or "").translate(UPPER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def naive(docs, target, percent=5, least=20):
    """The contract over plain lists of (doc_id, text)."""
    made = [(k, *buckets_of(t)) for k, t in docs]
    s, t = Counter(), Counter()
    for _, _, b in made:
        s.update(b)
    for text in target:
        t.update(buckets_of(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)
    ]
    rows = []
    for k, n, b in made:
        weight = sum(gain[x] for x in b)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((k, n, len(b), weight, weight + noise))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    out = [(r[0], *r[2:], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return out + [(r[0], *r[2:], None) for r in rows if r[1] < least]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_query_against_brute_force(spark, sf, documents):
    target = [r.text for r in read_table(spark, sf, "benchmark").collect()]
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    got = QUERIES["op12_importance"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert plain(got.collect()) == plain(naive(docs, target))


def test_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([("a b c\nword word",), (None,), ("",)], "text string")
    docs = odd.withColumn("rank", F.lit(7)).withColumn("weight", F.lit("w"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = naive(rows, ["a b c\nword word", None, ""], percent=50)
    assert plain(resample(docs, target, percent=50).collect()) == plain(want)
    assert plain(resample(docs, target.limit(0)).collect()) == plain(naive(rows, []))
    assert resample(empty, target).collect() == []


def test_ranks_over_partitions_equal_one_task(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('w', id % 5, repeat(' a b', 15)) as text")
    docs = docs.unionAll(docs.limit(30))
    one = resample(docs, docs.limit(3), percent=40)
    monkeypatch.setattr("stratasift.operators.ranking.global_rank.__defaults__", (10,))
    many = resample(docs, docs.limit(3), percent=40)
    assert plain(one.collect()) == plain(many.collect())
    assert sorted(r["rank"] for r in many.collect() if r["rank"]) == list(range(1, 173))


ALPHABET = ["a", "B", "c9", "é", "中", "x" * 70, "-", " ", "\n", "\n\n", "\t", "\0", "the", "of"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), max_size=5))
def test_lines_and_what_spans_them_add_up(texts):
    array = pa.array(texts, pa.string())
    lines = [(i, line) for i, t in enumerate(texts) for line in t.split("\n")]
    place, bucket = features(words_in(pa.array([line for _, line in lines], pa.string())), False)
    got = Counter((lines[p][0], b) for p, b in zip(place.tolist(), bucket.tolist()))
    got.update(zip(*(x.tolist() for x in features(words_in(array, borders=True), True))))
    want = Counter((i, b) for i, t in enumerate(texts) for b in buckets_of(t)[1])
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90), min_size=1, max_size=12))
def test_checksums(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts])
    first = np.cumsum(lengths) - lengths
    crc = word_crcs(data, first, lengths)
    assert crc.tolist() == [zlib.crc32(p) for p in parts]
    joined = append(crc[:-1], crc[1:], lengths[1:])
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:])]


def test_counts_of_repeated_lines(spark):
    line = "never gonna give you up"
    docs = spark.createDataFrame([(f"{line}\n{line}",)] * 50 + [("other words here",), (None,)], "text string")
    got = {r.bucket: r.n for r in bucket_counts(docs).collect()}
    want = Counter()
    for r in docs.collect():
        want.update(buckets_of(r.text)[1])
    assert got == want
    plan = bucket_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan  # equal lines are counted before they are shuffled


def test_gain_of_an_unseen_table():
    assert gains(np.zeros(4, int), np.zeros(4, int)).tolist() == [0] * 4
    assert gains(np.array([3, 0]), np.array([0, 3])).tolist() == [-1387, 1386]
