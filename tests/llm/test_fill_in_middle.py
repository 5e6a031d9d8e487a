import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratasift.llm.fill_in_middle import boundaries, fill_in_middle, restored
from stratasift.llm.queries import QUERIES
from stratasift.llm.rank_index import fit

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def naive(doc_id, text, marks=("<P>", "<S>", "<M>")):
    """The contract, step by step, for one row."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    p, s, m = marks
    if not text or any(x in text for x in marks) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_brute_force(spark, sf, documents):
    got = QUERIES["op11_fill_in_middle"](spark, sf).orderBy("doc_id").collect()
    forms = set()
    for r, d in zip(got, documents.orderBy("doc_id").collect(), strict=True):
        n, form, a, b, output = naive(d["doc_id"], d["text"])
        assert tuple(r) == (d["doc_id"], n, form, a, b, sha(output), sha(d["text"] or ""))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd, empty):
    more = [(i, t) for i, t in enumerate(["<P>", "a<S>b", "<<M>", "é中\U0001f600x", "<", "\n\n", "ab", "<P", "M>" * 9])]
    docs = odd.select("doc_id", "text", F.lit("x").alias("form"), F.lit(1).alias("h1"), F.lit(2).alias("n"))
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    out = fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    text = lambda r: (str(r[0]), *map(str, r[1:]))
    want = sorted(map(text, [(d["doc_id"], *naive(d["doc_id"], d["text"])) for d in docs.collect()]))
    assert sorted(map(text, out.collect())) == want
    back = out.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert fill_in_middle(empty).collect() == []


def test_shares_and_marks(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('word ', id) as text")
    out = fill_in_middle(docs, transformed=50, suffix_first=50, marks=("[PRE]", "[SUF]", "[MID]")).toPandas()
    shares = out["form"].value_counts(normalize=True)
    assert abs(shares["plain"] - 0.5) < 0.03 and abs(shares["spm"] - 0.25) < 0.03
    assert out[out["form"] == "psm"]["output"].str.startswith("[PRE]").all()
    with pytest.raises(ValueError, match="told apart"):
        fill_in_middle(docs, marks=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError, match="told apart"):
        fill_in_middle(docs, marks=("ab", "bc", "<M>"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab-. é中\U0001f600\n", max_size=40), max_size=8))
def test_boundaries(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    cuts, starts = boundaries(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, text in enumerate(texts):
        want = np.cumsum([offsets[i], *(len(u.encode()) for u in UNIT.findall(text))])
        assert cuts[starts[i] : starts[i + 1]].tolist() == want.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 1, 2, 5, 400, 10**6]), max_size=60), max_size=6), st.integers(1, 126))
def test_index_gives_every_offset(steps, bound):
    texts = [np.cumsum([3, *s]) for s in steps]
    starts = np.cumsum([0, *map(len, texts)])
    offsets = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    index = fit(offsets, starts, bound, span=16)
    assert index.offsets(np.arange(len(offsets))).tolist() == offsets.tolist()
    assert len(offsets) == 0 or np.abs(index.residual).max() <= bound + 1


def test_index_is_small_for_text():
    """Long runs of words fit few lines: about a byte a boundary."""
    lengths = np.random.default_rng(1).choice([1, 1, 1, 3, 5, 9], 300_000)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index = fit(offsets, np.array([0, len(offsets)]))
    assert index.nbytes < 1.2 * len(offsets) and len(index.first) < len(offsets) / 200
    even = fit(np.arange(100_000) * 7, np.array([0, 100_000]))
    assert len(even.first) == -(-100_000 // 8192)
