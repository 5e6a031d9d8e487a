import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratasift.llm import quality as ql
from stratasift.llm import severity as sv
from stratasift.llm.common import read_table
from stratasift.llm.labelled import label_sample
from stratasift.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def test_quality_of_held_out_rows(spark):
    rows = QUERIES["op8_quality"](spark, LARGER)
    assert rows.columns[:2] == ["doc_id", "held_out"]
    both = rows.join(read_table(spark, LARGER, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in both]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in both)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(ql.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = ql.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    assert (0, 1) in {(min(i, j), max(i, j)) for i, j, _ in model.pairs}


@pytest.mark.parametrize("labels,want", [([], 0.5), ([1.0] * 5, 0.9), ([0.0] * 5, 0.1)])
def test_quality_without_two_classes(labels, want):
    score = ql.fit(np.zeros((len(labels), len(ql.FEATURES))), np.array(labels)).score(ql.features(pa.array(["a b"])))[0]
    assert abs(score - want) < 0.1 or (score > 0.9) == (want > 0.5)


def test_features_do_not_depend_on_neighbours():
    texts = ["A b.\nA b.\nccc 12", "", "é ö" * 50, "x" * 3000, None, "one two one two one two"]
    whole = ql.features(pa.array(texts))
    for t, row in zip(texts, whole):
        assert np.allclose(ql.features(pa.array([t], pa.string()))[0], row)


def toxic_rows(n, rng):
    words = [f"w{i}" for i in range(400)]
    for i in range(n):
        body = list(rng.choice(words, rng.integers(20, 80)))
        bad = int(rng.integers(1, 9)) if i % 4 == 0 else 0
        for _ in range(bad):
            body.insert(int(rng.integers(len(body))), str(rng.choice(["foobad", "barbad", "grubly", "grubler"])))
        yield i, " ".join(body), bad


def test_severity_grows_with_the_amount():
    rows = list(toxic_rows(1200, np.random.default_rng(4)))
    counted = sv.word_counts(pa.array([t for _, t, _ in rows[:800]]))
    model = sv.fit(*counted, np.array([b > 0 for *_, b in rows[:800]]))
    assert (np.diff(model.thresholds) > 0).all()
    above = model.above(pa.array([t for _, t, _ in rows[800:]]))
    bad = np.array([b for *_, b in rows[800:]])
    assert (np.diff(above, axis=1) <= 0).all()
    assert ((above[:, 0] >= 0.5) == (bad > 0)).mean() > 0.98
    assert np.corrcoef(above.sum(1)[bad > 0], bad[bad > 0])[0, 1] > 0.7


def test_severity_query(spark):
    rows = QUERIES["op1_severity"](spark, LARGER).join(
        read_table(spark, LARGER, "labels").withColumnRenamed("toxic", "label"), "doc_id"
    )
    got = rows.collect()
    assert np.mean([r["severity"] for r in got if r["label"]]) > 3 * np.mean([r["severity"] for r in got if not r["label"]])


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", LARGER])
def test_every_grade_occurs(spark, sf_dir):
    """In equal shares of the toxic rows, from few labelled rows as from many."""
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, sf_dir, "documents").collect()}
    labels = [r for r in read_table(spark, sf_dir, "labels").collect() if r["doc_id"] in texts]
    toxic = np.array([r["toxic"] == 1 for r in labels])
    counted = sv.word_counts(pa.array([texts[r["doc_id"]] or "" for r in labels]))
    grades = sv.grade_rows(*counted, toxic)[0]
    assert (grades[~toxic] == 0).all()
    shares = np.bincount(grades[toxic], minlength=sv.GRADES)[1:] / toxic.sum()
    assert len(shares) == sv.GRADES - 1 and (shares > 0.2).all() and (shares < 0.5).all()
    model = sv.fit(*counted, toxic)
    own = model.above(pa.array([texts[r["doc_id"]] or "" for r in labels])).sum(1)
    means = [own[grades == g].mean() for g in range(sv.GRADES)]
    assert means == sorted(means) and means[-1] > means[1] + 0.3


@pytest.mark.parametrize("amounts,want", [
    ([], []), ([5.0], [0]), ([1.0, 1.0], [0, 0]), ([1.0, 2.0, 2.0], [0, 1, 1]), ([3.0, 1.0, 2.0], [2, 0, 1]),
    ([0.0] * 8 + [1.0, 2.0, 3.0, 4.0], [1] * 8 + [2] * 4), (list(range(9)), [0] * 3 + [1] * 3 + [2] * 3),
])
def test_grades_go_by_rank(amounts, want):
    assert sv._by_rank(np.array(amounts, dtype=float)).tolist() == want


def naive_probabilities(model, text):
    """P(grade > k) of one text, feature by feature."""
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    found = {}
    for word in re.findall(r"(?:[^\x00-\x7F]|[a-z0-9])+", lowered):
        kinds = [list(hashes) for _, hashes in sv.word_features(pa.array([word]))]
        assert [len(k) for k in kinds] == [1] + [int(len(word.encode()) > k) for k in sv.PREFIXES]
        asked = [int(x) for k in kinds for x in k]
        for f in asked:
            found[f] = found.get(f, 0) + 1
    weights = dict(zip(model.words.tolist(), model.weights.tolist()))
    signal = sum(weights.get(f, 0.0) * math.log(1 + n) for f, n in found.items())
    return [1 / (1 + math.exp(-(signal - t))) for t in model.thresholds]


def test_severity_equals_sums_feature_by_feature():
    rows = list(toxic_rows(300, np.random.default_rng(5)))
    model = sv.fit(*sv.word_counts(pa.array([t for _, t, _ in rows])), np.array([b > 0 for *_, b in rows]))
    texts = [t.upper() + " É foobad, barbad-grubly" for _, t, _ in rows[:20]] + ["", "x"]
    assert np.allclose(model.above(pa.array(texts)), [naive_probabilities(model, t) for t in texts])


def test_label_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (5, 0), (6, None)], "doc_id long, toxic int")
    rows = label_sample(labels, "toxic", 10).collect()
    assert sorted(r["label"] for r in rows) == [0] * 10 + [1] * 10
    assert label_sample(labels, "toxic", 1000).where("key = 5").first()["label"] == 0


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = ql.learn_quality(odd, labels)
    assert ql.score_quality(odd, model, F.lit(True).alias("held_out")).count() == 7
    kept = ql.drop_low_quality(odd, model)
    assert kept.columns == odd.columns
    assert ql.score_quality(empty, ql.learn_quality(empty, labels)).collect() == []
    grades = sv.grade_severity(odd, sv.learn_severity(odd, labels)).collect()
    assert len(grades) == 7 and all(0 <= r["severity"] <= sv.GRADES - 1 for r in grades)
    assert sv.grade_severity(empty, sv.learn_severity(empty, labels)).collect() == []


def test_quality_keeps_the_ratio_of_the_classes(spark):
    """Seven in ten labels are 1 whatever the text; the sample holds as many of each."""
    docs = spark.createDataFrame([(i, f"a b c {i % 7}") for i in range(1000)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 10 < 7 as int) AS quality")
    for per_class in (100, 500, 10_000):
        model = ql.learn_quality(docs, labels, per_class=per_class)
        assert ql.score_quality(docs, model).agg(F.avg("score")).first()[0] == pytest.approx(0.7, abs=0.02)


@pytest.mark.parametrize("sf_dir,least", [("/root/testdata/sf0.001", 1.0), (LARGER, 0.85)])
def test_severity_finds_toxic_rows_of_every_language(spark, sf_dir, least):
    labels = read_table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label")
    langs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = QUERIES["op1_severity"](spark, sf_dir).join(labels, "doc_id").join(langs, "doc_id").collect()
    found = {}
    for r in rows:
        if r["label"]:
            found.setdefault(r["lang"], []).append(r["toxic"])
    assert np.mean(sum(found.values(), [])) >= least and all(any(x) for x in found.values())
    assert np.mean([r["toxic"] for r in rows if not r["label"]]) < 0.03


def test_copies_of_one_text_count_once():
    texts = ["same bad text"] * 5 + [f"other bad{i} word" for i in range(5)]
    model = sv.fit(*sv.word_counts(pa.array(texts)), np.arange(10) < 5)
    asked = lambda w: sv.word_counts(pa.array([w]))[1]
    assert not np.isin(asked("same"), model.words).any() and np.isin(asked("other"), model.words).any()
