import random

import pytest
from fixed import sizes

from stratasift import round_stats, stratified_sample, stratum_stats
from stratasift.functions.priority import priority

KEYS = [("a,b", "c"), ("a", "b,c"), ("é", "x"), ("日", "x"), ("Z", ""), (None, "x"), ("z", "y z")]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        g, h = rng.choice(KEYS)
        text = rng.choice(["", None, "bad"]) if i % 50 == 0 else f"{rng.lognormvariate(3, 1):.3f}"
        rows.append((i, g, h, text, f"payload {i}"))
    return spark.createDataFrame(rows, "id int, g string, h string, v string, note string")


def brute_force(data, budget, seed, digits, weights=None):
    """Statistics, sizes and sampled ids worked out on the driver."""
    strata = {}
    for r in data.withColumn("p", priority(seed, ["id"])).collect():
        if r.g and r.h and r.v and r.v != "bad":
            strata.setdefault((r.g, r.h), []).append((r.p, r.id, float(r.v)))
    rows = []
    for key, members in strata.items():
        values = [m[2] for m in members]
        mean = sum(values) / len(values)
        std = (sum((x - mean) ** 2 for x in values) / len(values)) ** 0.5
        rows.append((",".join(key), key, round(mean, digits), round(std, digits), len(values)))
    # Keys that join to one text are told apart by the columns themselves.
    order = sorted(rows)
    size = sizes([((r[0], r[1]), *r[2:]) for r in order], budget, weights)
    return {
        key: (size[text, key], sorted(m[1] for m in sorted(strata[key])[: size[text, key]]))
        for text, key, *_ in order
    }


@pytest.mark.parametrize("budget,seed,weights", [(60, 1, None), (400, 2, None), (90, 3, [1, 4, 0, 9, 2])])
def test_against_brute_force(data, budget, seed, weights):
    want = brute_force(data, budget, seed, 6, weights)
    run = stratified_sample(
        data, ["g", "h"], "v", budget, ["id"], ["note"], weights, seed, digits=6
    )
    assert run.sample.columns == ["g", "h", "id", "note", "v"]
    got = {}
    for r in run.sample.collect():
        assert r.note == f"payload {r.id}"
        got.setdefault((r.g, r.h), []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {(r.g, r.h): r.si for r in run.allocation.collect()} == {k: v[0] for k, v in want.items()}
    report = run.report().collect()
    assert sum(r.sample_n for r in report) == budget == sum(r.si for r in report)


def test_stored_statistics_and_positions(data):
    stats = round_stats(stratum_stats(data, ["g", "h"], "v"), 6)
    one = stratified_sample(data, ["g", "h"], "v", 60, ["id"], seed=1, digits=6)
    other = stratified_sample(data, [2, 3], 4, 60, [1], seed=1, stats=stats, method="skip")
    assert one.sample.exceptAll(other.sample).count() == 0
    assert other.sample.count() == 60


def test_every_row_when_the_budget_is_the_table(data):
    n = stratum_stats(data, ["g", "h"], "v").agg({"n": "sum"}).first()[0]
    run = stratified_sample(data, ["g", "h"], "v", n, ["id"])
    assert run.sample.count() == n
    assert run.report().where("si != n or sample_n != n or abs(mean - sample_mean) > 1e-9").count() == 0
