import random

import pytest
from fixed import STRATA, sizes

from stratasift import allocate, shares

SCHEMA = "stratum string, mean double, std double, n bigint"


def table(spark, rows):
    return spark.createDataFrame([tuple(r[:4]) for r in rows], SCHEMA)


def allocated(spark, rows, budget, **options):
    out = allocate(table(spark, rows), ["stratum"], budget, **options)
    assert out.columns == ["stratum", "mean", "std", "n", "si"]
    return {r.stratum: r.si for r in out.collect()}


def test_published_statistics(spark):
    assert allocated(spark, STRATA, 150) == {r[0]: r[4] for r in STRATA}


@pytest.mark.parametrize("budget", [15, 20, 436])
def test_other_budgets(spark, budget):
    got = allocated(spark, STRATA, budget)
    expected = {
        15: dict.fromkeys(got, 1),
        20: dict.fromkeys(got, 1)
        | {"CL,pm25,µg/m³": 2, "CL,so2,µg/m³": 4, "IN,so2,µg/m³": 2},
        436: {r[0]: r[3] for r in STRATA},
    }
    assert got == expected[budget]


@pytest.mark.parametrize("budget,word", [(437, "larger"), (14, "smaller")])
def test_impossible_budgets(spark, budget, word):
    with pytest.raises(ValueError, match=word):
        allocated(spark, STRATA, budget)


def test_repeated_stratum_is_refused(spark):
    with pytest.raises(ValueError, match="16 statistics rows for 15 strata"):
        allocated(spark, [*STRATA, STRATA[0]], 150)


def random_strata(rng):
    k = rng.randint(1, 30)
    rows = []
    for i in range(k):
        n = rng.choice([1, 2, 5, rng.randint(1, 40), rng.randint(1, 3000)])
        mean = round(rng.uniform(-20, 100), rng.choice([0, 3]))
        std = 0.0 if n == 1 else round(rng.uniform(0, 50), rng.choice([0, 3]))
        rows.append((f"k{i:03d}", mean, std, n))
    return rows


@pytest.mark.parametrize("seed", range(14))
def test_against_played_rounds(spark, seed):
    rng = random.Random(seed)
    rows = random_strata(rng)
    held = sum(r[3] for r in rows)
    budget = rng.choice([len(rows), held, rng.randint(len(rows), held), min(held, 2 * len(rows))])
    cv = rng.choice(["signed", "abs"])
    weights = [rng.choice([0.0, 1.0, 4.0, 2.5]) for _ in rows] if seed % 2 else None
    got = allocated(spark, rows, budget, weights=weights, cv=cv, small=rng.choice([5, 10**6]))
    assert got == sizes(rows, budget, weights, cv)
    assert sum(got.values()) == budget
    assert all(0 <= got[r[0]] <= r[3] for r in rows)


def test_many_histogram_passes(spark):
    rng = random.Random(5)
    rows = [(f"k{i}", 10.0, 0.0, rng.randint(1, 40_000)) for i in range(40)]
    rows.append(("k99", 10.0, 0.0, 3_000_000))
    budget = 2_500_000
    got = allocated(spark, rows, budget)
    assert got == sizes(rows, budget)


DEGENERATE = {
    "all deviations 0": [("a", 5.0, 0.0, 9), ("b", 3.0, 0.0, 2), ("c", 1.0, 0.0, 50)],
    "mean and deviation 0": [("a", 0.0, 0.0, 9), ("b", 3.0, 1.0, 2), ("c", 1.0, 2.0, 50)],
    "mean 0": [("a", 0.0, 4.0, 9), ("b", 3.0, 1.0, 20), ("c", 1.0, 2.0, 50)],
    "negative mean": [("a", -2.0, 4.0, 9), ("b", 3.0, 1.0, 20), ("c", 1.0, 2.0, 50)],
    "negative total": [("a", -2.0, 9.0, 9), ("b", -3.0, 7.0, 20), ("c", 1.0, 2.0, 50)],
    "total 0": [("a", -2.0, 4.0, 9), ("b", 2.0, 4.0, 20), ("c", 1.0, 0.0, 50)],
    "NaN mean": [("a", float("nan"), float("nan"), 9), ("b", 2.0, 4.0, 20)],
}


@pytest.mark.parametrize("case", DEGENERATE)
@pytest.mark.parametrize("budget", [3, 10, 25])
def test_degenerate_shares(spark, case, budget):
    rows = DEGENERATE[case]
    assert allocated(spark, rows, budget) == sizes(rows, budget)


def test_weights_by_key_and_by_place(spark):
    rows = [r[:4] for r in STRATA]
    listed = [float(i % 4) - (i == 7) * 9 for i in range(15)]
    kept = [1.0 if w < 0 else w for w in listed]
    expected = sizes(rows, 150, kept)
    assert allocated(spark, rows, 150, weights=listed) == expected
    keyed = spark.createDataFrame(
        [(r[0], w) for r, w in zip(STRATA, listed) if w != 1.0], "stratum string, weight double"
    )
    assert allocated(spark, rows, 150, weights=keyed) == expected


def test_weight_list_of_another_length(spark):
    with pytest.raises(ValueError, match="2 weights for 15 strata"):
        allocated(spark, STRATA, 150, weights=[1, 2])
    plain = {r[0]: r[4] for r in STRATA}
    assert allocated(spark, STRATA, 150, weights=[1, 2], on_mismatch="ignore") == plain


def test_shares_sum_to_one(spark):
    rows = shares(table(spark, STRATA), ["stratum"]).collect()
    assert sum(r.share for r in rows) == pytest.approx(1.0)
    by_key = {r.stratum: r for r in rows}
    assert by_key["CL,so2,µg/m³"].gamma == pytest.approx(70.4238094965048 / 42.394)


def test_empty_strata_take_no_part(spark):
    rows = [*STRATA, ("ZZ", 1.0, 1.0, 0)]
    assert allocated(spark, rows, 150) == {r[0]: r[4] for r in STRATA}
