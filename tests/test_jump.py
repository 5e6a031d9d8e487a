import numpy as np
import pytest
from pyspark.sql import functions as F

from stratasift.operators.jump import Jumps, draw_by_jumps, shares_of
from stratasift.session import materialize


def reservoir(rows, size, seed, chunks):
    """Rows 0, 1, ... handed over in chunks; what the places hold at the end."""
    jumps, places, at = Jumps(size, np.random.default_rng(seed)), [], 0
    for n in chunks:
        for position, place in jumps.take(n):
            if place < len(places):
                places[place] = at + position
            else:
                places.append(at + position)
        at += n
    assert at == rows
    return places, jumps.drawn


def test_every_row_is_as_likely():
    counts = np.zeros(60)
    for seed in range(6000):
        places, _ = reservoir(60, 7, seed, [1, 5, 24, 30])
        assert len(set(places)) == 7
        counts[places] += 1
    expected = 6000 * 7 / 60
    chi = ((counts - expected) ** 2 / (expected * (1 - 7 / 60))).sum()
    assert chi < 59 + 4 * np.sqrt(2 * 59)


def test_few_rows_are_looked_at():
    _, drawn = reservoir(1_000_000, 100, 1, [50_000] * 20)
    assert drawn < 4 * 100 * (1 + np.log(10_000))


def test_small_sizes():
    assert reservoir(3, 7, 0, [1, 2])[0] == [0, 1, 2]
    assert reservoir(5, 0, 0, [5])[0] == []
    assert len(reservoir(1000, 1, 3, [999, 1])[0]) == 1


def test_shares_follow_the_parts():
    rng = np.random.default_rng(2)
    drawn = np.array([shares_of(np.array([10, 0, 30, 60]), 20, rng) for _ in range(4000)])
    assert (drawn.sum(axis=1) == 20).all() and (drawn[:, 1] == 0).all()
    assert np.abs(drawn.mean(axis=0) - [2, 0, 6, 12]).max() < 0.1
    # the variance of a draw without replacement
    assert abs(drawn[:, 2].var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert shares_of(np.array([2, 3]), 9, rng).tolist() == [2, 3]
    assert shares_of(np.array([2 * 10**12, 10**12]), 30_000, rng)[0] == pytest.approx(20_000, rel=0.02)
    assert shares_of(np.array([20, 10]), 29, rng).sum() == 29


def test_sample_over_partitions(spark):
    rows = spark.range(20_000).selectExpr("id", "case when id % 100 = 0 then 'few' when id % 7 = 0 then null else 'many' end as k")
    rows = rows.withColumn("v", F.lit("same")).repartition(7)
    sizes = spark.createDataFrame([("few", 50, 200), ("many", 400, 19_000), ("none", 3, 9)], "k string, si long, n long")
    counts = np.zeros(20_000)
    for seed in range(3):
        drawn = materialize(draw_by_jumps(rows, sizes, ["k"], seed))
        assert drawn.columns == rows.columns
        got = {r.k: r.n for r in drawn.groupBy("k").agg(F.countDistinct("id").alias("n")).collect()}
        assert got == {"few": 50, "many": 400} and drawn.count() == 450
        counts[[r.id for r in drawn.collect()]] += 1
    assert counts.max() <= 3 and (counts > 0).sum() > 1000
    larger = draw_by_jumps(rows.where("k = 'few'"), sizes.withColumn("si", F.lit(900).cast("long")), ["k"])
    assert larger.select("id").distinct().count() == 200
    with pytest.raises(ValueError, match="_jseen"):
        draw_by_jumps(rows.withColumn("_jseen", F.lit(1)), sizes, ["k"])
