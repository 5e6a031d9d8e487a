import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratasift import allocate, draw_sample, number_copies, stratified_sample, stratum_stats
from stratasift.functions.priority import SPAN, priority
from stratasift.operators.skip import Reservoirs, prune_partitions

BY = ["lang", "source"]


@pytest.fixture(scope="module")
def docs(tables):
    return tables("documents", "0.01").select("doc_id", *BY, "n_chars")


@pytest.fixture(scope="module")
def sizes(docs):
    return allocate(stratum_stats(docs, BY, "n_chars"), BY, 400).cache()


def expected(docs, sizes, seed, hasher="xxhash64"):
    """The ids of a sample, by sorting each stratum in Python."""
    size = {(r.lang, r.source): r.si for r in sizes.collect()}
    rows = docs.withColumn("p", priority(seed, ["doc_id"], hasher)).collect()
    strata = {}
    for r in rows:
        strata.setdefault((r.lang, r.source), []).append((r.p, r.doc_id))
    return sorted(i for k, v in strata.items() for _, i in sorted(v)[: size.get(k, 0)])


def ids(sample):
    return sorted(r.doc_id for r in sample.select("doc_id").collect())


@pytest.mark.parametrize("hasher", ["md5", "xxhash64"])
@pytest.mark.parametrize("method", ["rank", "skip"])
def test_smallest_priorities(docs, sizes, method, hasher):
    sample = draw_sample(docs, sizes, BY, ["doc_id"], 5, method, hasher)
    assert sample.columns == docs.columns
    assert ids(sample) == expected(docs, sizes, 5, hasher)


OPTIONS = {
    "buckets": {},
    "several buckets": {"bucket_rows": 2},
    "limit too low": {"slack": (-1.0, 0.0)},
    "limit at zero": {"slack": (-50.0, 0.0)},
    "no broadcast": {"broadcast_bytes": 0},
    "low limit, no broadcast, buckets": {
        "slack": (0.0, 0.0), "broadcast_bytes": 0, "bucket_rows": 2
    },
    "skip, no broadcast": {"method": "skip", "broadcast_bytes": 0},
    "skip, limit too low": {"method": "skip", "slack": (-1.0, 0.0)},
}


@pytest.mark.parametrize("case", OPTIONS)
def test_same_rows_on_every_path(docs, sizes, case):
    sample = draw_sample(docs, sizes, BY, ["doc_id"], 9, **OPTIONS[case])
    assert ids(sample) == expected(docs, sizes, 9)


def test_hot_stratum_is_salted(spark, monkeypatch):
    from stratasift.operators import joins

    monkeypatch.setattr(joins, "HOT_STRATA", 20)
    df = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 101)).alias("g"),
        (F.col("id") % 17).cast("double").alias("v"),
    )
    sizes = allocate(stratum_stats(df, ["g"], "v"), ["g"], 3000)
    whole = draw_sample(df, sizes, ["g"], ["id"], 1)
    salted = draw_sample(df, sizes, ["g"], ["id"], 1, broadcast_bytes=0, bucket_rows=50)
    assert whole.count() == 3000
    assert whole.exceptAll(salted).count() == 0 and salted.count() == 3000


@pytest.mark.parametrize("slots", [1 << 20, 4])
def test_cut_by_slot(spark, tables, monkeypatch, slots):
    from stratasift.operators import joins, sample

    cuts = []
    cut = joins._cut_by_slot

    def counted(rows, table, by, spread, limit, _):
        out = cut(rows, table, by, spread, limit, slots)
        cuts.append(out.count() / rows.count())
        return out

    monkeypatch.setattr(joins, "_cut_by_slot", counted)
    orders = tables("orders", "0.01").select("o_orderkey", "o_orderpriority", "o_totalprice")
    by = ["o_orderpriority"]
    sizes = allocate(stratum_stats(orders, by, "o_totalprice"), by, 100)
    plain = sample.draw_sample(orders, sizes, by, ["o_orderkey"], 1)
    assert not cuts
    cut_first = sample.draw_sample(orders, sizes, by, ["o_orderkey"], 1, broadcast_bytes=0)
    assert len(cuts) == 1 and cuts[0] < 0.05
    assert plain.count() == 100 and plain.exceptAll(cut_first).count() == 0


def test_key_types_may_differ(spark):
    """A bigint key in the stored statistics, an int key in the data."""
    df = spark.range(5000).selectExpr("id", "cast(id % 7 as int) as g", "id % 13 * 1.0D as v")
    sizes = allocate(stratum_stats(df, ["g"], "v"), ["g"], 70)
    wide = sizes.withColumn("g", F.col("g").cast("bigint"))
    one = draw_sample(df, sizes, ["g"], ["id"], 1)
    other = draw_sample(df, wide, ["g"], ["id"], 1, broadcast_bytes=0)
    assert one.count() == 70 and one.exceptAll(other).count() == 0


def test_partitioning_and_order_do_not_matter(docs, sizes):
    one = draw_sample(docs, sizes, BY, ["doc_id"], 3)
    other = draw_sample(docs.orderBy(F.rand(1)).repartition(7), sizes, BY, ["doc_id"], 3)
    assert ids(one) == ids(other)
    assert ids(one) != ids(draw_sample(docs, sizes, BY, ["doc_id"], 4))


def test_sizes_subset_and_no_repeats(docs, sizes):
    sample = draw_sample(docs, sizes, BY, ["doc_id"], 11)
    drawn = {(r.lang, r.source): r["count"] for r in sample.groupBy(*BY).count().collect()}
    assert drawn == {(r.lang, r.source): min(r.si, r.n) for r in sizes.collect()}
    assert sample.select("doc_id").distinct().count() == sample.count() == 400
    assert sample.exceptAll(docs).count() == 0


def test_data_that_changed_since_the_allocation(docs, sizes):
    smaller = docs.where("doc_id < 300")
    assert ids(draw_sample(smaller, sizes, BY, ["doc_id"], 2)) == expected(smaller, sizes, 2)
    some = sizes.where("lang = 'en'")
    assert ids(draw_sample(docs, some, BY, ["doc_id"], 2)) == expected(docs, some, 2)


def test_inclusion_is_uniform(spark):
    """Chi-square over 2,000 seeds: every row of a stratum is as likely as another."""
    rows, size, seeds = 20, 5, 2000
    drawn = (
        spark.range(seeds)
        .select(F.col("id").alias("seed"))
        .crossJoin(spark.range(rows).select(F.col("id").alias("row")))
        .withColumn("p", F.shiftrightunsigned(F.xxhash64(F.col("seed").cast("int"), "row"), 12))
        .groupBy("seed")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("p", "row"))), 1, size).alias("s"))
        .select(F.explode("s.row").alias("row"))
        .groupBy("row")
        .count()
        .collect()
    )
    mean = seeds * size / rows
    chi = sum((r["count"] - mean) ** 2 / mean for r in drawn)
    assert len(drawn) == rows
    assert chi < 43.8  # 0.999 quantile for 19 degrees of freedom


def test_md5_priority_range(spark):
    row = spark.range(5000).select(priority(1, ["id"], "md5").alias("p")).agg(
        F.min("p"), F.max("p"), F.avg("p")
    ).first()
    assert 0 <= row[0] and row[1] < SPAN
    assert abs(row[2] / SPAN - 0.5) < 0.02


def test_unknown_options(docs, sizes):
    with pytest.raises(ValueError):
        draw_sample(docs, sizes, BY, ["doc_id"], method="all")
    with pytest.raises(ValueError):
        draw_sample(docs, sizes, BY, ["doc_id"], hasher="sha")


@pytest.mark.parametrize("prune,flush", [(10, 10**9), (10, 5), (50, 200), (10**9, 10**9)])
def test_reservoirs_keep_every_sampled_row(prune, flush):
    import pyarrow as pa

    rng = random.Random(prune + flush)
    sizes = {0: 1, 1: 7, 2: 40}
    rows = [(rng.choice([0, 1, 1, 2, 2, 2]), rng.randint(0, 300)) for _ in range(3000)]
    batches = [
        pa.RecordBatch.from_pydict(
            {
                "s": pa.array([r[0] for r in part], pa.int64()),
                "k": pa.array([sizes[r[0]] for r in part], pa.int64()),
                "p": pa.array([r[1] for r in part], pa.int64()),
                "i": pa.array(range(at, at + len(part)), pa.int64()),
            }
        )
        for at in range(0, len(rows), 37)
        for part in [rows[at : at + 37]]
    ]
    out = list(Reservoirs(("s", "k", "p"), prune, flush).run(iter(batches)))
    kept = [(r["s"], r["p"], r["i"]) for b in out for r in b.to_pylist()]
    assert len(kept) == len(set(kept)) <= len(rows)
    for stratum, size in sizes.items():
        everything = sorted((p, i) for i, (s, p) in enumerate(rows) if s == stratum)
        mine = sorted((p, i) for s, p, i in kept if s == stratum)
        assert mine[:size] == everything[:size]
    if flush == 10**9:
        assert len(kept) < len(rows) / 5


def wide_batches(count, rows, strata, size, width):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(count)
    for at in range(count):
        yield pa.RecordBatch.from_pydict(
            {
                "s": pa.array(rng.integers(strata, size=rows)),
                "k": pa.array(np.full(rows, size)),
                "p": pa.array(rng.integers(1 << 40, size=rows)),
                "i": pa.array(np.arange(at * rows, (at + 1) * rows)),
                "t": pa.array(["x" * width] * rows),
            }
        )


@pytest.mark.parametrize("size", [10, 10**6])
def test_reservoirs_of_wide_rows_take_bounded_memory(size):
    """150 MB of rows, whether the sample takes few of them or all."""
    import pyarrow as pa

    before, most, ids = pa.total_allocated_bytes(), 0, []

    def watched():
        nonlocal most
        for batch in wide_batches(75, 1000, 3, size, 2000):
            most = max(most, pa.total_allocated_bytes() - before)
            yield batch

    for batch in Reservoirs(("s", "k", "p"), 100_000, 400_000).run(watched()):
        ids += batch.column("i").to_pylist()
    assert most < 60 << 20
    assert len(ids) == len(set(ids))
    assert len(ids) < 75_000 / 20 if size == 10 else len(ids) == 75_000


@pytest.mark.parametrize("hold,flush", [(1, 10**9), (1, 50), (20_000, 10**9), (20_000, 300)])
def test_reservoirs_hand_on_wide_rows(hold, flush):
    """Rows handed on early go on raising the bars, and no sampled row is lost."""
    strata, size = 4, 30
    batches = [*wide_batches(100, 100, strata, size, 50)]
    out = list(Reservoirs(("s", "k", "p"), 200, flush, hold).run(iter(batches)))
    rows = [(r["s"], r["p"], r["i"]) for b in batches for r in b.to_pylist()]
    kept = [(r["s"], r["p"], r["i"]) for b in out for r in b.to_pylist()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
    for stratum in range(strata):
        everything = sorted((p, i) for s, p, i in rows if s == stratum)
        assert sorted((p, i) for s, p, i in kept if s == stratum)[:size] == everything[:size]
    if flush == 10**9:
        assert len(kept) < len(rows) / 5


def test_prune_moves_nothing(spark):
    df = spark.range(1000).selectExpr("id % 3 as s", "5L as k", "id as p")
    plan = prune_partitions(df, "s", "k", "p")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() < 1000


@pytest.mark.parametrize("few,piece", [(1000, 1000), (3, 4), (0, 1)])
def test_copies_are_numbered(spark, few, piece):
    rows = ["a"] * 11 + ["b"] + ["c"] * 4 + [None] * 2
    df = spark.createDataFrame([(r, 1) for r in rows], "g string, x int").repartition(3)
    got = Counter((r.g, r.copy_no) for r in number_copies(df, ["g"], few=few, piece=piece).collect())
    want = Counter((g, i) for g, n in Counter(rows).items() for i in range(1, n + 1))
    assert got == want


def test_sample_of_copies(spark):
    """A third of the rows are copies of one tuple; any of them may be drawn."""
    df = spark.range(900).select(
        F.lit("g").alias("g"), F.when(F.col("id") < 300, -1).otherwise(F.col("id")).cast("double").alias("v")
    )
    run = stratified_sample(df, ["g"], "v", 90, seed=1)
    assert run.sample.count() == 90
    copies = run.sample.where("v = -1").count()
    assert 15 < copies < 45


def test_data_grown_since_the_statistics(spark, monkeypatch):
    """A hundred times the rows that were counted: no group of one task holds a stratum."""
    from stratasift.operators import sample

    seen = []
    ranked = sample.take_smallest

    def watched(candidates, counts, by, ids):
        seen.append(candidates.groupBy(*by, "_bucket").count().agg(F.max("count")).first()[0])
        return ranked(candidates, counts, by, ids)

    monkeypatch.setattr(sample, "take_smallest", watched)
    df = spark.range(100_000).select("id", (F.col("id") % 2).alias("g"))
    old = spark.createDataFrame([(0, 200, 500), (1, 100, 500)], "g long, si long, n long")
    got = draw_sample(df, old, ["g"], ["id"], 3, bucket_rows=100)
    assert max(seen) <= 8 * 100
    assert ids_of(got, "id") == ids_of(draw_sample(df, old, ["g"], ["id"], 3), "id")
    assert got.groupBy("g").count().orderBy("g").collect() == [(0, 200), (1, 100)]


def ids_of(df, name):
    return sorted(r[name] for r in df.select(name).collect())
