import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratasift import allocate, draw_sample, latest_stats, round_stats, stratum_stats
from stratasift.session import materialize
from stratasift.sources.stats_table import read_stats, versions, write_stats
from stratasift.sources.versions import commit
from stratasift.streaming.allocation import (
    allocate_when_idle,
    allocation_stream,
    latest_stats_writer,
    read_allocation,
)
from stratasift.streaming.changelog import read_log
from stratasift.streaming.reservoir import read_reservoir, reservoir_writer, smallest
from stratasift.streaming.slots import read_latest

BY, FIFTH = ["event_type"], "pmod(hash(event_id), 5)"


@pytest.fixture(scope="module")
def events(tables):
    rows = tables("events").select("event_id", "event_type", "value", "ts")
    # a null, and a text with every kind of quote
    return materialize(rows.withColumn("note", F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("\"'\n\\"), "event_id"))))


@pytest.fixture(scope="module")
def sizes(events):
    return materialize(allocate(round_stats(stratum_stats(events, BY, "value"), 6), BY, 90))


def feed(events, path, *fifths):
    for i in fifths:
        events.where(f"{FIFTH} = {i}").coalesce(1).write.mode("append").parquet(path)


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b.select(a.columns)).count() == 0


class Job:
    """A two-input query over two folders, stopped and started again at will."""

    def __init__(self, spark, events, tmp_path, budget, **more):
        self.spark, self.events, self.budget, self.more = spark, events, budget, more
        self.data, self.sizes, self.log, self.state = (str(tmp_path / x) for x in ("data", "sizes", "log", "state"))
        events.limit(0).write.parquet(self.data)

    def start(self, like):
        stream = self.spark.readStream.schema(self.events.schema).parquet(self.data)
        allocations = allocation_stream(self.spark, self.sizes, like)
        return reservoir_writer(
            stream, allocations, BY, ["event_id"], self.budget, self.log, self.state, seed=4, **self.more
        ).start()


def test_rows_before_between_and_after_their_allocation(spark, events, sizes, tmp_path):
    job = Job(spark, events, tmp_path, 90)
    kinds = sorted(r[0] for r in sizes.select(*BY).collect())
    early, late = sizes.where(F.col("event_type").isin(kinds[:2])), sizes.where(~F.col("event_type").isin(kinds[:2]))
    query = job.start(sizes)
    try:
        feed(events, job.data, 0, 1)
        query.processAllAvailable()
        assert read_log(spark, job.log).count() == 0  # all rows wait
        write_stats(early, job.sizes, 0)
        query.processAllAvailable()
        released = {r[0] for r in read_log(spark, job.log).select(*BY).distinct().collect()}
        assert released == set(kinds[:2])
        feed(events, job.data, 2)
        query.processAllAvailable()
    finally:
        query.stop()
    seen = events.where(f"{FIFTH} < 3")
    assert same(read_reservoir(spark, job.log, early), draw_sample(seen, early, BY, ["event_id"], seed=4))
    feed(events, job.data, 3)
    query = job.start(sizes)  # goes on from its state
    try:
        query.processAllAvailable()
        write_stats(late, job.sizes, 1)
        feed(events, job.data, 4)
        query.processAllAvailable()
    finally:
        query.stop()
    got = read_reservoir(spark, job.log, sizes)
    assert got.schema == events.schema
    assert same(got, draw_sample(events, sizes, BY, ["event_id"], seed=4))


def test_sizes_that_grow(spark, events, sizes, tmp_path):
    larger = materialize(allocate(sizes.select(*BY, "mean", "std", "n"), BY, 160))
    job = Job(spark, events, tmp_path, 160, revisable=True, salts=3)
    query = job.start(sizes)
    try:
        write_stats(sizes, job.sizes, 0)
        feed(events, job.data, 0, 1, 2)
        query.processAllAvailable()
        write_stats(larger, job.sizes, 1)
        feed(events, job.data, 3, 4)
        query.processAllAvailable()
    finally:
        query.stop()
    for wanted in (sizes, larger):
        assert same(read_reservoir(spark, job.log, wanted), draw_sample(events, wanted, BY, ["event_id"], seed=4))


def test_a_batch_costs_its_candidates(spark, tmp_path):
    """Twenty batches of 2,000 rows for 50 places: later batches hardly add to the log."""
    rows = spark.range(40_000).selectExpr("id", "cast(id % 2 as string) as k", "cast(id as double) as v")
    data, state, log, target = (str(tmp_path / x) for x in ("data", "state", "log", "sizes"))
    sizes = spark.createDataFrame([("0", 30), ("1", 20)], "k string, si long")
    write_stats(sizes, target, 0)
    per_batch = []
    for i in range(20):
        rows.where(f"pmod(hash(id), 20) = {i}").coalesce(1).write.mode("append").parquet(data)
        stream = spark.readStream.schema(rows.schema).parquet(data)
        writer = reservoir_writer(stream, allocation_stream(spark, target, sizes), ["k"], ["id"], 50, log, state, salts=2)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        per_batch.append(read_log(spark, log).count())
    held = {r.k: r.n for r in read_reservoir(spark, log, sizes).groupBy("k").agg(F.count("*").alias("n")).collect()}
    seen = spark.read.parquet(data)
    whole = draw_sample(seen, sizes.withColumn("n", F.lit(20_000).cast("long")), ["k"], ["id"])
    assert held == {r.k: r.n for r in whole.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert same(read_reservoir(spark, log, sizes), whole)
    assert max(per_batch) < 1500  # of 40,000 rows


def test_smallest_keeps_ties():
    rows = pd.DataFrame({"p": [5, 1, 3, 3, 9], "row": list("abcde")})
    assert smallest(rows, 2)["row"].tolist() == ["b", "c", "d"]
    assert smallest(rows, 0).empty and len(smallest(rows, 9)) == 5


def test_refusals(spark, events, sizes, tmp_path):
    stream = events.withColumnRenamed("value", "_row")
    with pytest.raises(ValueError, match="_row"):
        reservoir_writer(stream, sizes, BY, ["event_id"], 9, "a", "b")
    with pytest.raises(FileNotFoundError):
        read_reservoir(spark, str(tmp_path / "none"), sizes)


def test_two_waves_of_statistics(spark, events, tmp_path):
    topic, log, state, target = (str(tmp_path / x) for x in ("topic", "log", "state", "sizes"))
    first = materialize(round_stats(stratum_stats(events.where(f"{FIFTH} < 3"), BY, "value"), 6).withColumn("version", F.lit(1)))
    second = materialize(round_stats(stratum_stats(events, BY, "value"), 6).withColumn("version", F.lit(2)))
    first.where("event_type != 'click'").write.parquet(topic)
    first.where("event_type = 'click'").write.mode("append").parquet(topic)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(topic)
    query = latest_stats_writer(stream, BY, log, state, "version").start()
    try:
        assert allocate_when_idle(spark, query, log, target, BY, 60, quiet_ms=400, limit_s=60) == 0
        stop = time.time()
        second.write.mode("append").parquet(topic)
        first.limit(2).write.mode("append").parquet(topic)  # an old row again changes nothing
        assert allocate_when_idle(spark, query, log, target, BY, 60, quiet_ms=400, limit_s=60, after=stop) == 1
    finally:
        query.stop()
    fields = [*BY, "mean", "std", "n"]
    assert same(read_latest(spark, log).select(*fields), latest_stats(spark.read.parquet(topic), BY, "version").select(*fields))
    assert versions(spark, target) == [0, 1]
    assert same(read_allocation(spark, target, 0), allocate(first.drop("version"), BY, 60))
    assert same(read_allocation(spark, target), allocate(second.drop("version"), BY, 60))


def test_a_writer_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.range(5).selectExpr("cast(id as string) as k", "1.0D as mean", "0.0D as std", "id as n")
    assert write_stats(rows, path)
    before = read_stats(spark, path)  # a reader that has begun

    def dies(self, *_):
        raise OSError("lost")

    with monkeypatch.context() as m:  # some rows are written, the commit never comes
        m.setattr("stratasift.sources.versions.files", dies)
        m.setattr("stratasift.sources.versions.exists", lambda *_: False)
        with pytest.raises(OSError):
            commit(rows.limit(2), path, "snapshot=000000000001")
    assert read_stats(spark, path).count() == 5
    assert write_stats(rows.limit(3), path)
    assert read_stats(spark, path).count() == 3 and before.count() == 5
    assert write_stats(rows, path, 7) and not write_stats(rows.limit(1), path, 7)
    assert versions(spark, path) == [7]
