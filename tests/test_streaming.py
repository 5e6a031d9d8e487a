import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratasift import allocate, draw_sample, round_stats, stratum_stats
from stratasift.session import materialize
from stratasift.streaming.changelog import append, newest, read_log
from stratasift.streaming.idle import _summed, emit_when_idle, idle_stats, partial_stats, publish_when_idle
from stratasift.streaming.quiet import await_idle
from stratasift.streaming.sample import read_sample, sample_writer
from stratasift.streaming.slots import read_latest, write_slot
from stratasift.streaming.stats import stats_writer, with_arrival

BY = ["event_type"]


@pytest.fixture(scope="module")
def events(tables):
    return tables("events").select("event_id", "event_type", "value")


@pytest.fixture(scope="module")
def sizes(events):
    return materialize(allocate(stratum_stats(events, BY, "value"), BY, 90))


def parts(events, path, first, last):
    """Append event files, one per fifth."""
    for i in range(first, last):
        events.where(F.pmod(F.hash("event_id"), F.lit(5)) == i).coalesce(1).write.mode(
            "append"
        ).parquet(path)


def source(spark, events, path):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_stats_over_restarts(spark, events, tmp_path):
    data, out, state = (str(tmp_path / x) for x in ("data", "out", "state"))
    for first, last in ((0, 2), (2, 5)):
        parts(events, data, first, last)
        run(stats_writer(source(spark, events, data), BY, "value", out, state))
        seen = events.where(F.pmod(F.hash("event_id"), F.lit(5)) < last)
        got = round_stats(read_latest(spark, out), 6)
        assert same(got, round_stats(stratum_stats(seen, BY, "value"), 6))


def test_sample_over_restarts(spark, events, sizes, tmp_path):
    data, out, state = (str(tmp_path / x) for x in ("data", "out", "state"))
    for first, last in ((0, 2), (2, 5)):
        parts(events, data, first, last)
        stream = source(spark, events, data)
        run(sample_writer(stream, sizes, BY, ["event_id"], out, state, 4))
        seen = events.where(F.pmod(F.hash("event_id"), F.lit(5)) < last)
        assert same(read_sample(spark, out), draw_sample(seen, sizes, BY, ["event_id"], seed=4))


def test_repeated_batch_changes_nothing(spark, events, sizes, tmp_path):
    """A batch run again after a failure finds the slot it read from untouched."""
    path = str(tmp_path / "slots")
    write_slot(events.limit(3), path, 6)
    write_slot(events.limit(5), path, 7)
    write_slot(events.limit(5), path, 7)
    assert read_latest(spark, path).count() == 5
    write_slot(events.limit(2), path, 0)  # a new stream in the same place
    assert read_latest(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        read_latest(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("bounds", [(50_000, 500_000), (1, 500_000), (1, 2)])
def test_partial_statistics_add_up(spark, events, bounds):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = partial_stats(events.repartition(6), BY, "value", *bounds).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) > events.select(*BY).distinct().count()
    total = _summed(rows, BY).set_index("event_type")
    for r in stratum_stats(events, BY, "value").collect():
        assert total.loc[r[0], "n"] == r.n
        assert total.loc[r[0], "mean"] == pytest.approx(r["mean"])
        assert (total.loc[r[0], "m2"] / r.n) ** 0.5 == pytest.approx(r["std"])


def test_every_stratum_is_emitted_once(spark, events, tmp_path):
    data = str(tmp_path / "data")
    parts(events, data, 0, 3)
    emitted = []

    def store(batch, number):
        emitted.extend(tuple(r) for r in batch.collect())

    query = (
        idle_stats(source(spark, events, data), BY, "value", 500)
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "state"))
        .foreachBatch(store)
        .trigger(processingTime="100 milliseconds")
        .start()
    )
    try:
        assert await_idle(query, 3000, 120)
        first = list(emitted)
        parts(events, data, 3, 5)  # late rows: counted, not emitted
        assert await_idle(query, 3000, 120)
    finally:
        query.stop()
    assert len(first) == 5 and len({r[0] for r in first}) == 5
    seen = events.where(F.pmod(F.hash("event_id"), F.lit(5)) < 3)
    counts = {r[0]: r.n for r in stratum_stats(seen, BY, "value").collect()}
    assert {r[0]: r[3] for r in first} == counts
    assert emitted == first


def test_published_when_quiet(spark, events, tmp_path):
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    parts(events, data, 0, 5)
    writer = stats_writer(source(spark, events, data), BY, "value", out, str(tmp_path / "state"))
    query = writer.trigger(processingTime="100 milliseconds").start()
    try:
        published = publish_when_idle(spark, query, out, str(tmp_path / "table"), 800)
    finally:
        query.stop()
    assert same(round_stats(published, 6), round_stats(stratum_stats(events, BY, "value"), 6))


def test_executors_need_no_package(tmp_path):
    """Python workers start in another folder and cannot import this library."""
    repo = str(Path(__file__).resolve().parents[1])
    script = f"""
import sys
sys.path.insert(0, {repo!r})
from stratasift.operators.skip import prune_partitions
from stratasift.session import local_session
from stratasift.streaming.idle import partial_stats
df = local_session(2).range(1000).selectExpr("id % 3 as s", "5L as k", "id as p", "1.0D as v")
print("rows", prune_partitions(df, "s", "k", "p").count(), partial_stats(df, ["s"], "v").count())
"""
    run = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "rows" in run.stdout, run.stderr[-2000:]


def test_arrival_time(spark, events):
    assert with_arrival(events).schema["arrived"].dataType.typeName() == "timestamp"


def test_a_version_half_written_is_not_read(spark, events, tmp_path):
    path = str(tmp_path / "slots")
    write_slot(events.limit(3), path, 4)
    events.limit(9).write.parquet(f"{path}/batch-000000000005")  # no marker yet
    assert read_latest(spark, path).count() == 3


def test_a_long_quiet_time_publishes_all(spark, events, tmp_path):
    """Spark reports batches without rows after ten quiet seconds."""
    data, out, state, target = (str(tmp_path / x) for x in ("data", "out", "state", "target"))
    parts(events, data, 0, 5)
    query = stats_writer(source(spark, events, data), BY, "value", out, state).start()
    try:
        got = publish_when_idle(spark, query, out, target, quiet_ms=13_000, limit_s=90)
    finally:
        query.stop()
    assert same(round_stats(got, 6), round_stats(stratum_stats(events, BY, "value"), 6))


def gone(spark):
    """Listeners that are still registered."""
    return len(spark.streams._jsqm.listListeners())


def test_no_listener_is_left(spark, events, tmp_path):
    data, out, state = (str(tmp_path / x) for x in ("data", "out", "state"))
    parts(events, data, 0, 1)
    before = gone(spark)
    query = stats_writer(source(spark, events, data), BY, "value", out, state).start()
    try:
        assert await_idle(query, 300, 60)
        assert not await_idle(query, 300, 1, after=time.time())  # no rows since
    finally:
        query.stop()
    assert gone(spark) == before


def test_a_rare_stratum_stays_open(spark, tmp_path):
    """Rows of any stratum keep all of them open, through batches slower than the quiet time."""
    data, out, state, target = (str(tmp_path / x) for x in ("data", "out", "state", "target"))

    def feed(rows):
        spark.createDataFrame(rows, "k string, v double").coalesce(1).write.mode("append").parquet(data)

    feed([("rare", 1.0), ("often", 1.0)])
    stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(data)

    @F.udf("double")
    def slowly(v):
        time.sleep(0.8)
        return v

    writer = stats_writer(stream.withColumn("v", slowly("v")), ["k"], "v", out, state)
    query = writer.trigger(processingTime="100 milliseconds").start()
    try:
        for i in range(3):
            feed([("often", float(i))])
        first = emit_when_idle(spark, query, out, target, ["k"], quiet_ms=700, limit_s=120)
        assert {r.k: r.n for r in first.collect()} == {"rare": 1, "often": 4}
        stop = time.time()
        feed([("often", 9.0), ("late", 2.0), ("late", 4.0)])
        second = emit_when_idle(spark, query, out, target, ["k"], quiet_ms=700, limit_s=120, after=stop)
        # later rows count in the log, but what was emitted stays
        assert {r.k: r.n for r in second.collect()} == {"rare": 1, "often": 4, "late": 2}
        assert {r.k: r.n for r in read_latest(spark, out).collect()} == {"rare": 1, "often": 5, "late": 2}
        plan = query._jsq.explainInternal(False)
        assert "Python" not in plan.replace("BatchEvalPython", "") and "EventTimeWatermark" in plan
    finally:
        query.stop()


def test_the_log_follows_the_changed_strata(spark, tmp_path):
    """Twenty batches, each of one new row: every batch commits one row; folds keep folders few."""
    data, out, state = (str(tmp_path / x) for x in ("data", "out", "state"))
    for i in range(20):
        rows = [(f"s{i % 4}", float(i))] if i else [(f"s{j}", 0.0) for j in range(500)]
        spark.createDataFrame(rows, "k string, v double").coalesce(1).write.mode("append").parquet(data)
        stream = spark.readStream.schema("k string, v double").parquet(data)
        run(stats_writer(stream, ["k"], "v", out, state))
    batches = [p for p in Path(out).iterdir() if p.name.startswith("batch=")]
    sizes = {int(p.name.removeprefix("batch=")): spark.read.parquet(str(p)).count() for p in batches}
    assert all(n <= 1 for b, n in sizes.items() if b > 1) and len(sizes) <= 2 * 16
    want = stratum_stats(spark.read.parquet(data), ["k"], "v")
    assert same(round_stats(read_latest(spark, out), 6), round_stats(want, 6))
    assert len([p for p in Path(out).iterdir() if p.name.startswith("base=")]) <= 2


def test_reading_a_log_between_folds(spark, tmp_path):
    path, fold = str(tmp_path / "log"), lambda log: newest(log, ["k"])
    for batch in range(9):
        rows = spark.createDataFrame([(batch % 3, batch)], "k int, v int")
        append(rows, path, batch, fold, every=3)
        append(rows, path, batch, fold, every=3)  # run again after a failure
        got = {r.k: r.v for r in newest(read_log(spark, path), ["k"]).collect()}
        assert got == {b % 3: b for b in range(batch + 1)}
    append(rows.limit(0), path, 0, fold)  # a new stream
    assert read_log(spark, path).count() == 0
