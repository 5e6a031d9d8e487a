"""The operators run over the shared test tables, one query per operator or rule.

Every query reads its whole tables. Budgets are fractions of the table, so the work
grows with the data. :mod:`stratasift.plans.table_sql` has the same queries as SQL.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.functions.columns import stratum
from stratasift.operators.allocate import allocate, shares, totals
from stratasift.operators.clean import clean, project, rejected
from stratasift.operators.copies import number_copies
from stratasift.operators.jump import draw_by_jumps
from stratasift.operators.stats import (
    latest_stats,
    merge_stats,
    round_stats,
    sort_stats,
    stratum_stats,
)
from stratasift.operators.report import nested_report, report_lines, sample_report
from stratasift.operators.sample import draw_sample
from stratasift.plans.whole_run import SampleRun, stratified_sample
from stratasift.session import checkpoint_dir, materialize
from stratasift.sources.csv import parse_csv, read_csv, to_csv_line
from stratasift.sources.lines import read_lines
from stratasift.sources.positions import POSITION, with_position
from stratasift.sources.stats_table import read_stats, write_stats
from stratasift.sources.topic import (
    from_records,
    key_number,
    stats_from_records,
    stats_to_records,
    to_records,
)
from stratasift.streaming.allocation import (
    allocate_when_idle,
    allocation_stream,
    latest_stats_writer,
    read_allocation,
)
from stratasift.streaming.idle import PROVIDER, ROCKSDB, emit_when_idle, publish_when_idle, sample_when_idle
from stratasift.streaming.reservoir import read_reservoir, reservoir_writer
from stratasift.streaming.sample import read_sample, sample_writer
from stratasift.streaming.slots import read_latest
from stratasift.streaming.stats import stats_writer

DIGITS = 6
SEED = 7
# Priorities and figures that SQL can recompute.
SQL_SAMPLE = {"seed": SEED, "hasher": "md5", "digits": DIGITS}

ORDERS = ["o_orderpriority", "o_orderstatus"]
LINES = ["l_returnflag", "l_linestatus"]
DOCS = ["lang", "source"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table as a stream, whether it is one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    part = batch.select("_metadata.file_name").first()
    if part is not None and part[0] == f"{name}.parquet":
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run's files, beside the checkpoints."""
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def stored_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return materialize(round_stats(stratum_stats(df, by, value), DIGITS))


def held(stats: DataFrame) -> int:
    return stats.agg(F.sum("n")).first()[0]


# Statistics


def stratum_stats_orders(spark, sf_dir):
    stats = stratum_stats(table(spark, sf_dir, "orders"), ORDERS, "o_totalprice")
    return sort_stats(round_stats(stats, DIGITS), ORDERS)


def stratum_stats_events(spark, sf_dir):
    stats = stratum_stats(table(spark, sf_dir, "events"), ["event_type"], "value")
    return sort_stats(round_stats(stats, DIGITS), ["event_type"])


def stratum_stats_lineitem(spark, sf_dir):
    stats = stratum_stats(table(spark, sf_dir, "lineitem"), LINES, "l_extendedprice")
    return sort_stats(round_stats(stats, DIGITS), LINES)


def stratum_stats_lineitem_supplier(spark, sf_dir):
    by = [*LINES, "l_suppkey"]
    stats = stratum_stats(table(spark, sf_dir, "lineitem"), by, "l_quantity")
    return sort_stats(round_stats(stats, DIGITS), by)


def stratum_key_parts(spark, sf_dir):
    by = ["p_brand", "p_type"]
    stats = stratum_stats(table(spark, sf_dir, "part"), by, "p_retailprice")
    return round_stats(stats, DIGITS).select(stratum(by).alias("stratum"), "mean", "std", "n")


def event_csv(spark, sf_dir) -> DataFrame:
    """Events as CSV lines: one kind blanked out, high values not numeric."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    value = F.when(F.col("value") > 400, "n/a").otherwise(F.col("value").cast("string"))
    dirty = events.select("event_id", "props", kind.alias("kind"), value.alias("amount"))
    lines = to_csv_line(dirty, ["event_id", "props", "kind", "amount"])
    return parse_csv(lines, "value", ["event_id", "props", "kind", "amount"])


def stratum_stats_clean_csv(spark, sf_dir):
    return round_stats(stratum_stats(event_csv(spark, sf_dir), [3], 4), DIGITS)


def rejected_csv(spark, sf_dir):
    bad = rejected(event_csv(spark, sf_dir), ["kind"], "amount")
    return project(bad, [1, 3, 4]).withColumn("event_id", F.col("event_id").cast("bigint"))


def clean_documents_csv(spark, sf_dir):
    """Whole texts through CSV and back: quotes, commas and line breaks survive."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    lines = to_csv_line(docs, docs.columns)
    parsed = parse_csv(lines, "value", docs.columns)
    back = clean(parsed, ["lang"], "n_chars", keep=["doc_id", "text"])
    return back.select(
        F.col("doc_id").cast("bigint"), "lang", "n_chars", F.md5("text").alias("text_md5")
    )


def csv_file_stats_events(spark, sf_dir):
    """CSV files with a header line, written and read as files."""
    folder = f"{run_folder(spark)}/csv"
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    events.write.options(header=True, escape='"').csv(folder)
    back = read_csv(spark, folder, events.columns)
    return round_stats(stratum_stats(back, ["event_type"], "value"), DIGITS)


def latest_stats_events(spark, sf_dir):
    """Statistics appended twice; a kind missing from the second keeps its first row."""
    events = table(spark, sf_dir, "events")
    folder = f"{run_folder(spark)}/stats"
    early = events.withColumn("value", F.col("value") / 2)
    write_stats(stratum_stats(early, ["event_type"], "value"), folder, version=1)
    later = events.where(F.col("event_type") != "signup")
    write_stats(stratum_stats(later, ["event_type"], "value"), folder, version=2)
    newest = latest_stats(read_stats(spark, folder), ["event_type"], "version")
    return round_stats(newest, DIGITS)


def merge_stats_lineitem(spark, sf_dir):
    fine = stratum_stats(
        table(spark, sf_dir, "lineitem"), [*LINES, "l_suppkey"], "l_extendedprice"
    )
    return round_stats(merge_stats(fine, LINES), DIGITS)


def stats_records_orders(spark, sf_dir):
    """Statistics written as topic records and read back."""
    stats = stratum_stats(table(spark, sf_dir, "orders"), ORDERS, "o_totalprice")
    keyed = round_stats(stats, DIGITS).select(stratum(ORDERS).alias("stratum"), "mean", "std", "n")
    return stats_from_records(stats_to_records(keyed))


# Allocation


def share_orders(spark, sf_dir):
    stats = stored_stats(table(spark, sf_dir, "orders"), ORDERS, "o_totalprice")
    return rounded(shares(stats, ORDERS), "gamma", "share", digits=9)


def totals_documents(spark, sf_dir):
    """Strata, rows and total weighted coefficient of variation."""
    stats = stored_stats(table(spark, sf_dir, "documents"), DOCS, "n_chars")
    weights = stats.select(*DOCS, F.length("lang").cast("double").alias("weight"))
    return rounded(totals(stats, DOCS, weights), "gamma")


def allocate_documents_give(spark, sf_dir):
    stats = stored_stats(table(spark, sf_dir, "documents"), DOCS, "n_chars")
    return allocate(stats, DOCS, held(stats) // 2)


def allocate_documents_take(spark, sf_dir):
    """Weight 0 for one language and one row to spare: sizes are taken back."""
    stats = stored_stats(table(spark, sf_dir, "documents"), DOCS, "n_chars")
    weight = F.when(F.col("lang") == "en", 0.0).otherwise(4.0)
    weights = stats.select(*DOCS, weight.alias("weight"))
    return allocate(stats, DOCS, stats.count() + 1, weights)


def allocate_weight_list(spark, sf_dir):
    """Weights by place, some zero and some negative."""
    stats = stored_stats(table(spark, sf_dir, "documents"), DOCS, "n_chars")
    weights = [float(place % 5 - 1) for place in range(stats.count())]
    return allocate(stats, DOCS, held(stats) // 4, weights)


def allocate_degenerate(spark, sf_dir):
    """A constant value: every share is NaN and the rows are dealt round by round."""
    docs = table(spark, sf_dir, "documents").withColumn("one", F.lit(1.0))
    stats = stored_stats(docs, DOCS, "one")
    return allocate(stats, DOCS, held(stats) * 3 // 5)


def allocate_zero_strata(spark, sf_dir):
    """Some strata have mean and deviation 0."""
    docs = table(spark, sf_dir, "documents")
    zeroed = docs.withColumn("v", F.when(F.col("lang") == "de", 0.0).otherwise(F.col("n_chars").cast("double")))
    stats = stored_stats(zeroed, DOCS, "v")
    return allocate(stats, DOCS, held(stats) * 3 // 5)


def allocate_infinite_share(spark, sf_dir):
    """Some strata centred on 0: infinite coefficients of variation."""
    orders = table(spark, sf_dir, "orders")
    means = stratum_stats(orders, ORDERS, "o_totalprice").select(*ORDERS, "mean")
    middle = F.when(F.col("o_orderstatus") == "P", F.col("mean")).otherwise(0.0)
    shifted = orders.join(means, ORDERS).withColumn("v", F.col("o_totalprice") - middle)
    stats = stored_stats(shifted, ORDERS, "v")
    return allocate(stats, ORDERS, held(stats) // 30)


def allocate_customer(cv: str):
    def query(spark, sf_dir):
        shifted = table(spark, sf_dir, "customer").withColumn("v", F.col("c_acctbal") - 4500)
        stats = stored_stats(shifted, ["c_nationkey"], "v")
        return allocate(stats, ["c_nationkey"], held(stats) * 2 // 15, cv=cv)

    return query


def allocate_parts(spark, sf_dir):
    by = ["p_brand", "p_type"]
    stats = stored_stats(table(spark, sf_dir, "part"), by, "p_retailprice")
    return allocate(stats, by, held(stats) // 2)


def allocate_lineitem_supplier(spark, sf_dir):
    stats = stored_stats(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return allocate(stats, ["l_suppkey"], held(stats) // 20)


# Samples


def orders_run(spark, sf_dir, **options) -> SampleRun:
    orders = table(spark, sf_dir, "orders")
    return stratified_sample(
        orders, ORDERS, "o_totalprice", orders.count() // 30, ["o_orderkey"],
        **{**SQL_SAMPLE, **options},
    )


def events_run(spark, sf_dir, **options) -> SampleRun:
    events = table(spark, sf_dir, "events")
    return stratified_sample(
        events, ["event_type"], "value", events.count() // 20, ["event_id"],
        **{**SQL_SAMPLE, **options},
    )


def documents_run(spark, sf_dir, **options) -> SampleRun:
    docs = table(spark, sf_dir, "documents")
    return stratified_sample(
        docs, DOCS, "n_chars", docs.count() // 2, ["doc_id"],
        **{**SQL_SAMPLE, **options},
    )


def lineitem_run(spark, sf_dir, **options) -> SampleRun:
    lines = table(spark, sf_dir, "lineitem")
    return stratified_sample(
        lines, LINES, "l_quantity", lines.count() // 60, **{**SQL_SAMPLE, **options}
    )


def stratified_sample_orders(spark, sf_dir):
    return orders_run(spark, sf_dir).sample


def stratified_sample_events(spark, sf_dir):
    return events_run(spark, sf_dir).sample


def stratified_sample_documents(spark, sf_dir):
    return documents_run(spark, sf_dir, keep=["text"]).sample


def stratified_sample_lineitem(spark, sf_dir):
    """No unique id: equal (flag, status, quantity) rows are numbered."""
    return lineitem_run(spark, sf_dir).sample


def stratified_sample_orders_fast(spark, sf_dir):
    """The fast hash: rows per stratum, without repeats, all of them rows of the table."""
    run = orders_run(spark, sf_dir, hasher="xxhash64")
    orders = table(spark, sf_dir, "orders").select(*ORDERS, "o_orderkey", "o_totalprice")
    inside = run.sample.join(orders, [*ORDERS, "o_orderkey", "o_totalprice"], "left_semi")
    return inside.groupBy(*ORDERS).agg(
        F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("orders")
    )


def stratified_sample_lineitem_keep(spark, sf_dir):
    """No unique id, with a column kept: equal tuples with it are numbered."""
    lines = table(spark, sf_dir, "lineitem")
    return stratified_sample(
        lines, LINES, "l_quantity", lines.count() // 60, keep=["l_linenumber"], seed=SEED,
        hasher="md5", digits=DIGITS,
    ).sample


def skip_sample_events(spark, sf_dir):
    return events_run(spark, sf_dir, method="skip").sample


def skip_sample_documents(spark, sf_dir):
    return documents_run(spark, sf_dir, method="skip", keep=["text"]).sample


def number_copies_lineitem(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINES, "l_quantity")
    return number_copies(lines, lines.columns)


# Reports


def sample_report_orders(spark, sf_dir):
    return rounded(orders_run(spark, sf_dir).report(), "sample_mean", "sample_std")


def sample_report_documents(spark, sf_dir):
    return rounded(documents_run(spark, sf_dir).report(), "sample_mean", "sample_std")


def nested_report_documents(spark, sf_dir):
    nested = documents_run(spark, sf_dir).nested()
    values = F.transform("sample", lambda x: x["value"].cast("bigint").cast("string"))
    return nested.select(
        *DOCS, "n", "si", "sample_n", F.array_join(values, ",").alias("sample_values")
    )


def nested_report_orders(spark, sf_dir):
    """Arrays of ten values: strata that span several chunks."""
    run = orders_run(spark, sf_dir)
    nested = nested_report(run.sample, run.allocation, run.by, run.value, chunk_rows=10)
    return nested.select(
        *ORDERS, "sample_n", "chunk", F.size("sample").alias("n_values"),
        F.element_at("sample", 1)["value"].alias("lowest"),
        F.element_at("sample", -1)["value"].alias("highest"),
    )


def report_lines_orders(spark, sf_dir):
    return orders_run(spark, sf_dir).lines(digits=DIGITS)


# Topics


def topic_records_events(spark, sf_dir):
    """Events as text lines, numbered and dealt to four topic partitions."""
    events = table(spark, sf_dir, "events").orderBy("event_id")
    folder = f"{run_folder(spark)}/lines"
    fields = [F.col(c).cast("string") for c in ("event_id", "event_type", "value", "props")]
    events.select(F.concat_ws("|", *fields).alias("value")).write.text(folder)
    records = to_records(read_lines(spark, folder, header=False), 4)
    return records.select(
        F.lower(F.hex("key")).alias("key_hex"), key_number(F.col("key")).alias("key"),
        "partition", "value",
    )


def topic_stats_events(spark, sf_dir):
    """Records shaped as a topic delivers them, decoded, parsed and summed up."""
    events = table(spark, sf_dir, "events")
    lines = to_csv_line(events.select("event_id", "event_type", "value"), [2, 3], "line")
    numbered = lines.select((F.col("event_id") + 1).alias("key"), F.col("line").alias("value"))
    sent = to_records(numbered, 4).select(
        "key", F.col("value").cast("binary").alias("value"), F.lit("events").alias("topic"),
        "partition", key_number(F.col("key")).alias("offset"),
    )
    rows = parse_csv(from_records(sent), "value", ["kind", "amount"])
    return round_stats(stratum_stats(rows, ["partition", "kind"], "amount"), DIGITS)


# Streams


def stream_stats_events(spark, sf_dir):
    folder = run_folder(spark)
    writer = stats_writer(
        stream(spark, sf_dir, "events"), ["event_type"], "value",
        f"{folder}/stats", f"{folder}/state",
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return round_stats(read_latest(spark, f"{folder}/stats"), DIGITS)


def stream_sample_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stats = stored_stats(events, ["event_type"], "value")
    sizes = allocate(stats, ["event_type"], held(stats) // 20)
    folder = run_folder(spark)
    rows = stream(spark, sf_dir, "events").select("event_id", "event_type", "value")
    writer = sample_writer(
        rows, sizes, ["event_type"], ["event_id"], f"{folder}/sample", f"{folder}/state",
        SEED, "md5",
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return read_sample(spark, f"{folder}/sample")


def stream_report_events(spark, sf_dir):
    """Statistics of a stream, sizes, then the sample of a stream and its report when quiet."""
    folder, by = run_folder(spark), ["event_type"]
    events = stream(spark, sf_dir, "events").select("event_id", "event_type", "value")
    counted = stats_writer(events, by, "value", f"{folder}/stats", f"{folder}/stats-state").start()
    try:
        stats = publish_when_idle(
            spark, counted, f"{folder}/stats", f"{folder}/published", quiet_ms=500, limit_s=300
        )
    finally:
        counted.stop()
    stats = round_stats(stats, DIGITS)
    sizes = materialize(allocate(stats, by, held(stats) // 20))
    drawn = sample_writer(
        events, sizes, by, ["event_id"], f"{folder}/sample", f"{folder}/state", SEED, "md5"
    ).start()
    try:
        sample = sample_when_idle(spark, drawn, f"{folder}/sample", quiet_ms=500, limit_s=300)
    finally:
        drawn.stop()
    return rounded(sample_report(sample, sizes, by, "value"), "sample_mean", "sample_std")


def idle_publish_events(spark, sf_dir):
    """A stream that does not end; published once it is quiet."""
    folder = run_folder(spark)
    writer = stats_writer(
        stream(spark, sf_dir, "events"), ["event_type"], "value",
        f"{folder}/stats", f"{folder}/state",
    )
    query = writer.trigger(processingTime="200 milliseconds").start()
    try:
        published = publish_when_idle(
            spark, query, f"{folder}/stats", f"{folder}/published", quiet_ms=500, limit_s=300
        )
    finally:
        query.stop()
    return round_stats(published, DIGITS)


def idle_emit_events(spark, sf_dir):
    """Every kind emitted once, when the stream as a whole was quiet."""
    folder, by = run_folder(spark), ["event_type"]
    writer = stats_writer(
        stream(spark, sf_dir, "events"), by, "value", f"{folder}/stats", f"{folder}/state"
    )
    query = writer.trigger(processingTime="200 milliseconds").start()
    try:
        emitted = emit_when_idle(
            spark, query, f"{folder}/stats", f"{folder}/emitted", by, quiet_ms=1000, limit_s=300
        )
    finally:
        query.stop()
    return round_stats(emitted, DIGITS)


def jump_sample_orders(spark, sf_dir):
    """Sizes of a sample drawn by jumps, its distinct rows, and rows that are not its stratum's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", *ORDERS, "o_totalprice")
    stats = stored_stats(orders, ORDERS, "o_totalprice")
    sizes = materialize(allocate(stats, ORDERS, held(stats) // 10))
    drawn = materialize(draw_by_jumps(orders.repartition(6), sizes, ORDERS, SEED))
    return sample_sizes(drawn, orders, sizes)


def position_sample_orders(spark, sf_dir):
    """The same of a sample whose rows are told apart by their places in the files."""
    orders = with_position(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    orders = orders.select(*POSITION, "o_orderkey", *ORDERS, "o_totalprice")
    stats = stored_stats(orders, ORDERS, "o_totalprice")
    sizes = materialize(allocate(stats, ORDERS, held(stats) // 10))
    drawn = materialize(draw_sample(orders, sizes, ORDERS, POSITION, SEED))
    return sample_sizes(drawn, orders, sizes)


def sample_sizes(drawn: DataFrame, orders: DataFrame, sizes: DataFrame) -> DataFrame:
    strays = drawn.join(orders, orders.columns, "left_anti").groupBy(*ORDERS).agg(F.count("*").alias("strays"))
    counts = drawn.groupBy(*ORDERS).agg(
        F.count("*").alias("drawn"), F.countDistinct("o_orderkey").alias("different")
    )
    shown = sizes.select(*ORDERS, "si").join(counts, ORDERS, "left").join(strays, ORDERS, "left")
    return shown.fillna(0, ["drawn", "different", "strays"])


@contextmanager
def keyed_state(spark: SparkSession):
    """Settings for queries started inside: state in RocksDB, as many partitions as cores at most."""
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.shuffle.partitions": str(partitions), PROVIDER: ROCKSDB}
    usual = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in usual.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def waves(events: DataFrame, folder: str, *thirds: int) -> None:
    """Append thirds of the rows to a folder that a stream reads."""
    for i in thirds:
        events.where(F.pmod(F.col("event_id"), F.lit(3)) == i).write.mode("append").parquet(folder)


def stream_reservoir_events(spark, sf_dir):
    """The sample of a stream in keyed state, sizes at hand from the start."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    folder, by = run_folder(spark), ["event_type"]
    stats = stored_stats(events, by, "value")
    budget = held(stats) // 20
    sizes = materialize(allocate(stats, by, budget))
    write_stats(sizes, f"{folder}/sizes", 0)
    rows = stream(spark, sf_dir, "events").select(*events.columns)
    with keyed_state(spark):
        query = reservoir_writer(
            rows, allocation_stream(spark, f"{folder}/sizes", sizes), by, ["event_id"], budget,
            f"{folder}/log", f"{folder}/state", SEED, "md5",
        ).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_reservoir(spark, f"{folder}/log", sizes)


def stream_two_phase_events(spark, sf_dir):
    """Both phases as streams: rows wait for sizes that come from a stream of statistics.

    A third of the rows reaches the sampling query before its sizes, the others after.
    """
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    folder, by = run_folder(spark), ["event_type"]
    replay, topic, sizes = f"{folder}/replay", f"{folder}/topic", f"{folder}/sizes"
    budget = events.where("event_type <> '' AND value IS NOT NULL").count() // 20
    waves(events, replay, 0)
    like = spark.createDataFrame([], "event_type string, mean double, std double, n bigint, si bigint")
    with keyed_state(spark):
        drawn = reservoir_writer(
            spark.readStream.schema(events.schema).parquet(replay), allocation_stream(spark, sizes, like),
            by, ["event_id"], budget, f"{folder}/log", f"{folder}/state", SEED, "md5",
        ).start()
        counted = stats_writer(
            stream(spark, sf_dir, "events"), by, "value", f"{folder}/stats", f"{folder}/stats-state"
        ).start()
    running = [drawn, counted]
    try:
        drawn.processAllAvailable()
        stats = publish_when_idle(
            spark, counted, f"{folder}/stats", f"{folder}/published", quiet_ms=500, limit_s=300
        )
        round_stats(stats, DIGITS).write.parquet(topic)
        latest = latest_stats_writer(
            spark.readStream.schema(stats.schema).parquet(topic), by, f"{folder}/latest", f"{folder}/latest-state"
        ).start()
        running.append(latest)
        version = allocate_when_idle(spark, latest, f"{folder}/latest", sizes, by, budget, limit_s=300)
        waves(events, replay, 1, 2)
        drawn.processAllAvailable()
    finally:
        for query in running:
            query.stop()
    allocation = materialize(read_allocation(spark, sizes, version))
    sample = materialize(read_reservoir(spark, f"{folder}/log", allocation))
    return rounded(sample_report(sample, allocation, by, "value"), "sample_mean", "sample_std")


def stream_allocation_events(spark, sf_dir):
    """Sizes from two waves of statistics; the second replaces what the first gave."""
    events = table(spark, sf_dir, "events")
    folder, by = run_folder(spark), ["event_type"]
    topic, sizes = f"{folder}/topic", f"{folder}/sizes"
    early = stored_stats(events.where(F.col("event_id") % 2 == 0), by, "value")
    whole = stored_stats(events, by, "value")
    budget = held(whole) // 20
    early.withColumn("version", F.lit(1)).write.parquet(topic)
    rows = spark.readStream.schema(spark.read.parquet(topic).schema).parquet(topic)
    query = latest_stats_writer(rows, by, f"{folder}/latest", f"{folder}/state", "version").start()
    try:
        allocate_when_idle(spark, query, f"{folder}/latest", sizes, by, budget, limit_s=300)
        done = time.time()
        whole.withColumn("version", F.lit(2)).write.mode("append").parquet(topic)
        allocate_when_idle(spark, query, f"{folder}/latest", sizes, by, budget, limit_s=300, after=done)
    finally:
        query.stop()
    return read_allocation(spark, sizes)


def stream_latest_stats_events(spark, sf_dir):
    """The newest statistics row of every kind of a stream of them, an old version last."""
    events = table(spark, sf_dir, "events")
    folder, by = run_folder(spark), ["event_type"]
    early = stratum_stats(events.withColumn("value", F.col("value") / 2), by, "value")
    later = stratum_stats(events.where(F.col("event_type") != "signup"), by, "value")
    rows = None
    for i, (stats, version) in enumerate(((early, 1), (later, 2), (early.limit(2), 1))):
        stats.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{folder}/topic")
        rows = spark.readStream.schema(spark.read.parquet(f"{folder}/topic").schema).parquet(f"{folder}/topic")
        writer = latest_stats_writer(rows, by, f"{folder}/latest", f"{folder}/state", "version")
        writer.trigger(availableNow=True).start().awaitTermination()
    return round_stats(read_latest(spark, f"{folder}/latest"), DIGITS).withColumn("version", F.col("version").cast("bigint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stratum_stats_orders": stratum_stats_orders,
    "stratum_stats_events": stratum_stats_events,
    "stratum_stats_lineitem": stratum_stats_lineitem,
    "stratum_stats_lineitem_supplier": stratum_stats_lineitem_supplier,
    "stratum_key_parts": stratum_key_parts,
    "stratum_stats_clean_csv": stratum_stats_clean_csv,
    "rejected_csv": rejected_csv,
    "clean_documents_csv": clean_documents_csv,
    "csv_file_stats_events": csv_file_stats_events,
    "latest_stats_events": latest_stats_events,
    "merge_stats_lineitem": merge_stats_lineitem,
    "stats_records_orders": stats_records_orders,
    "share_orders": share_orders,
    "totals_documents": totals_documents,
    "allocate_documents_give": allocate_documents_give,
    "allocate_documents_take": allocate_documents_take,
    "allocate_weight_list": allocate_weight_list,
    "allocate_degenerate": allocate_degenerate,
    "allocate_zero_strata": allocate_zero_strata,
    "allocate_infinite_share": allocate_infinite_share,
    "allocate_signed": allocate_customer("signed"),
    "allocate_abs": allocate_customer("abs"),
    "allocate_parts": allocate_parts,
    "allocate_lineitem_supplier": allocate_lineitem_supplier,
    "stratified_sample_orders": stratified_sample_orders,
    "stratified_sample_orders_fast": stratified_sample_orders_fast,
    "stratified_sample_events": stratified_sample_events,
    "stratified_sample_documents": stratified_sample_documents,
    "stratified_sample_lineitem": stratified_sample_lineitem,
    "stratified_sample_lineitem_keep": stratified_sample_lineitem_keep,
    "skip_sample_events": skip_sample_events,
    "skip_sample_documents": skip_sample_documents,
    "number_copies_lineitem": number_copies_lineitem,
    "sample_report_orders": sample_report_orders,
    "sample_report_documents": sample_report_documents,
    "nested_report_documents": nested_report_documents,
    "nested_report_orders": nested_report_orders,
    "report_lines_orders": report_lines_orders,
    "topic_records_events": topic_records_events,
    "topic_stats_events": topic_stats_events,
    "stream_stats_events": stream_stats_events,
    "stream_sample_events": stream_sample_events,
    "stream_report_events": stream_report_events,
    "idle_publish_events": idle_publish_events,
    "idle_emit_events": idle_emit_events,
    "jump_sample_orders": jump_sample_orders,
    "position_sample_orders": position_sample_orders,
    "stream_reservoir_events": stream_reservoir_events,
    "stream_two_phase_events": stream_two_phase_events,
    "stream_allocation_events": stream_allocation_events,
    "stream_latest_stats_events": stream_latest_stats_events,
}
