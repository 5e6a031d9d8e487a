"""Command line: feed a topic, compute statistics, draw samples.

    spark-submit --packages <spark-sql-kafka> launch.py feed   --file a.csv --topic data
    spark-submit ... launch.py stats  --topic data --groups 3,6,8 --value 7 --out stats
    spark-submit ... launch.py sample --topic data --groups 3,6,8 --value 7 --stats stats --budget 150

Columns are 1-based positions. ``--file`` reads CSV files in place of a topic, so
``python -m stratasift`` works without Kafka.
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.operators.allocate import allocate
from stratasift.operators.clean import clean
from stratasift.operators.report import report_lines, sample_report
from stratasift.operators.stats import latest_stats, sort_stats, stratum_stats
from stratasift.plans.whole_run import stratified_sample
from stratasift.session import checkpoint_dir, materialize
from stratasift.sources.csv import parse_csv, read_csv
from stratasift.sources.lines import read_lines
from stratasift.sources.positions import FILE, PLACE, with_position
from stratasift.sources.stats_table import read_stats, write_stats
from stratasift.sources.text import show_stats, write_lines
from stratasift.sources.topic import (
    read_topic,
    stats_from_records,
    stats_to_records,
    to_records,
    write_records,
)
from stratasift.streaming.idle import publish_when_idle, sample_when_idle
from stratasift.streaming.sample import sample_writer
from stratasift.streaming.stats import stats_writer


def positions(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def weights(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratasift")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, text: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, help=text)
        sub.add_argument("--file", help="CSV files with a header line")
        sub.add_argument("--topic", help="topic of CSV lines")
        sub.add_argument("--brokers", default="localhost:9092")
        return sub

    feed = job("feed", "send the lines of CSV files to a topic, or store them as records")
    feed.add_argument("--partitions", type=int, default=4)
    feed.add_argument("--out", help="folder for the records instead of a topic")

    for name, text in (("stats", "statistics per stratum"), ("sample", "samples per stratum")):
        sub = job(name, text)
        sub.add_argument("--groups", type=positions, default=[3, 6, 8])
        sub.add_argument("--value", type=int, default=7)
        sub.add_argument("--stream", action="store_true", help="read on until input is quiet")
        sub.add_argument("--timeout", type=int, default=1000, help="quiet time in ms")
        sub.add_argument("--checkpoint", help="folder of the stream's state; a restart goes on there")
        sub.add_argument("--on-bad", choices=["drop", "fail"], default="drop")
        if name == "stats":
            sub.add_argument("--out", required=True, help="folder for the statistics")
            sub.add_argument("--out-topic", help="topic to send the statistics to as well")
        else:
            sub.add_argument("--stats", help="folder the statistics are in")
            sub.add_argument("--stats-topic", help="topic the statistics are in")
            sub.add_argument("--budget", type=int, default=150)
            sub.add_argument("--weights", type=weights)
            sub.add_argument("--on-mismatch", choices=["error", "ignore"], default="error")
            sub.add_argument("--cv", choices=["signed", "abs"], default="signed")
            sub.add_argument("--method", choices=["rank", "skip"], default="rank")
            sub.add_argument("--seed", type=int, default=0)
            sub.add_argument("--out", help="folder for the text report")
    return top


def rows(spark: SparkSession, args: argparse.Namespace, stream: bool = False) -> DataFrame:
    """The input with text columns c1, c2, ...; topic rows also keep partition and offset."""
    names = [f"c{i}" for i in range(1, max([*args.groups, args.value]) + 1)]
    if args.topic:
        records = read_topic(spark, args.brokers, args.topic, stream)
        parsed = parse_csv(records.select("partition", "offset", "value"), "value", names)
        return parsed.select(*names, "partition", "offset")
    if not args.file:
        raise SystemExit("give --file or --topic")
    return read_csv(spark, args.file, names, stream=stream).select(*names)


def feed(spark: SparkSession, args: argparse.Namespace) -> None:
    records = to_records(read_lines(spark, args.file), args.partitions)
    if args.out:
        records.write.mode("overwrite").parquet(args.out)
    else:
        write_records(records, args.brokers, args.topic)


def state_folder(spark: SparkSession, args: argparse.Namespace) -> str:
    return args.checkpoint or f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def stats(spark: SparkSession, args: argparse.Namespace) -> None:
    names = [f"c{i}" for i in args.groups]
    value = f"c{args.value}"
    if args.stream:
        folder = state_folder(spark, args)
        query = stats_writer(
            rows(spark, args, True), names, value, f"{folder}/stats", f"{folder}/state", args.on_bad
        ).start()
        try:
            publish_when_idle(spark, query, f"{folder}/stats", args.out, args.timeout)
        finally:
            query.stop()
    else:
        write_stats(stratum_stats(rows(spark, args), names, value, args.on_bad), args.out)
    table = read_stats(spark, args.out)
    if args.out_topic:
        sent = table.withColumn("version", F.unix_millis(F.current_timestamp()))
        write_records(stats_to_records(sent), args.brokers, args.out_topic)
    show_stats(sort_stats(table, names))


def stored(spark: SparkSession, args: argparse.Namespace, names: list[str]) -> DataFrame:
    """Statistics of an earlier run; from a topic, the newest row of each stratum."""
    if args.stats:
        return read_stats(spark, args.stats)
    if not args.stats_topic:
        raise SystemExit("give --stats or --stats-topic")
    fields = [*[f"{c} string" for c in names], "mean double, std double, n bigint, version bigint"]
    records = read_topic(spark, args.brokers, args.stats_topic)
    return latest_stats(stats_from_records(records, ", ".join(fields)), names, "version")


def sample_stream(spark: SparkSession, args: argparse.Namespace) -> None:
    """The sample of a stream and its report, stored once the whole stream is quiet.

    Rows of files are told apart by their places, so each of several equal rows has its own
    chance; the report shows the columns that are read.
    """
    names, value = [f"c{i}" for i in args.groups], f"c{args.value}"
    table = stored(spark, args, names)
    sizes = materialize(allocate(table, names, args.budget, args.weights, args.cv, args.on_mismatch))
    stream = rows(spark, args, True)
    shown = ["partition", "offset"] if args.topic else stream.columns
    ids, place = ([FILE], PLACE) if args.file else (shown, None)
    keep = [c for c in [*shown, *ids] if c not in (*names, value)]
    if args.file:
        stream = with_position(stream)
    cleaned = clean(stream, names, value, keep=keep, on_bad=args.on_bad)
    folder = state_folder(spark, args)
    query = sample_writer(
        cleaned, sizes, names, ids, f"{folder}/sample", f"{folder}/state", args.seed, place=place
    ).start()
    try:
        drawn = sample_when_idle(spark, query, f"{folder}/sample", args.timeout)
        report = sample_report(drawn, sizes, names, value)
        if args.out:
            write_lines(report_lines(drawn, report, names, value, shown), args.out)
        show_stats(sort_stats(report, names))
    finally:
        query.stop()


def sample(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.stream:
        return sample_stream(spark, args)
    names = [f"c{i}" for i in args.groups]
    run = stratified_sample(
        rows(spark, args),
        names,
        f"c{args.value}",
        args.budget,
        ids=["partition", "offset"] if args.topic else None,
        weights=args.weights,
        seed=args.seed,
        method=args.method,
        cv=args.cv,
        on_bad=args.on_bad,
        on_mismatch=args.on_mismatch,
        stats=stored(spark, args, names),
    )
    if args.out:
        write_lines(run.lines(), args.out)
    show_stats(sort_stats(run.report(), run.by))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    # intermediate results go when the job no longer holds them
    cleaned = "spark.cleaner.referenceTracking.cleanCheckpoints"
    spark = SparkSession.builder.appName(f"stratasift {args.job}").config(cleaned, "true").getOrCreate()
    {"feed": feed, "stats": stats, "sample": sample}[args.job](spark, args)


if __name__ == "__main__":
    main()
