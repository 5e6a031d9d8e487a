"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder with the tables      (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores                 (default 8)
    BENCH_RUNS     timed runs, best one counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stratasift.operators.allocate import allocate
from stratasift.operators.sample import draw_sample
from stratasift.operators.stats import stratum_stats
from stratasift.plans import table_queries as tq
from stratasift.plans.whole_run import stratified_sample
from stratasift.session import local_session, materialize

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

BY = ["l_returnflag", "l_linestatus", "l_suppkey"]
VALUE = "l_extendedprice"
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def shuffled(spark, after: int) -> tuple[int, int]:
    """Bytes written to shuffles by stages after ``after``, and the last stage so far."""
    jvm = spark.sparkContext._jvm
    store = spark.sparkContext._jsc.sc().statusStore()
    doubles = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = store.stageList(None, False, False, doubles, jvm.java.util.ArrayList())
    seen = [stages.apply(i) for i in range(stages.size())]
    new = [s for s in seen if s.stageId() > after]
    return sum(s.shuffleWriteBytes() for s in new), max([after, *(s.stageId() for s in new)])


def main() -> None:
    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    lines = tq.table(spark, FOLDER, "lineitem").select(*dict.fromkeys([*BY, VALUE, *IDS]))
    rows = lines.count()
    stats = materialize(stratum_stats(lines, BY, VALUE))
    sizes = materialize(allocate(stats, BY, rows // 20))

    def run(name):
        return lambda: tq.QUERIES[name](spark, FOLDER)

    headline = {
        "stats_lineitem": lambda: stratum_stats(lines, BY, VALUE),
        "stats_orders": run("stratum_stats_orders"),
        "merge_stats_lineitem": run("merge_stats_lineitem"),
        "allocate_lineitem": lambda: allocate(stats, BY, rows // 20),
        "allocate_documents": run("allocate_documents_give"),
        "sample_rank_lineitem": lambda: draw_sample(lines, sizes, BY, IDS, 1),
        "sample_rank_md5_lineitem": lambda: draw_sample(lines, sizes, BY, IDS, 1, hasher="md5"),
        "sample_skip_lineitem": lambda: draw_sample(lines, sizes, BY, IDS, 1, "skip"),
        "sample_no_id_lineitem": run("stratified_sample_lineitem"),
        "whole_run_lineitem": lambda: stratified_sample(
            lines, BY, VALUE, rows // 20, IDS, seed=1
        ).report(),
        "report_orders": run("sample_report_orders"),
        "stream_stats_events": run("stream_stats_events"),
        "stream_sample_events": run("stream_sample_events"),
    }
    seconds, shuffle_bytes = {}, {}
    for name, query in headline.items():
        times = []
        _, stage = shuffled(spark, -1)
        for _ in range(RUNS):
            started = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(min(times), 3)
        shuffle_bytes[name] = shuffled(spark, stage)[0] // RUNS
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(FOLDER).name.removeprefix("sf"),
                "lineitem_rows": rows,
                "lineitem_rows_per_sec": {
                    name: round(rows / seconds[name]) for name in seconds if "lineitem" in name
                },
                "shuffle_bytes": shuffle_bytes,
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
