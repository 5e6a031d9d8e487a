"""Results of streaming batches as a log of changes.

Batch b commits only what it changed, so it costs its changes, not the whole result. Every
``every`` batches the log is folded: ``base=<b>`` holds what batches up to b come to, and
older folders go one fold later, so that a reader who has begun can finish. A batch repeated
after a failure finds its folder committed and leaves it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasift.sources.versions import commit, drop, exists, names, read_text, write_text

BATCH, BASE, ABOUT = "batch=", "base=", "about.json"
NUMBER = "_batch"
EVERY = 16

Fold = Callable[[DataFrame], DataFrame]


def newest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each stratum the row that the latest batch wrote."""
    last = W.partitionBy(*by).orderBy(F.col(NUMBER).desc())
    return rows.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return [int(n.removeprefix(prefix)) for n in names(spark, path, prefix)]


def _folders(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """The newest fold and the batches behind it."""
    fits = lambda n: upto is None or n <= upto
    bases = [n for n in _numbers(spark, path, BASE) if fits(n)]
    after = bases[-1] if bases else -1
    batches = [n for n in _numbers(spark, path, BATCH) if n > after and fits(n)]
    found = [f"{path}/{BASE}{n:012d}" for n in bases[-1:]]
    return found + [f"{path}/{BATCH}{n:012d}" for n in batches]


def read_log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """All rows since the newest fold, with the number of the batch that wrote them."""
    folders = _folders(spark, path.rstrip("/"), upto)
    if not folders:
        raise FileNotFoundError(f"no batch result under {path}")
    return spark.read.parquet(*folders)


def append(changes: DataFrame, path: str, batch: int, fold: Fold, every: int = EVERY) -> None:
    """Commit what ``batch`` changed, and fold the log where it has grown long."""
    spark, root = changes.sparkSession, path.rstrip("/")
    if batch == 0:  # a new stream: forget what an earlier one left
        for prefix in (BATCH, BASE):
            for name in names(spark, root, prefix):
                drop(spark, root, name)
    commit(changes.withColumn(NUMBER, F.lit(batch).cast("bigint")), root, f"{BATCH}{batch:012d}")
    bases = _numbers(spark, root, BASE)
    if batch - (bases[-1] if bases else -1) < every:
        return
    commit(fold(read_log(spark, root, batch)), root, f"{BASE}{batch:012d}")
    for n in bases[:-1]:
        drop(spark, root, f"{BASE}{n:012d}")
    for n in _numbers(spark, root, BATCH):
        if bases and n <= bases[-1]:
            drop(spark, root, f"{BATCH}{n:012d}")


def describe(spark: SparkSession, path: str, about: dict) -> None:
    """Note beside a log what its readers need to know."""
    write_text(spark, f"{path.rstrip('/')}/{ABOUT}", json.dumps(about))


def description(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, f"{path.rstrip('/')}/{ABOUT}")
    return None if text is None else json.loads(text)


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each stratum in a log that was described with its group columns."""
    about = description(spark, path)
    if about is None or not exists(spark, path):
        raise FileNotFoundError(f"no batch result under {path}")
    return newest(read_log(spark, path), about["by"]).drop(NUMBER)
