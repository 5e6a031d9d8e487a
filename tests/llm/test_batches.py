import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from stratasift.llm import common


def sizes(rows):
    """(rows, bytes) of each batch that a task gets."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    return common.map_arrow(rows, run, "n long, size long").collect()


@pytest.fixture
def limit(spark):
    """Sets the session's own limit; what was there before comes back."""
    before = spark.conf.get(common.BATCH_LIMIT)
    yield lambda value: spark.conf.set(common.BATCH_LIMIT, value)
    spark.conf.set(common.BATCH_LIMIT, before)


@pytest.mark.parametrize("name", ["text", "a.text"])
def test_batches_are_bounded_in_bytes(spark, limit, name):
    spark.conf.unset(common.BATCH_LIMIT)
    rows = spark.range(8000, numPartitions=1).select(F.repeat(F.lit("x"), 3000).alias(name))
    got = sizes(rows)
    assert sum(r["n"] for r in got) == 8000
    assert max(r["size"] for r in got) <= common.BATCH_BYTES + 100_000


def test_the_session_may_set_another_limit(spark, limit):
    limit("100k")
    rows = spark.range(200, numPartitions=1).select(F.repeat(F.lit("x"), 3000).alias("text"))
    got = sizes(rows)
    assert sum(r["n"] for r in got) == 200 and max(r["size"] for r in got) <= 110_000
    assert spark.conf.get(common.BATCH_LIMIT) == "100k"


def used():
    """MB of memory this process holds itself."""
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_freed_memory_is_given_back():
    blocks = [b"x" * (64 << 10) for _ in range(4000)]
    pin = b"x" * (64 << 10)  # above the others, so that glibc keeps them
    del blocks
    before = used()
    common.release()
    assert len(pin) and used() < before - 150


def test_small_batches_change_nothing(spark, sf, limit):
    def result():
        return sorted((r["doc_id"], tuple(r["ids"])) for r in cp.run(spark, sf).collect())

    limit(f"{common.BATCH_BYTES}b")
    want = result()
    limit("20k")
    assert want and result() == want
