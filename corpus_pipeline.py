"""The corpus pipeline: ``documents`` filtered, cleaned and encoded in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is written as Parquet to the shared folder and read again. All stages but the last
return the columns of ``docs`` as they were, whatever the names of the others.

A null text counts as empty, and stays null until it is encoded. Rows without doc_id take part
like others. Of rows with equal or similar texts one stays, repeated rows among them. An empty
table gives an empty result; without labels of both classes all rows get about the same score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratasift.llm.common import read_table, stored
from stratasift.llm.decontaminate import drop_leaks
from stratasift.llm.near_dups import drop_near_duplicates
from stratasift.llm.quality import drop_low_quality, held_out, learn_quality
from stratasift.llm.queries import PIECE_BPE
from stratasift.llm.secret_scan import redact_secrets
from stratasift.llm.transducer import piece_encode


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the quality model predicts 1; it is learnt from the labels of this table."""
    model = learn_quality(docs, read_table(spark, sf_dir, "labels"), only=~held_out())
    return drop_low_quality(docs, model)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return drop_near_duplicates(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets replaced by the secret's kind."""
    return redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every row."""
    return piece_encode(docs, PIECE_BPE)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_distinct),
    ("benchmark decontamination", keep_unleaked),
    ("secret scans", redact),
    ("SentencePiece encoding and decoding", encode),
]

#: The stages learn models, build signatures and run a transducer: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
