"""One query per operator over the tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.llm.common import read_table
from stratasift.llm.decontaminate import find_leaks
from stratasift.llm.digest import digest_report
from stratasift.llm.fill_in_middle import fill_in_middle, restored
from stratasift.llm.importance import resample
from stratasift.llm.language_model import score_language_model
from stratasift.llm.main_text import extract_main_text
from stratasift.llm.near_dups import near_duplicates
from stratasift.llm.packing import pack_documents
from stratasift.llm.quality import held_out, learn_quality, score_quality
from stratasift.llm.secret_scan import secret_report
from stratasift.llm.severity import grade_severity, learn_severity
from stratasift.llm.token_files import token_table
from stratasift.llm.transducer import piece_encode

#: Files of the public tokenizers.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return grade_severity(docs, learn_severity(docs, read_table(spark, sf_dir, "labels")))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language_model(read_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read_table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op5_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_report(read_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read_table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn_quality(docs, read_table(spark, sf_dir, "labels"), only=~held_out())
    return score_quality(docs, model, held_out().alias("held_out"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("h")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encode(read_table(spark, sf_dir, "documents"), PIECE_BPE)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read_table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), BYTE_BPE)


QUERIES = {
    "op1_severity": op1_severity,
    "op2_language_model": op2_language_model,
    "op3_secrets": op3_secrets,
    "op4_main_text": op4_main_text,
    "op5_digests": op5_digests,
    "op6_token_files": op6_token_files,
    "op7_leaks": op7_leaks,
    "op8_quality": op8_quality,
    "op9_near_dups": op9_near_dups,
    "op10_pieces": op10_pieces,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_importance": op12_importance,
    "op13_packing": op13_packing,
}
