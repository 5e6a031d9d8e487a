import zlib
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratasift.llm.queries import BYTE_BPE as PATH
from stratasift.llm.queries import QUERIES
from stratasift.llm.token_files import Encoder, mapped, read_token_files, token_table, write_token_files


@lru_cache
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_query_against_the_library(spark, sf, documents):
    t, at = library(), 0
    got = QUERIES["op6_token_files"](spark, sf).orderBy("doc_id").collect()
    for r, d in zip(got, documents.orderBy("doc_id").collect(), strict=True):
        ids = np.array([*t.encode(d["text"], add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_stretches_add_up_to_the_text():
    t = library()
    e = Encoder(open(PATH, encoding="utf-8").read())
    texts = ["a\t b\n\n c  ", "  x's 're\x1c!\x1c!  y　 z", "<|endoftext|> a", "\r\n é'll ''s 12 3", "", " "]
    for text, raw in zip(texts, e.encode(texts)):
        assert np.frombuffer(raw, e.kind).tolist() == t.encode(text, add_special_tokens=False).ids


ENCODER = Encoder(open(PATH, encoding="utf-8").read())
PIECES = [*"ab'Z19,-.<\0é中\u0301\x1c", " ", "  ", "\n", "\xa0", "\u2003", "\u3000", "'s", "'ll", "q" * 25, " " + "r" * 60]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=6))
def test_any_batch_equals_the_library(texts):
    t = library()
    for text, raw in zip(texts, ENCODER.encode(texts), strict=True):
        assert np.frombuffer(raw, ENCODER.kind).tolist() == t.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("stratasift.llm.token_files.MEMORY", 3)
    e = Encoder(open(PATH, encoding="utf-8").read())
    batches = [["a b c d e f"], ["a b x y"], ["f e d"], [""], ["a b c d e f"]]
    assert [e.encode(b) for b in batches][0] == e.encode(batches[-1])


def test_a_hot_key_is_dealt_to_several_parts(spark, tmp_path):
    """A third of all rows with one key: several files, keys in order over the files."""
    rows = [(7, f"text {i} " * 50) for i in range(3000)] + [(i % 3000 + 8, "x") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = write_token_files(docs, PATH, str(tmp_path / "f"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = read_token_files(spark, parts, str(tmp_path / "f"))
    keys = [r["doc_id"] for r in read.orderBy("start").collect()]
    assert keys == sorted(k for k, _ in rows)
    held = []
    for p in parts.collect():
        with mapped(str(tmp_path / "f"), f"{p.part}.keys", "<i8") as k:
            held.append(int((k == 7).sum()))
    assert sum(held) == 3000 and sum(h > 0 for h in held) > 1


def test_files_and_odd_rows(spark, odd, empty, tmp_path):
    parts = write_token_files(odd, PATH, str(tmp_path / "f"))
    rows = read_token_files(spark, parts, str(tmp_path / "f")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 3, 4, 5]
    assert [r["n_tokens"] for r in rows][0] == 1 and rows[4]["n_tokens"] == 1
    ends = np.cumsum([r["n_tokens"] for r in rows])
    assert [r["start"] for r in rows] == [0, *ends[:-1].tolist()]
    first = parts.orderBy("part").first()
    with mapped(str(tmp_path / "f"), f"{first['part']}.ids", first["kind"]) as ids:
        assert isinstance(ids, np.memmap) and ids[-1] == 0
    assert token_table(empty, PATH).collect() == []
