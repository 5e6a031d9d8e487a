import random
from pathlib import Path

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from stratasift.llm.queries import PIECE_BPE as MODEL
from stratasift.llm.transducer import Transducer, piece_decode, piece_encode

RAW = Path(MODEL).read_bytes()
BPE = Transducer(RAW)


def library(raw):
    model = sentencepiece.SentencePieceProcessor()
    model.LoadFromSerializedProto(raw)
    return model


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aab thTeén \n\t12=.▁中ß😀<s>", max_size=80))
def test_same_ids_and_text_as_the_library(text):
    text = text.replace("\0", "")
    ref = library(RAW)
    ids = BPE.encode(text)
    assert ids == ref.encode(text)
    assert BPE.decode(ids) == ref.decode(ids)


def test_pair_rule_is_what_merging_does():
    rng = random.Random(1)
    pieces = [p for p in BPE.ids if len(p) < 6]
    for _ in range(20_000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert BPE._stays(a, b) == (BPE.merged(a + b) == [a, b]), (a, b)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            import struct

            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_models_take_the_cheapest_path(fallback):
    words = ["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "ca"]
    scores = [-3.0, -2.0, -2.1, -2.3, -3.5, -3.6, -2.9, -4.4, -5.25, -3.8]
    pieces = [message([(1, b"<unk>"), (2, 0.0), (3, 2)])]
    if fallback:
        pieces += [message([(1, b"<0x%02X>" % i), (2, 0.0), (3, 6)]) for i in range(256)]
    pieces += [message([(1, w.encode()), (2, s)]) for w, s in zip(words, scores)]
    raw = message([(1, p) for p in pieces]) + message(
        [(2, message([(3, 1), (35, int(fallback))])), (3, message([(1, b"identity"), (3, 1), (4, 0)]))]
    )
    own, ref, rng = Transducer(raw), library(raw), random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("aabbcc é") for _ in range(rng.randint(0, 14)))
        assert own.encode(text) == ref.encode(text), text


def test_rows(spark, documents, odd, empty):
    out = {r["doc_id"]: r for r in piece_encode(documents, MODEL).collect()}
    ref = library(RAW)
    for r in documents.collect():
        assert list(out[r["doc_id"]]["ids"]) == ref.encode(r["text"])
        assert out[r["doc_id"]]["round_trip"]
    rows = piece_encode(odd, MODEL)
    assert rows.count() == 7 and rows.where("round_trip").count() == 7
    assert sorted(len(r["text"]) for r in piece_decode(rows, MODEL).collect()) == [0, 0, 5, 5, 26, 300003, 300003]
    assert piece_encode(empty, MODEL).collect() == []
