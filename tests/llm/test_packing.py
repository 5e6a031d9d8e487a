import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratasift.llm.packing import pack, pack_documents, sequences
from stratasift.llm.queries import BYTE_BPE, QUERIES


@lru_cache
def library():
    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    return t


def naive_pieces(doc_id, text, length=1024):
    ids = [*library().encode(text or "", add_special_tokens=False).ids, 2]
    head = (len(ids) - 1) % length + 1
    cuts = [0, *range(head, len(ids) + 1, length)]
    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
        yield doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def naive_pack(lengths, capacity):
    """Gaps of all sequences: every piece, longest first, tries every open gap."""
    gaps = Counter()
    done = 0
    for s in sorted(lengths, reverse=True):
        best = None
        for g in sorted(g for g in gaps if g >= s and gaps[g]):
            after = gaps.copy()
            after[g] -= 1
            if g > s:
                after[g - s] += 1
            squares = sum(n * n for n in after.values())
            if best is None or squares < best[0]:
                best = squares, g, after
        if best is None:
            done += s == capacity
            if s < capacity:
                gaps[capacity - s] += 1
        else:
            done += best[1] == s
            gaps = best[2]
    return sorted([0] * done + list(gaps.elements()))


def check_places(rows, length=1024):
    """Pieces of each sequence lie side by side from 0; returns the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at <= length
    return len(held)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_query_against_brute_force(spark, sf, documents):
    got = QUERIES["op13_packing"](spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    want = [p for d in documents.collect() for p in naive_pieces(d.doc_id, d.text)]
    assert plain(r[:5] for r in rows) == plain(want)
    lengths = [p[3] for p in want]
    assert check_places(rows) == len(naive_pack(lengths, 1024))
    assert check_places(rows) <= 1.02 * -(-sum(lengths) // 1024)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_pack_equals_the_plain_rule(lengths):
    sequence, offset, gaps = pack(np.array(lengths, np.int64), 20)
    assert sorted(gaps.tolist()) == naive_pack(lengths, 20)
    held = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths):
        held[s].append((o, n))
    for s, parts in held.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()]
        assert gaps[s] == 20 - ends[-1]


def test_groups_and_rounds(spark):
    """Many small groups in rounds come close to one group, and place every piece once."""
    docs = spark.range(1500).selectExpr("id as doc_id", "repeat('word ', cast(pmod(hash(id), 97) as int)) as text")
    one = pack_documents(docs, BYTE_BPE, length=64)
    many = pack_documents(docs, BYTE_BPE, length=64, group=100)
    pieces = one.columns[:5]
    assert plain(one.select(pieces).collect()) == plain(many.select(pieces).collect())
    single, grouped = check_places(one.collect(), 64), check_places(many.collect(), 64)
    least = -(-one.agg(F.sum("length")).first()[0] // 64)
    assert least <= single <= grouped <= 1.05 * least


def test_pieces_that_never_match_end_the_rounds(spark):
    """Pieces of over half a sequence: no round can help, each has its own."""
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('word ', 40) as text")
    out = pack_documents(docs, BYTE_BPE, length=64, group=20).collect()
    assert check_places(out, 64) == 300


def test_odd_rows(spark, odd, empty):
    docs = odd.withColumn("length", F.lit("x")).withColumn("piece", F.lit(1)).withColumn("gap", F.lit(2))
    out = pack_documents(docs, BYTE_BPE)
    want = [p for r in odd.collect() for p in naive_pieces(r.doc_id, r.text)]
    rows = out.collect()
    assert plain(r[:5] for r in rows) == plain(want)
    check_places(rows)
    assert pack_documents(empty, BYTE_BPE).collect() == []
    with pytest.raises(ValueError):
        pack_documents(odd, BYTE_BPE, length=0)


def test_sequences_hold_the_documents(spark, documents):
    packed = pack_documents(documents, BYTE_BPE, length=512, ids=True).persist()
    made = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in sequences(packed).collect()}
    texts = {d.doc_id: d.text for d in documents.collect()}
    found = defaultdict(list)
    for r in packed.select("doc_id", "piece", "sequence_id", "offset", "length").collect():
        found[r.doc_id].append((r.piece, made[r.sequence_id][r.offset : r.offset + r.length].tolist()))
    for doc_id, parts in found.items():
        ids = [i for _, part in sorted(parts) for i in part]
        assert ids == [*library().encode(texts[doc_id], add_special_tokens=False).ids, 2]
    packed.unpersist()
