"""A bigram model in Elias-Fano tries, learnt from and applied to whole texts.

P(w | p) = (c(p, w) + MU * P(w)) / (c(p) + MU), with P(w) = (c(w) + 1) / (N + V + 1) and
c(unknown) = 0. Every predecessor is a context; only a text's first token has P(w) alone.
(COMMON, infinite unless set, is a share of all tokens from which on contexts are ignored.)

In logarithms a text's score is a sum with one term for each (w, p) and one for each p, so
it can be put together from parts: everything that depends on w, with its contexts, is
computed where all of w's occurrences meet.

1. Tasks count the words of their texts; the counts meet by shards of the word. N, V and the
   common words (at most 1 / LISTED of them) go to every task.
2. Tasks send, to the shard of each word, its contexts and how often which texts hold them.
   Terms of a common word alone, as word or as context, are added up on the spot; pairs of a
   common word are dealt by word and context, so no shard gets a hot word whole, and a hot
   pair is one entry for each text.
3. A shard counts pairs over the training texts, writes its trie to the shared folder, maps
   it and looks every pair up. Sums go back by text.

What is sent grows with the input. Words are 64-bit hashes, contexts 40-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stratasift.llm.common import BLANKS, crc_remainder, map_arrow, map_slices, mix, shared_folder, stored, text_input, words_of
from stratasift.llm.elias_fano import CONTEXT_BITS, Trie
from stratasift.llm.token_files import _open, mapped

MU = 20.0
#: Words with this share of all tokens or more have their counts in every task.
LISTED = 1e-5
#: Contexts with this share of all tokens or more are ignored: none are.
COMMON = float("inf")
SHARD_BYTES, SEND_BYTES = 24 << 20, 8 << 20
U64 = np.uint64
END, START, NONE = U64(0x1DF0C3A1E2B94D57), U64(0x7A646E19B3C1F2E5), U64(0)
_CONTEXT = U64((1 << CONTEXT_BITS) - 1)


def tokens_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, word) of all tokens in order: a text's words, then END."""
    place, words, _, _ = words_of(array, BLANKS)
    n = len(array)
    counts = np.bincount(place, minlength=n)
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(words) + n, dtype=U64)
    whole = np.empty(len(words) + n, dtype=np.int64)
    out[ends], whole[ends] = END, np.arange(n)
    rest = np.ones(len(out), dtype=bool)
    rest[ends] = False
    out[rest], whole[rest] = words, place
    return whole, out


def _by_shard(shard: np.ndarray, n: int):
    """(shard, places) of every shard that occurs; places keep their order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n + 1))
    return [(s, order[cuts[s] : cuts[s + 1]]) for s in range(n) if cuts[s + 1] > cuts[s]]


def _counts(rows: DataFrame, shards: int) -> tuple[int, int, dict]:
    """N, V and the common words' counts (and 1 for those that are ignored as contexts)."""
    listed = min(LISTED, COMMON)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        place, words = tokens_of(part.column("text"))
        train = ~np.asarray(part.column("held"))
        words, n = np.unique(words[train[place]], return_counts=True)
        out = [(s, words[i].tobytes(), n[i].astype("<u4").tobytes()) for s, i in _by_shard((words % U64(shards)).astype(int), shards)]
        return pa.RecordBatch.from_pydict(
            {"shard": pa.array([o[0] for o in out], pa.int32()), "words": pa.array([o[1] for o in out], pa.binary()), "n": pa.array([o[2] for o in out], pa.binary())}
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = np.zeros(0, U64), np.zeros(0, np.int64)
        for batch in batches:
            for w, c in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist()):
                words = np.concatenate([words, np.frombuffer(w, U64)])
                n = np.concatenate([n, np.frombuffer(c, "<u4")])
            words, back = np.unique(words, return_inverse=True)
            n = np.bincount(back, weights=n, minlength=len(words)).astype(np.int64)
        often = n >= listed * n.sum()
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array([None, *words[often].view(np.int64)], pa.int64()),
                "c": pa.array([int(n.sum()), *n[often]], pa.int64()),
                "v": pa.array([len(words), *[0] * int(often.sum())], pa.int64()),
            }
        )

    sent = map_slices(rows, count, "shard int, words binary, n binary", limit=SEND_BYTES)
    dealt = sent.repartitionById(shards, F.col("shard"))
    found = stored(map_arrow(dealt, add, "word long, c long, v long"), "words")
    total = found.where("word IS NULL").agg(F.sum("c"), F.sum("v")).first()
    n, v = total[0] or 0, total[1] or 0
    common = found.where(F.col("word").isNotNull() & (F.col("c") >= listed * n)).collect()
    words = np.array([r["word"] for r in common], dtype=np.int64).view(U64)
    order = np.argsort(words)
    c = np.array([r["c"] for r in common], dtype=np.int64)[order]
    return n, v, {"words": words[order], "c": c, "plain": (c >= COMMON * max(n, 1)).astype(np.int64)}


def _lookup(table: dict, words: np.ndarray, column: str = "c") -> np.ndarray:
    """Counts (or another column) of common words, 0 for others."""
    if not len(table["words"]):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(table["words"], words), len(table["words"]) - 1)
    return np.where(table["words"][at] == words, table[column][at], 0)


def _send(part: pa.RecordBatch, shards: int, table: dict, n: int, v: int) -> pa.RecordBatch:
    """One row with what is known here of every text, and one per shard with what is not.

    All rows carry the part's first uid as their block.
    """
    place, words = tokens_of(part.column("text"))
    many = len(part)
    held = np.asarray(part.column("held"))
    uid = part.column("uid").to_numpy()
    before = np.concatenate([[START], words[:-1]]) if len(words) else words
    if len(words):
        before[np.concatenate([[True], place[1:] != place[:-1]])] = START
    c = _lookup(table, words)
    plain = _lookup(table, before, "plain") > 0
    context = np.where((before == START) | plain, NONE, (before & _CONTEXT) | U64(1))
    known = c > 0
    base = np.where(known, np.log10((c + 1) / (n + v + 1)), 0.0)
    here = known & (context == NONE)
    # a common word is also the context of the token after it
    after = known & (words != END) & (_lookup(table, words, "plain") == 0)
    score = np.where(here, base, 0.0) - np.where(after, np.log10(c + MU), 0.0)
    sums = [
        np.bincount(place[known], minlength=many),
        np.bincount(place, weights=base, minlength=many).astype(np.float64),
        np.bincount(place, weights=score, minlength=many).astype(np.float64),
    ]
    block = int(uid[0])
    first = _listed(
        block, pa.array(uid), part.column("key"), part.column("held"), pa.array(np.bincount(place, minlength=many)),
        pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]),
    )
    first = first.append_column("shard", pa.nulls(1, pa.int32())).append_column("packed", pa.nulls(1, pa.binary()))

    away = np.flatnonzero(~here)
    w, p, d = words[away], context[away], place[away]
    shard = (np.where(known[away], mix(w ^ p), w) % U64(shards)).astype(int)
    blobs, to = [], []
    for s, i in _by_shard(shard, shards):
        order = i[np.lexsort((d[i], p[i], w[i]))]
        blobs.append(_pack(w[order], p[order], d[order], uid, held))
        to.append(s)
    k = len(to)
    nothing = [pa.nulls(k, first.schema.field(name).type) for name in LISTS]
    rest = pa.RecordBatch.from_arrays(
        [pa.array([block] * k, pa.int64()), *nothing, pa.array(to, pa.int32()), pa.array(blobs, pa.binary())],
        names=first.schema.names,
    )
    return pa.Table.from_batches([first, rest]).combine_chunks().to_batches()[0]


LISTS = ("uid", "key", "held", "n_tokens", "n_known", "base", "score")


def _listed(block: int, *columns: pa.Array) -> pa.RecordBatch:
    """One row: the block and each column as a list."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists], names=["block", *LISTS])


def _pack(w, p, d, uid, held) -> bytes:
    """Sorted occurrences: distinct words, contexts of each, texts of each and how often."""
    new_w = np.concatenate([[True], w[1:] != w[:-1]])
    new_p = new_w | np.concatenate([[True], p[1:] != p[:-1]])
    new_d = np.flatnonzero(new_p | np.concatenate([[True], d[1:] != d[:-1]]))
    times = np.diff(np.append(new_d, len(w)))
    again = np.flatnonzero(times > 1)
    w, p, d, new_w, new_p = (x[new_d] for x in (w, p, d, new_w, new_p))
    texts, d = np.unique(d, return_inverse=True)
    pairs, ws = np.flatnonzero(new_p), np.flatnonzero(new_w)
    contexts = p[pairs]
    arrays = [
        w[ws],
        np.diff(np.append(np.searchsorted(pairs, ws), len(pairs))).astype("<u4"),
        contexts.astype("<u4"),
        (contexts >> U64(32)).astype("u1"),
        np.diff(np.append(pairs, len(w))).astype("<u4"),
        d.astype("<u2" if len(texts) <= 1 << 16 else "<u4"),
        uid[texts].astype("<i8"),
        held[texts].astype("u1"),
        again.astype("<u4"),
        times[again].astype("<u4"),
    ]
    head = np.array([len(a) for a in arrays], dtype="<u4")
    return b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def _unpack(blob: bytes):
    """(words, contexts, texts of each pair, the texts, uids, held, how often in each text)."""
    sizes = np.frombuffer(blob, "<u4", 10)
    kinds = ["<u8", "<u4", "<u4", "u1", "<u4", "<u2" if sizes[6] <= 1 << 16 else "<u4", "<i8", "u1", "<u4", "<u4"]
    at, out = 40, []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    words = np.repeat(out[0], out[1])
    contexts = out[2].astype(U64) | (out[3].astype(U64) << U64(32))
    times = np.ones(len(out[5]), dtype=np.int64)
    times[out[8]] = out[9]
    return words, contexts, out[4].astype(np.int64), out[5].astype(np.int64), out[6], out[7].astype(bool), times


def _shard(blobs: list[bytes], name: str, folder: str, table: dict, n: int, v: int):
    """Counts, trie and look-ups of one shard; per blob (uids, n_known, base, score) sums."""
    # texts of the pairs are unpacked one blob at a time, here and at the end
    parts = []
    for blob in blobs:
        words, contexts, spread, texts, _, held, times = _unpack(blob)
        trained = np.add.reduceat(np.where(held[texts], 0, times), np.cumsum(spread) - spread)
        parts.append((words, contexts, trained.astype(np.int32)))
    shift = np.concatenate([[0], np.cumsum([len(x[0]) for x in parts])])
    words, contexts, trained = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((contexts, words)).astype(np.int32)
    w, p = words[order], contexts[order]
    del words, contexts
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (p[1:] != p[:-1])])
    pair_of = np.empty(len(order), dtype=np.int32)
    pair_of[order] = np.cumsum(new, dtype=np.int32) - 1
    w, p = w[new], p[new]
    c2 = np.bincount(pair_of, weights=trained, minlength=len(w)).astype(np.int64)
    del order, new, trained

    # words: counts here, or the known total of a common word
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    word_of = np.cumsum(np.concatenate([[True], w[1:] != w[:-1]])) - 1
    distinct = w[first]
    total = _lookup(table, distinct)
    common = total > 0
    c1 = np.where(common, total, np.add.reduceat(c2, first))
    log_word = np.log10((c1 + 1) / (n + v + 1))
    log_pair = np.log10(c2 + MU * 10.0 ** log_word[word_of])

    # the trie of what training has seen
    in_words = c1 > 0
    in_pairs = (c2 > 0) & (p != NONE)
    per_word = np.bincount(word_of[in_pairs], minlength=len(distinct))[in_words]
    trie = Trie.build(
        distinct[in_words], log_word[in_words], np.concatenate([[0], np.cumsum(per_word)]), p[in_pairs], log_pair[in_pairs]
    )
    fs, base = _open(folder)
    with fs.open_output_stream(f"{base}/_{name}") as out:
        out.write(trie.to_bytes())
    fs.move(f"{base}/_{name}", f"{base}/{name.split('@')[0]}")
    del trie
    with mapped(folder, name.split("@")[0], "u1") as raw:
        trie = Trie.from_map(raw)
        rank = trie.find_words(distinct)
        unknown = np.log10(1 / (n + v + 1))
        word_log = np.where(rank >= 0, trie.word_log(np.maximum(rank, 0)) if len(trie.codes["word_code"]) else unknown, unknown)
        value = word_log[word_of] + np.where(p != NONE, np.log10(MU), 0.0)
        ask = np.flatnonzero((p != NONE) & (rank[word_of] >= 0))
        at = trie.find_contexts(rank[word_of[ask]], p[ask])
        value[ask[at >= 0]] = trie.context_log(at[at >= 0])
        del trie
    # a rare word is also the context of the token after it
    value -= np.where(common | (distinct == END), 0.0, np.log10(c1 + MU))[word_of]
    known = ((c1 > 0) & ~common)[word_of]
    base_value = np.where(common, 0.0, log_word)[word_of]
    out = []
    for blob, first_pair in zip(blobs, shift):
        _, _, spread, texts, uids, _, times = _unpack(blob)
        each, many = np.repeat(pair_of[first_pair : first_pair + len(spread)], spread), len(uids)
        sums = [np.bincount(texts, weights=x[each] * times, minlength=many) for x in (known, base_value, value)]
        out.append((uids, sums[0].astype(np.int64), sums[1], sums[2]))
    return out


def score_language_model(docs: DataFrame, held_out=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are a text's words (runs without ASCII blanks, A-Z lower-cased), then one end;
    a null or empty text has the end only. The model learns from the rows where ``held_out``
    (a column; default: crc32 of the key as text, modulo 7, is 2) is false, and scores all.
    ``base_score`` is the add-one unigram score. Repeated rows and null keys are scored each;
    without training rows every token is unknown.
    """
    held = crc_remainder(key, 7) == 2 if held_out is None else held_out
    rows = text_input(docs, key, text, held.alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, -(-size // SHARD_BYTES))
    n, v, table = _counts(rows, shards)
    share = docs.sparkSession.sparkContext.broadcast(table)
    folder = shared_folder(docs.sparkSession, "tries")
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    kind = rows.schema["key"].dataType.simpleString()
    key_type = to_arrow_type(rows.schema["key"].dataType)
    kinds = dict(zip(LISTS, ("long", kind, "boolean", "long", "long", "double", "double")))
    fields = "block long, " + ", ".join(f"{c} array<{k}>" for c, k in kinds.items())

    def send(part: pa.RecordBatch) -> pa.RecordBatch:
        return _send(part, shards, share.value, n, v)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            away = pc.is_valid(batch.column("shard"))
            yield batch.select(["block", *LISTS]).filter(pc.invert(away))
            for i in np.flatnonzero(np.asarray(away)):
                block, s, b = (batch.column(c)[int(i)].as_py() for c in ("block", "shard", "packed"))
                blobs.setdefault(s, []).append((block, b))
            # what the tasks hold from here on are the blobs alone
            del batch, away
            pa.default_memory_pool().release_unused()
        for s in sorted(blobs):
            name = f"shard-{s:06d}@{TaskContext.get().taskAttemptId()}"
            blocks, packed = zip(*sorted(blobs.pop(s)))
            for block, (uid, known, base, score) in zip(blocks, _shard(packed, name, folder, share.value, n, v)):
                k = len(uid)
                yield _listed(
                    block, pa.array(uid), pa.nulls(k, key_type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()),
                    pa.array(known), pa.array(base), pa.array(score),
                )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum the lists of each block, whose rows come one after the other."""
        held_block, lists = None, []

        def total() -> pa.RecordBatch:
            whole = pa.Table.from_arrays([pa.concat_arrays([x[c] for x in lists]) for c in LISTS], names=list(LISTS))
            uid, at = np.unique(whole.column("uid").to_numpy(), return_inverse=True)
            known = {c: np.asarray(whole.column(c).combine_chunks()) for c in ("n_known", "base", "score")}
            first = whole.filter(pc.is_valid(whole.column("n_tokens"))).sort_by("uid").combine_chunks()
            sums = {c: np.bincount(at, weights=x, minlength=len(uid)) for c, x in known.items()}
            columns = [first.column(c).combine_chunks() for c in ("key", "held", "n_tokens")]
            columns += [pa.array(sums["n_known"].astype(np.int64)), pa.array(sums["base"]), pa.array(sums["score"])]
            return pa.RecordBatch.from_arrays(columns, names=["key", "held", "n_tokens", "n_known", "base", "score"])

        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if block != held_block and lists:
                    yield total()
                    lists = []
                held_block = block
                lists.append({c: batch.column(c).slice(i, 1).flatten() for c in LISTS})
        if lists:
            yield total()

    numbered = rows.withColumn("uid", F.monotonically_increasing_id())
    sent = map_slices(numbered, send, f"{fields}, shard int, packed binary", limit=SEND_BYTES)
    # rows of blocks go through any shard; the sums of a block meet at the end
    to = F.coalesce("shard", F.pmod("block", F.lit(shards)).cast("int"))
    parts = map_arrow(sent.repartitionById(shards, to), answer, fields)
    met = parts.repartition(shards, "block").sortWithinPartitions("block")
    out = f"key {kind}, held boolean, n_tokens long, n_known long, base double, score double"
    whole = map_arrow(met, add_up, out)
    return whole.select(
        F.col("key").alias(key),
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
