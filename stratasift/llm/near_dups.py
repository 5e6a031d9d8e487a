"""Near-duplicates by BagMinHash signatures of weighted word shingles.

A text is the multiset of its five-word shingles: the weight of a shingle is how often it
occurs. Weights are cut at 1, 2, 4, 8, ...; on every interval below a shingle's weight runs
a Poisson process whose rate is the interval's length, driven by hashes of the shingle. Each
point falls on one of M registers and has a level in its interval; points above the weight
are skipped. A register keeps its earliest point, so two texts agree on a register with a
probability equal to their weighted Jaccard similarity (sum of least over sum of largest
weights).

Texts that agree on all registers of a band are candidates. Every bucket links its members
to its least member, then, where that left several components, to its member with the most links;
those pairs are verified on the multisets themselves. Buckets whose members are still in
different components may hold more links. Their members are joined on rare shingles: with all shingles ordered from rare to frequent, two texts that are similar enough
share one among the first of both, and what follows it is long enough in both. The few pairs
that meet this bound are verified too. No bucket is expanded into all its pairs, and no link
between members of a bucket is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratasift.llm.common import ALNUM, map_slices, mix, raw_text, shingles_of, stored, text_input, words_of
from stratasift.llm.components import components

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
SIMILAR = 0.8
WIDTH = 5
#: Bytes of text per step where each has a second text beside it or becomes a row per shingle,
#: which is about ten times its size.
PAIR_BYTES = 1 << 20


def weighted_shingles(array: pa.Array, width: int = WIDTH):
    """(text's place, shingle, weight), in order of place and shingle."""
    place, words, _, _ = words_of(array, ALNUM)
    place, hashes = shingles_of(place, words, len(array), width)
    if not len(hashes):
        return place, hashes, np.zeros(0, np.int64)
    order = np.lexsort((hashes, place))
    place, hashes = place[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (hashes[1:] != hashes[:-1])]))
    return place[new], hashes[new], np.diff(np.append(new, len(hashes)))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(place: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n_texts: int, m: int = REGISTERS):
    """The point kept by each register of each text, as an array (n_texts, m) of hashes.

    Points come in order of time, text by text up to a horizon by which all registers have
    probably been hit; texts with an empty register go on to a later horizon. The horizon
    does not change what is kept.
    """
    node_place, node_seed, low, size = [place], [shingles], [np.zeros(len(place))], [np.ones(len(place))]
    bottom, level = 1, 1
    while True:
        above = weights > bottom
        if not above.any():
            break
        node_place.append(place[above])
        node_seed.append(mix(shingles[above] ^ np.uint64((0xA0761D6478BD642F * level) & (2**64 - 1))))
        low.append(np.full(above.sum(), float(bottom)))
        size.append(np.full(above.sum(), float(bottom)))
        bottom, level = bottom * 2, level + 1
    owner, seed = np.concatenate(node_place), np.concatenate(node_seed)
    low, size = np.concatenate(low), np.concatenate(size)
    top = np.concatenate([weights] + [weights[weights > b] for b in (1 << i for i in range(level - 1))]).astype(float)
    total = np.bincount(place, weights=weights, minlength=n_texts)
    horizon = m * (np.log(m) + 2.5) / np.maximum(total, 1)
    kept_time = np.full(n_texts * m, np.inf)
    kept = np.zeros(n_texts * m, dtype=np.uint64)
    time = np.zeros(len(owner))
    step = np.zeros(len(owner), dtype=np.uint64)

    def advance(i: np.ndarray) -> None:
        step[i] += np.uint64(1)
        time[i] -= np.log(_unit(mix(seed[i] + step[i] * np.uint64(0x9E3779B97F4A7C15)))) / size[i]

    waiting = np.arange(len(owner))
    advance(waiting)
    while len(waiting):
        active = waiting[time[waiting] <= horizon[owner[waiting]]]
        while len(active):
            point = mix(seed[active] ^ mix(step[active]))
            level_at = low[active] + size[active] * _unit(mix(point))
            fits = np.ceil(level_at) <= top[active]
            hit, t, p = owner[active][fits], time[active][fits], point[fits]
            slot = hit * m + (p % np.uint64(m)).astype(np.int64)
            np.minimum.at(kept_time, slot, t)
            first = t == kept_time[slot]
            kept[slot[first]] = p[first]
            advance(active)
            active = active[time[active] <= horizon[owner[active]]]
        empty = np.isinf(kept_time).reshape(n_texts, m).any(axis=1) & (total > 0)
        horizon[empty] *= 1.7
        waiting = waiting[empty[owner[waiting]]]
    return kept.reshape(n_texts, m)


def band_keys(kept: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of each signature."""
    keys = np.empty((len(kept), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(kept), np.uint64(b + 1))
        for r in range(rows):
            h = mix(h ^ kept[:, b * rows + r])
        keys[:, b] = h
    return keys


def _sketch(part: pa.RecordBatch) -> pa.RecordBatch:
    array = part.column("text")
    n = len(array)
    place, shingles, weights = weighted_shingles(array)
    keys = band_keys(signatures(place, shingles, weights, n), BANDS, ROWS)
    # a digest of the multiset: sums of hashes do not depend on order
    sums = np.zeros((2, n), dtype=np.uint64)
    for i, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
        np.add.at(sums[i], place, mix(shingles ^ np.uint64(salt)) * weights.astype(np.uint64))
    have = np.bincount(place, minlength=n) > 0
    nodes = [sums[:, i].tobytes() for i in range(n)]
    data, offsets = raw_text(array)
    for i in np.flatnonzero(~have):  # a text without words is alike only to the same text
        nodes[i] = hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes()).digest()
    lists = np.where(have[:, None], keys, 0).view(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.where(have, BANDS, 0))]).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(lists[have].reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [part.column("key"), part.column("h"), pa.array(nodes, pa.binary()), bands],
        names=["key", "h", "node", "bands"],
    )


def multiset_similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in the same place of two arrays."""
    n = len(a)
    pa_, sa, wa = weighted_shingles(a)
    pb, sb, wb = weighted_shingles(b)
    place, shingle = np.concatenate([pa_, pb]), np.concatenate([sa, sb])
    weight = np.concatenate([wa, wb])
    order = np.lexsort((shingle, place))
    place, shingle, weight = place[order], shingle[order], weight[order]
    twin = (place[1:] == place[:-1]) & (shingle[1:] == shingle[:-1])
    i = np.flatnonzero(twin)
    both = np.bincount(place[i], weights=np.minimum(weight[i], weight[i + 1]), minlength=n)
    total = np.bincount(place, weights=weight, minlength=n)
    return np.where(total > 0, both / np.maximum(total - both, 1), 0.0)


def _verify(part: pa.RecordBatch) -> pa.RecordBatch:
    sim = multiset_similarity(part.column("text"), part.column("text_b"))
    return pa.RecordBatch.from_arrays(
        [part.column("a"), part.column("b"), pa.array(sim)], names=["a", "b", "similarity"]
    )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of nodes, from their texts."""
    one = texts.select(F.col("node").alias("a"), "text")
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "text", "text_b")
    return stored(map_slices(rows, _verify, "a binary, b binary, similarity double", limit=PAIR_BYTES), "verified")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row: key, class_id (least key of its class), keep, and the text's hash ``h``.

    A class is a connected component of texts linked by a similarity of ``similar`` or more,
    copies included. Texts of fewer than five words are one shingle of all their words;
    texts without words (also null ones) are alike only to the same text. ``keep`` marks one
    text of each class, that of the least key (nulls last, then the least digest): all rows
    with the same key and text carry the same mark.
    """
    rows = text_input(docs, key, text).withColumn("h", F.xxhash64("text"))
    kind = rows.schema["key"].dataType.simpleString()
    sketched = stored(map_slices(rows, _sketch, f"key {kind}, h long, node binary, bands array<long>", ), "sketches")

    # buckets with several different texts; copies of a text count once
    members = sketched.select("node", F.explode("bands").alias("band")).distinct()
    leaders = members.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    buckets = stored(members.join(leaders.drop("n"), "band"), "buckets")
    stars = buckets.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()

    texts = _texts(rows, sketched, stars.select(F.col("a").alias("node")).unionAll(stars.select(F.col("b").alias("node"))))
    links = _verified(stars, texts)
    roots = components(links.where(F.col("similarity") >= similar).select("a", "b"))
    again = _hub_pairs(buckets, links, roots, similar)
    if not again.isEmpty():
        links = links.unionAll(_verified(again, texts))
        roots = components(links.where(F.col("similarity") >= similar).select("a", "b"))

    rest = _unsettled(buckets, texts, roots, similar)
    if not rest.isEmpty():
        more = _verified(rest, texts)
        both = links.unionAll(more).where(F.col("similarity") >= similar)
        roots = components(both.select("a", "b"))
    return _classes(sketched, roots, key)


def _texts(rows: DataFrame, sketched: DataFrame, nodes: DataFrame) -> DataFrame:
    """The text of every node in ``nodes``, from one of its rows."""
    place = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "h")).alias("p")
    chosen = sketched.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(place)
    chosen = chosen.select("node", F.col("p.key").alias("key_"), F.col("p.h").alias("h_"))
    same = rows["key"].eqNullSafe(chosen["key_"]) & (rows["h"] == chosen["h_"])
    # repeated rows have the same text: any of them will do
    return stored(rows.join(chosen, same).groupBy("node").agg(F.first("text").alias("text")), "texts")


def _hub_pairs(buckets: DataFrame, links: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """Each bucket's member with the most links so far, with the members not yet joined to it."""
    good = links.where(F.col("similarity") >= similar)
    ends = good.select(F.col("a").alias("node")).unionAll(good.select(F.col("b").alias("node")))
    degrees = ends.groupBy("node").agg(F.count("*").alias("degree"))
    placed = (
        buckets.join(roots, "node", "left")
        .join(degrees, "node", "left")
        .select("band", "node", F.coalesce("root", "node").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    )
    hubs = placed.groupBy("band").agg(
        F.max(F.struct("degree", "node", "root")).alias("hub"), F.min("root").alias("r1"), F.max("root").alias("r2")
    )
    hubs = hubs.where("r1 != r2").select("band", F.col("hub.node").alias("hub"), F.col("hub.root").alias("hub_root"))
    pairs = placed.join(hubs, "band").where("root != hub_root")
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    return stored(pairs.join(links, ["a", "b"], "left_anti"), "pairs")


#: Bits, as 64-bit numbers, in which a text's shingles are marked.
MARKS = 16


def _marks(place: np.ndarray, shingles: np.ndarray, n_texts: int) -> np.ndarray:
    """One bit per shingle of each text, at a place that depends on the shingle."""
    out = np.zeros((n_texts, MARKS), dtype=np.uint64)
    spot = mix(shingles ^ np.uint64(0x1D8E4E27C47D124F))
    word = (spot % np.uint64(MARKS)).astype(np.int64)
    np.bitwise_or.at(out, (place, word), np.uint64(1) << (spot >> np.uint64(58)))
    return out


def _shingle_rows(part: pa.RecordBatch) -> pa.RecordBatch:
    """A row per shingle; the text's marks stand in the row of its first shingle."""
    n = len(part)
    place, shingles, weights = weighted_shingles(part.column("text"))
    sizes = np.bincount(place, weights=weights, minlength=n).astype(np.int64)
    at = pa.array(place)
    first = np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]
    marks = _marks(place, shingles, n)[place[first]].view(np.int64).reshape(-1)
    ends = np.concatenate([[0], np.cumsum(np.where(first, MARKS, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(marks), mask=pa.array(~first))
    return pa.RecordBatch.from_arrays(
        [part.column("node").take(at), part.column("root").take(at), pa.array(sizes[place]), pa.array(shingles.view(np.int64)), pa.array(weights), lists],
        names=["node", "root", "size", "shingle", "weight", "marks"],
    )


def _unsettled(buckets: DataFrame, texts: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """Pairs of different components of a bucket that may still be similar enough.

    Of two texts x and y, every mark that only x has stands for a shingle that y lacks, so
    what they share is at most x's size less those marks. Pairs that cannot be similar by
    this bound are left out in the join itself, and a pair that shares several rare shingles
    comes from the first of them only.
    """
    root = F.coalesce("root", "node").alias("root")
    placed = buckets.join(roots, "node", "left").select("band", "node", root)
    mixed = placed.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2")
    nodes = placed.join(mixed.select("band"), "band", "left_semi").select("node", "root").distinct()
    kind = "node binary, root binary, size long, shingle long, weight long, marks array<long>"
    texts = nodes.join(texts, "node").select("node", "root", "text")
    rows = stored(map_slices(texts, _shingle_rows, kind, limit=PAIR_BYTES), "shingles")
    # shingles of one component only cannot be shared by two: they come first
    often = rows.groupBy("shingle").agg(
        F.count("*").alias("often"), (F.min("root") != F.max("root")).alias("across")
    )
    before = Window.partitionBy("node").orderBy("across", "often", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("size") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    first = (
        rows.drop("marks").join(often, "shingle")
        .withColumn("left", left)
        .where((F.col("left") >= similar * F.col("size") - 1e-9) & F.col("across"))
    )
    rare = stored(first.select("node", "root", "size", "shingle", "left", "often"), "prefixes")
    order = F.array_sort(F.collect_list(F.struct("often", "shingle")))
    about = rare.groupBy("node").agg(F.transform(order, lambda s: s["shingle"]).alias("rare"))
    about = about.join(rows.where("marks IS NOT NULL").select("node", "marks"), "node")
    some = stored(rare.join(about, "node"), "prefixes")
    x, y = some.alias("x"), some.alias("y")
    needed = similar * (F.col("x.size") + F.col("y.size")) / (1 + similar) - 1e-9
    shared = F.least("x.left", "y.left") >= needed
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    x_marks = [F.get("x.marks", F.lit(i)) for i in range(MARKS)]
    y_marks = [F.get("y.marks", F.lit(i)) for i in range(MARKS)]

    def lacking(ours: list, theirs: list):
        return sum((F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in zip(ours, theirs)), F.lit(0))

    close = (F.col("x.size") - lacking(x_marks, y_marks) >= needed) & (F.col("y.size") - lacking(y_marks, x_marks) >= needed)
    once = F.get(F.array_intersect("x.rare", "y.rare"), F.lit(0)) == F.col("x.shingle")
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & apart & shared & close & once)
    return stored(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), "pairs")


def _classes(sketched: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    nodes = sketched.groupBy("node").agg(F.min("key").alias("least"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("least").isNull().alias("last"), "least", "node")).alias("best")
    )
    chosen = rooted.join(best, "root").select(
        "node",
        F.col("best.least").alias("class_id"),
        (F.col("node") == F.col("best.node")).alias("first"),
    )
    keep = F.col("first") & F.col("key").eqNullSafe(F.col("class_id"))
    # a class may hold a third of all rows: its one row of ``chosen`` per text meets copies
    # dealt by text, which the join splits where they are many
    return sketched.select("key", "h", "node").join(chosen, "node").select(
        F.col("key").alias(key), "class_id", keep.alias("keep"), "h"
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each class left; all columns as they were.

    Of rows with the kept key and text that differ in other columns, the one whose columns
    have the least hash stays. Columns may have any names.
    """
    kept = near_duplicates(docs, key, text).where("keep").select(F.col(f"`{key}`").alias("key"), "h").distinct()
    mark = "h" + "_" * max(map(len, docs.columns))  # longer than any name there is
    hashed = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    same = hashed[f"`{key}`"].eqNullSafe(kept["key"]) & (hashed[mark] == kept["h"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*[c for c, f in zip(columns, docs.schema) if "map<" not in f.dataType.simpleString()])
    rows = hashed.join(kept, same, "left_semi").groupBy(f"`{key}`", mark)
    return rows.agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")
