"""Secret scan over a trigram index, in DataFrame operations only.

1. The rules' patterns give Boolean queries over trigrams (:mod:`secret_rules`).
2. Documents are dealt to blocks by a hash. The index has one row per block and trigram: the
   sorted numbers (32 bits) of the block's documents whose lower-cased text holds it. Only
   trigrams that some query asks for are indexed.
3. In each block a query's ANDs are intersections of posting lists and its ORs are unions;
   the documents left are the rule's candidates.
4. Only candidates are brought back to their texts and verified with the pattern itself.
   Rules without mandatory trigrams are matched on every text where it is read.

A document's number is a hash of its key and text, so two of a block may share one; such a
document is verified in vain, and none is lost.

Spans are counted in code points from the texts between the matches: a text is split at the
pattern, so the lengths of gaps and matches add up to the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratasift.llm.common import text_input
from stratasift.llm.secret_rules import BASE_KINDS, RULES, Query, Rule, queries

#: Documents of a block, on average: bounds the lists that are intersected at once.
BLOCK_DOCS = 4096
_MATCH = "struct<kind:int,place:int,gap:int,size:int,ok:boolean>"


def _least(rule: Rule) -> str:
    """A pattern for a first look: some match may be long enough."""
    if rule.group == 0 and rule.least and rule.pattern.endswith("+"):
        fixed = {"hex": 0, "access": 4}.get(rule.kind, 0)
        return f"{rule.pattern[:-1]}{{{rule.least - fixed},}}"
    return rule.pattern


def numbered(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with their block and their number in it."""
    return rows.withColumns(
        {"block": F.pmod(F.xxhash64("key", "h"), F.lit(blocks)).cast("int"), "doc": F.hash("h", "key")}
    )


def posting_lists(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(block, gram, docs): the sorted numbers of the block's documents that hold the trigram."""
    low = rows.select("block", "doc", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    hits = low.select("block", "doc", F.explode(held).alias("gram"))
    return hits.groupBy("block", "gram").agg(F.array_sort(F.collect_set("doc")).alias("docs"))


def _answer(query: Column) -> Column:
    """The documents of a block that a query's posting lists leave; ``lists`` maps trigrams to them."""
    nothing = F.array().cast("array<int>")

    def docs(gram: Column) -> Column:
        return F.coalesce(F.col("lists")[gram], nothing)

    def both(alternative: Column) -> Column:
        rest = F.slice(alternative, 2, F.size(alternative))
        return F.aggregate(rest, docs(alternative[0]), lambda a, g: F.array_intersect(a, docs(g)))

    def either(clause: Column) -> Column:
        return F.aggregate(clause, nothing, lambda a, alternative: F.array_union(a, both(alternative)))

    rest = F.slice(query, 2, F.size(query))
    return F.aggregate(rest, either(query[0]), lambda a, clause: F.array_intersect(a, either(clause)))


def candidates(lists: DataFrame, wanted: dict[str, Query]) -> DataFrame:
    """(block, doc, kinds): documents that may match, and the rules they may match."""
    index = lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "docs"))).alias("lists"))
    array = lambda xs: F.array(*xs)
    asked = array(
        F.struct(F.lit(kind).alias("kind"), array(array(array(map(F.lit, a)) for a in c) for c in q).alias("query"))
        for kind, q in wanted.items()
    )
    answers = F.transform(asked, lambda r: F.struct(r["kind"].alias("kind"), _answer(r["query"]).alias("docs")))
    each = index.select("block", F.explode(answers).alias("a")).select("block", "a.kind", F.explode("a.docs").alias("doc"))
    return each.groupBy("block", "doc").agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, order: int, wanted: Column) -> Column:
    """Array of (order, place, gap before, length, long enough) of all matches of a text."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    judged = F.regexp_extract_all("text", pattern, F.lit(rule.group))
    gaps = F.split("text", rule.pattern, -1)
    zipped = F.arrays_zip(found, judged, F.slice(gaps, 1, F.size(found)))
    rows = F.transform(
        zipped,
        lambda m, i: F.struct(
            F.lit(order).alias("kind"),
            i.alias("place"),
            F.length(m["2"]).alias("gap"),
            F.length(m["0"]).alias("size"),
            (F.length(m["1"]) >= rule.least).alias("ok"),
        ),
    )
    nothing = F.array().cast(f"array<{_MATCH}>")
    seen = wanted & F.regexp_like("text", F.lit(_least(rule)))
    return F.when(seen, rows).otherwise(nothing)


def _found(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, h, copies, found) for every distinct pair of key and text in ``rows``."""
    wanted, grams = queries(rules)
    rows = numbered(rows, max(1, -(-rows.count() // BLOCK_DOCS)))
    scanned, indexed = [], []
    for i, r in enumerate(rules):
        if r.kind in wanted:
            indexed.append(_matches(r, i, F.array_contains("kinds", r.kind)))
        else:
            scanned.append(_matches(r, i, F.lit(True)))
    row = F.expr("array(named_struct('kind', -1, 'place', 0, 'gap', 0, 'size', 0, 'ok', false))").cast(f"array<{_MATCH}>")
    every = rows.select("key", "h", F.explode(F.concat(row, *scanned)).alias("m"))
    if indexed:
        some = rows.join(candidates(posting_lists(rows, grams), wanted), ["block", "doc"])
        every = every.unionAll(some.select("key", "h", F.explode(F.concat(*indexed)).alias("m")))
    # repeated rows have the same matches, so a match's count is that of the rows
    every = every.select("key", "h", "m.*").groupBy("key", "h", "kind", "place", "gap", "size", "ok").agg(F.count("*").alias("copies"))
    upto = Window.partitionBy("key", "h", "kind").orderBy("place")
    ends = every.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct((F.col("end") - F.col("size")).alias("start"), F.col("kind"), F.col("end").alias("end"))
    named = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("ok"), span))),
        lambda s: F.struct(s["start"], F.get(kinds, s["kind"]).alias("kind"), s["end"]),
    )
    return ends.groupBy("key", "h").agg(F.first("copies").alias("copies"), named.alias("found"))


def secret_spans(docs: DataFrame, rules: list[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``found``: the secrets of each text as an array of (start, kind, end).

    One row out per row in (repeated rows and null keys included); null and empty texts
    have none. Positions are code points, the end exclusive; ``found`` is in order of start,
    then of the rule in ``rules``.
    """
    rows = text_input(docs, key, text).withColumn("h", F.xxhash64("text"))
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return _found(rows, rules).select(F.col("key").alias(key), "found", each).drop("_copy")


def redact_secrets(docs: DataFrame, rules: list[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns, every found span of ``text`` replaced by ``<kind>``.

    Overlapping spans become one replacement, named by the first. A null text stays null.
    Columns may have any names; repeated rows stay repeated.
    """
    found = _found(text_input(docs, key, text).withColumn("h", F.xxhash64("text")), rules)
    some = found.where(F.size("found") > 0).select(F.col("key").alias("_key"), F.col("h").alias("_h"), F.col("found").alias("_found"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    body = docs[f"`{text}`"]

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))
        inside = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(fresh).alias("out")
        )

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body)))

    # columns by their table, as the other one may have columns of the same names
    same = docs[f"`{key}`"].eqNullSafe(some["_key"]) & (F.xxhash64(body) == some["_h"])
    clean = F.when(some["_found"].isNull(), body).otherwise(F.aggregate(some["_found"], start, step, end))
    columns = [clean.alias(text) if c == text else docs[f"`{c}`"] for c in docs.columns]
    return docs.join(some, same, "left").select(*columns)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return secret_spans(docs, key=key, text=text).select(
        key,
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
