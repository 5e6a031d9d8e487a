"""Uniform samples without replacement, ``si`` rows from every stratum.

The sample of a stratum is its ``si`` rows of smallest seeded priority. Three steps
keep hot strata out of single tasks and the shuffle near the size of the sample:

1. Cut while scanning. With n rows in the stratum, the si smallest of its n uniform
   priorities lie below (sqrt(si) + 3.5)^2 / n = (si + 7 sqrt(si) + 12.25) / n but for
   a chance near 1e-9, so rows above that limit are dropped before any shuffle.
2. Count per bucket. Candidates fall in priority buckets, of a few rows or, in large
   samples, a few thousand; running sums tell how many rows to take from each.
3. Take whole buckets where they lie. Only the one bucket of a stratum that is taken in
   part is shuffled and ranked, never a whole stratum. A bucket that came out much
   larger, because the data grew since the statistics, is cut into buckets again.

Strata that come out short of rows are drawn again without a limit, so the result
is exact whatever the limit did.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasift.functions.columns import resolve_all
from stratasift.functions.priority import SPAN, priority
from stratasift.operators.joins import BROADCAST_BYTES, attach, table_bytes
from stratasift.operators.skip import prune_partitions
from stratasift.session import materialize

BUCKET_ROWS = 4096
LEAST_BUCKET = 8
BUCKETS = 200_000  # about how many there are before they grow beyond LEAST_BUCKET rows
LARGE_BUCKET = 4  # times bucket_rows
SLACK = (7.0, 12.25)

P = "_p"
# Columns added to the rows on the way.
INTERNAL = {
    P, "_si", "_n", "_sid", "_limit", "_bucket", "_rank", "_take", "_rows",
    "_low", "_high", "_parts",
    "_salt", "_salts", "_slot", "_slot_limit",
}


def bucketed(rows: DataFrame, expected: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``_bucket``: equal steps of the priority below ``_limit``.

    ``expected`` is about how many rows the stratum has below ``_limit``.
    """
    buckets = F.greatest(F.lit(1), F.ceil(expected / bucket_rows))
    slot = F.floor(F.col(P).cast("double") / F.col("_limit") * buckets)
    return rows.withColumn("_bucket", F.least(slot, buckets - 1).cast("bigint"))


def rebucketed(candidates: DataFrame, counts: DataFrame, by: list[str], bucket_rows: int) -> DataFrame:
    """Candidates with buckets cut further by the rows that were counted in them.

    A stratum's buckets are all cut into as many parts, enough for its largest one.
    """
    most = counts.groupBy(*by).agg(F.ceil(F.max("_rows") / bucket_rows).alias("_parts"))
    widest = candidates.groupBy(*by, "_bucket").agg(F.min(P).alias("_low"), F.max(P).alias("_high"))
    share = (F.col(P) - F.col("_low")).cast("double") / (F.col("_high") - F.col("_low") + 1)
    part = F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1)
    return (
        candidates.join(widest.join(most, by), [*by, "_bucket"])
        .withColumn("_bucket", (F.col("_bucket") * F.col("_parts") + part).cast("bigint"))
        .drop("_low", "_high", "_parts")
    )


def bucket_counts(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Rows per stratum and bucket, and ``_take``, the rows the sample wants of it."""
    counts = candidates.groupBy(*by, "_bucket", "_si").agg(F.count("*").alias("_rows"))
    ahead = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_si") - F.coalesce(F.sum("_rows").over(ahead), F.lit(0))
    return counts.withColumn("_take", F.greatest(F.lit(0), F.least(F.col("_rows"), left)))


def take_smallest(
    candidates: DataFrame, counts: DataFrame, by: list[str], ids: list[str]
) -> DataFrame:
    """The ``_take`` rows of smallest priority in every (stratum, bucket)."""
    wanted = counts.where(F.col("_take") > 0).select(*by, "_bucket", "_take")
    inside = W.partitionBy(*by, "_bucket").orderBy(P, *ids)
    return (
        candidates.join(wanted, [*by, "_bucket"])
        .withColumn("_rank", F.row_number().over(inside))
        .where(F.col("_rank") <= F.col("_take"))
        .drop("_rank", "_take")
    )


def take_buckets(
    candidates: DataFrame, counts: DataFrame, by: list[str], ids: list[str]
) -> DataFrame:
    """As :func:`take_smallest`, for counts that are small and cheap to read again.

    Rows of buckets that are taken whole are not shuffled.
    """
    wanted = counts.where(F.col("_take") > 0)
    is_whole = F.col("_take") == F.col("_rows")
    whole = F.broadcast(wanted.where(is_whole).select(*by, "_bucket"))
    parted = F.broadcast(wanted.where(~is_whole))
    ranked = take_smallest(candidates, parted, by, ids)
    return candidates.join(whole, [*by, "_bucket"]).unionByName(ranked)


def draw_sample(
    data: DataFrame,
    allocation: DataFrame,
    by: Iterable[str],
    ids: Iterable[str],
    seed: int = 0,
    method: str = "rank",
    hasher: str = "xxhash64",
    slack: tuple[float, float] = SLACK,
    bucket_rows: int = BUCKET_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows of ``data`` in the sample, with the columns of ``data``.

    ``allocation`` gives ``si`` and ``n`` per stratum, as :func:`allocate` makes it;
    it is read several times.
    ``ids`` identify a row; see :func:`number_copies` where no column does. Strata
    without an allocation are left out; a stratum with fewer than ``si`` rows is
    taken whole. ``method='skip'`` also runs the rows below the limit through
    reservoirs, one per stratum and input partition, which skip most rows where no
    limit can be set; it picks the same rows as ``'rank'``. About ``bucket_rows`` rows of
    a stratum are ranked together at most.
    """
    if method not in ("rank", "skip"):
        raise ValueError(f"method must be 'rank' or 'skip', not {method!r}")
    groups = resolve_all(data, by)
    keys = resolve_all(data, ids)
    columns = data.columns
    if taken := sorted(INTERNAL.intersection(columns)):
        raise ValueError(f"rename the columns {taken}: the sample is worked out with these names")
    keyed = data.withColumn(P, priority(seed, keys, hasher))
    strata = allocation.where(F.col("si") > 0).select(
        *groups, F.col("si").alias("_si"), F.col("n").alias("_n")
    )
    if method == "skip":
        strata = materialize(strata.withColumn("_sid", F.monotonically_increasing_id()))
    near = F.col("_si") + F.lit(slack[0]) * F.sqrt("_si") + F.lit(slack[1])
    limit = F.least(F.ceil(near / F.col("_n") * SPAN), F.lit(SPAN)).cast("bigint")
    strata = strata.withColumn("_limit", limit)
    expected = F.col("_n") * (F.col("_limit") / SPAN)
    size, wanted, near_rows = strata.agg(
        table_bytes(strata, groups), F.sum("_si"), F.sum(expected)
    ).first()

    def below_limit(table: DataFrame) -> DataFrame:
        rows = attach(keyed, table, groups, P, "_limit", broadcast_bytes, size)
        return prune_partitions(rows, "_sid", "_si", P) if method == "skip" else rows

    def pick(found: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
        take = take_buckets if small else take_smallest
        return take(found, counts, groups, keys).select(*columns)

    def counted(table: DataFrame, rows_near: float) -> tuple[DataFrame, DataFrame, int, bool]:
        """Candidates, their counts, the rows to take, and if the counts can be broadcast."""
        step = min(bucket_rows, max(LEAST_BUCKET, int(rows_near / BUCKETS)))
        rows = materialize(bucketed(below_limit(table), expected, step))
        sizes = materialize(bucket_counts(rows, groups))
        facts = (F.max("_rows"), F.sum("_take"), table_bytes(sizes, groups))
        largest, taken, width = sizes.agg(*facts).first()
        if (largest or 0) > LARGE_BUCKET * bucket_rows:
            rows = materialize(rebucketed(rows, sizes, groups, bucket_rows))
            sizes = materialize(bucket_counts(rows, groups))
            largest, taken, width = sizes.agg(*facts).first()
        return rows, sizes, taken, width <= broadcast_bytes

    found, counts, taken, small = counted(strata, near_rows or 0)
    # No stratum gives more than si, so equal sums mean that none came out short.
    if taken == wanted:
        return pick(found, counts, small)
    totals = counts.groupBy(*groups).agg(F.sum("_rows").alias("_found"))
    short = materialize(
        strata.join(totals, groups, "left")
        .where(F.coalesce("_found", F.lit(0)) < F.least("_si", "_n"))
        .drop("_found")
        .withColumn("_limit", F.lit(SPAN).cast("bigint"))
    )
    near_rows = short.agg(F.sum(expected)).first()[0]
    if near_rows is None:
        return pick(found, counts, small)
    again, again_counts, _, again_small = counted(short, near_rows)
    enough = pick(found, counts.join(short.select(*groups), groups, "left_anti"), small)
    return enough.unionByName(pick(again, again_counts, again_small))
