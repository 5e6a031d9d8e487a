"""Splitting a row budget over the strata.

Each stratum asks for a part of the budget in proportion to
sqrt(weight) * std / mean. It gets at least one row and at most all it holds, and
the sizes sum to the budget exactly: rows left over are dealt out one by one in
order of the largest remainder, rows overspent are taken back in order of the
smallest, round after round.

The rounds are not played. With h_i the rows stratum i can still move,
T(r) = sum(min(h_i, r)) rows move in r full rounds. The largest r with
T(r) <= need is found from histograms of h; then the first need - T(r) strata that
have h_i > r move one more.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasift.functions.columns import group_columns, stratum
from stratasift.functions.ieee import divide
from stratasift.operators.ranking import SMALL_RANK, global_rank
from stratasift.session import materialize

HISTOGRAM = 1024


def _weighted(
    stats: DataFrame,
    by: list[str],
    weights: DataFrame | Sequence[float] | None,
    on_mismatch: str,
    small: int,
) -> DataFrame:
    """Statistics with a column ``_w``; missing and negative weights count as 1."""
    if weights is None:
        return stats.withColumn("_w", F.lit(1.0))
    if not isinstance(weights, DataFrame):
        given = [float(w) for w in weights]
        stats = materialize(stats)  # counted here and ranked below
        strata = stats.count()
        if len(given) != strata:
            if on_mismatch == "ignore":
                return stats.withColumn("_w", F.lit(1.0))
            raise ValueError(f"{len(given)} weights for {strata} strata")
        ranked = global_rank(stats, [stratum(by), *map(F.col, by)], "_place", strata, small)
        listed = stats.sparkSession.createDataFrame(
            pa.table({"_place": pa.array(range(1, strata + 1), pa.int64()), "weight": given})
        )
        joined = ranked.join(listed, "_place", "left").drop("_place")
    else:
        keyed = weights.select(*by, F.col("weight").cast("double").alias("weight"))
        joined = stats.join(keyed, by, "left")
    w = F.when(F.col("weight") < 0, 1.0).otherwise(F.coalesce("weight", F.lit(1.0)))
    return joined.withColumn("_w", w).drop("weight")


def _with_gamma(
    stats: DataFrame,
    by: list[str],
    weights: DataFrame | Sequence[float] | None,
    cv: str,
    on_mismatch: str,
    small: int,
) -> DataFrame:
    if cv not in ("signed", "abs"):
        raise ValueError(f"cv must be 'signed' or 'abs', not {cv!r}")
    mean = F.abs("mean") if cv == "abs" else F.col("mean")
    gamma = F.sqrt("_w") * divide(F.col("std"), mean)
    held = stats.where(F.col("n") > 0).select(*by, "mean", "std", "n")
    weighted = _weighted(held, by, weights, on_mismatch, small)
    # The shares must come from one and the same set of values, so fix them here.
    return materialize(weighted.withColumn("gamma", gamma).drop("_w"))


def _totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct strata, rows of the table, rows of the strata, sum of gamma."""
    each = rows.groupBy(*by).agg(
        F.count("*").alias("_given"), F.sum("n").alias("_held"), F.sum("gamma").alias("_gamma")
    )
    return each.agg(
        F.count("*").alias("strata"),
        F.sum("_given").alias("given"),
        F.sum("_held").alias("rows"),
        F.sum("_gamma").alias("gamma"),
    )


def totals(
    stats: DataFrame,
    by: Iterable[str],
    weights: DataFrame | Sequence[float] | None = None,
    cv: str = "signed",
    on_mismatch: str = "error",
) -> DataFrame:
    """One row: number of strata, rows in them, sum of ``gamma``."""
    groups = group_columns(stats, by)
    rows = _with_gamma(stats, groups, weights, cv, on_mismatch, SMALL_RANK)
    return _totals(rows, groups).drop("given")


def shares(
    stats: DataFrame,
    by: Iterable[str],
    weights: DataFrame | Sequence[float] | None = None,
    cv: str = "signed",
    on_mismatch: str = "error",
) -> DataFrame:
    """Statistics with ``gamma`` (weighted coefficient of variation) and ``share``."""
    groups = group_columns(stats, by)
    rows = _with_gamma(stats, groups, weights, cv, on_mismatch, SMALL_RANK)
    total = _totals(rows, groups).first()["gamma"]
    return rows.withColumn("share", divide(F.col("gamma"), F.lit(total)))


def _full_rounds(room: DataFrame, need: int) -> tuple[int, int, int]:
    """(r, need - T(r), strata with h > r) for the column ``_room`` of ``room``, called h here.

    Every pass counts h in at most HISTOGRAM equal steps of the bracket and keeps
    the step that holds r, so the passes grow with log(need) / log(HISTOGRAM).
    """
    low, high = 0, need
    while True:
        # T(low) <= need; r lies in [low, high], since T(r) <= need allows r <= need
        # whenever a stratum has h > r.
        step = -(-(high - low) // HISTOGRAM) or 1
        edges = list(range(low, high, step)) + [high]
        slot = F.greatest(F.lit(0), F.ceil((F.col("_room") - low) / step).cast("bigint"))
        slot = F.when(F.col("_room") > high, len(edges)).otherwise(slot)
        counted = (
            room.groupBy(slot.alias("slot"))
            .agg(F.count("*").alias("strata"), F.sum("_room").alias("rows"))
            .collect()  # at most HISTOGRAM + 2 rows
        )
        strata = {x.slot: x.strata for x in counted}
        rows = {x.slot: x.rows for x in counted}
        above = sum(strata.values())
        done = 0
        moved, left = [], []
        for i, edge in enumerate(edges):
            # slot i holds edges[i-1] < h <= edges[i]
            above -= strata.get(i, 0)
            done += rows.get(i, 0)
            moved.append(done + edge * above)
            left.append(above)
        at = bisect_right(moved, need) - 1
        if step == 1 or at == len(edges) - 1:
            return edges[at], need - moved[at], left[at]
        low, high = edges[at], edges[at + 1]


def allocate(
    stats: DataFrame,
    by: Iterable[str],
    budget: int,
    weights: DataFrame | Sequence[float] | None = None,
    cv: str = "signed",
    on_mismatch: str = "error",
    small: int = SMALL_RANK,
) -> DataFrame:
    """Sample size ``si`` for every stratum; the sizes sum to ``budget``.

    ``stats`` has the group columns, ``mean``, ``std`` and ``n``, one row per
    stratum. ``weights`` is a table (group columns, ``weight``) or a list in
    stratum order; a list of another length is an error, or ignored with
    ``on_mismatch='ignore'``. ``cv='abs'`` uses the mean's absolute value; with
    ``'signed'`` a stratum with a negative mean has a negative share and gets one
    row. Where a share is NaN (a stratum with mean and deviation 0, or all
    deviations 0) the size starts at 0 and comes from the dealing rounds.

    Only totals and a histogram of fixed size reach the driver.
    """
    groups = group_columns(stats, by)
    rows = _with_gamma(stats, groups, weights, cv, on_mismatch, small)

    strata, given, held, gamma = _totals(rows, groups).first()
    if strata != (given or 0):
        raise ValueError(f"{given} statistics rows for {strata} strata")
    if budget > (held or 0):
        raise ValueError(f"the budget {budget} is larger than the {held or 0} rows there are")
    if strata > budget:
        raise ValueError(f"the budget {budget} is smaller than the number of strata {strata}")
    if strata == 0:
        return rows.select(*groups, "mean", "std", "n", F.lit(0).cast("bigint").alias("si"))

    asked = F.lit(float(budget)) * divide(F.col("gamma"), F.lit(gamma))
    sized = rows.withColumn("_asked", asked)
    wanted = F.when(~F.isnan("_asked") & (F.col("_asked") < 1), 1.0).otherwise(F.col("_asked"))
    sized = sized.withColumn("_wanted", wanted)
    whole = F.floor(F.least(F.col("_wanted"), F.col("n").cast("double"))).cast("bigint")
    sized = sized.withColumn("_base", F.when(F.isnan("_wanted"), 0).otherwise(whole))

    spare = budget - sized.agg(F.sum("_base")).first()[0]
    if spare == 0:
        return sized.select(*groups, "mean", "std", "n", F.col("_base").alias("si"))

    giving = spare > 0
    room = F.col("n") - F.col("_base") if giving else F.greatest(F.col("_base") - 1, F.lit(0))
    sized = sized.withColumn("_room", room).withColumn(
        "_rest", F.col("_wanted") - F.col("_base")
    )
    rounds, extra, open_strata = _full_rounds(sized, abs(spare))
    moved = F.least(F.col("_room"), F.lit(rounds))
    if extra:
        key = [stratum(groups), *map(F.col, groups)]
        order: list[Column] = [F.col("_rest"), *key]
        order = [c.desc() if giving else c.asc() for c in order]
        more = F.col("_room") > rounds
        ranked = global_rank(sized.where(more), order, "_place", open_strata, small)
        sized = ranked.unionByName(
            sized.where(~more).withColumn("_place", F.lit(extra + 1).cast("bigint"))
        )
        moved = moved + F.when(F.col("_place") <= extra, 1).otherwise(0)
    si = F.col("_base") + moved if giving else F.col("_base") - moved
    return sized.select(*groups, "mean", "std", "n", si.cast("bigint").alias("si"))
