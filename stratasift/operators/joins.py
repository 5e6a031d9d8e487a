"""Joining rows with a table that has one row per stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasift.functions.priority import SPAN

BROADCAST_BYTES = 64 << 20
ROW_OVERHEAD = 64
HOT_STRATA = 1000
SALT_ROWS = 1_000_000
LIMIT_SLOTS = 1 << 20

_SALT = "_salt"


def table_bytes(table: DataFrame, by: list[str]) -> Column:
    """Aggregate: an upper estimate of a per-stratum table's size in memory."""
    width = F.lit(ROW_OVERHEAD + 16 * len(table.columns))
    for c in by:
        width = width + F.octet_length(F.col(c).cast("string"))
    return F.coalesce(F.sum(width), F.lit(0))


def _cut_by_slot(
    rows: DataFrame, table: DataFrame, by: list[str], spread: str, limit: str, slots: int
) -> DataFrame:
    """Drop rows at or above the largest limit of all strata in their hash slot.

    A stratum's own limit is never above its slot's, so no wanted row is lost, and
    the broadcast has at most ``slots`` rows of two numbers however many strata
    there are.
    """
    slot = F.pmod(F.xxhash64(*by), F.lit(slots)).cast("int")
    limits = table.groupBy(slot.alias("_slot")).agg(F.max(limit).alias("_slot_limit"))
    return (
        rows.withColumn("_slot", slot)
        .join(F.broadcast(limits), "_slot")
        .where(F.col(spread) < F.col("_slot_limit"))
        .drop("_slot", "_slot_limit")
    )


def attach(
    rows: DataFrame,
    table: DataFrame,
    by: list[str],
    spread: str,
    limit: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    size: int | None = None,
    slots: int = LIMIT_SLOTS,
) -> DataFrame:
    """Inner join of ``rows`` with the per-stratum ``table`` on the group columns.

    ``table`` needs a column ``_n``, the rows its stratum holds, and must be cheap
    to read again. ``spread`` is a uniform integer column of ``rows``; when
    ``limit`` names a column of ``table``, only rows with ``spread < limit`` are kept.
    Both are priorities in [0, SPAN).

    Up to ``broadcast_bytes`` (``size`` tells the table's, else it is measured) the
    table is broadcast and the rows do not move. Beyond, rows are cut by the limits of hash slots (where that drops most
    of them), then shuffled on stratum and salt. Only strata holding more than
    1/HOT_STRATA of all rows get several salts; as there are fewer than HOT_STRATA
    of those, their salt counts are broadcast. A salt stands for SALT_ROWS rows at most.
    """
    below = F.col(spread) < F.col(limit) if limit else F.lit(True)
    if size is None:
        size = table.agg(table_bytes(table, by)).first()[0]
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(table), by).where(below)

    share_kept = F.col(limit) / SPAN if limit else F.lit(1.0)
    total, kept = table.agg(F.sum("_n"), F.sum(F.col("_n") * share_kept)).first()
    total = total or 0
    same_types = all(rows.schema[c].dataType == table.schema[c].dataType for c in by)
    if limit and same_types and kept is not None and kept < total / 2:
        rows = _cut_by_slot(rows, table, by, spread, limit, slots)
    share = max(total // HOT_STRATA, 1)
    salts = F.ceil(F.col("_n") / min(share, SALT_ROWS)).cast("int")
    is_hot = F.col("_n") > share
    hot = table.where(is_hot).select(*by, salts.alias("_salts"))
    salt = F.pmod(F.col(spread), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), by, "left").withColumn(_SALT, salt).drop("_salts")
    last = F.when(is_hot, salts - 1).otherwise(0)
    copies = table.withColumn(_SALT, F.explode(F.sequence(F.lit(0), last)))
    return salted.join(copies.hint("merge"), [*by, _SALT]).drop(_SALT).where(below)
