"""Statistics, allocation, sample and report in one call."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from stratasift.functions.columns import resolve, resolve_all
from stratasift.operators.allocate import allocate
from stratasift.operators.clean import clean
from stratasift.operators.copies import number_copies
from stratasift.operators.report import nested_report, report_lines, sample_report
from stratasift.operators.sample import draw_sample
from stratasift.operators.stats import round_stats, stratum_stats
from stratasift.session import materialize


@dataclass(frozen=True)
class SampleRun:
    """What a run made; all members are DataFrames over stored rows."""

    by: list[str]
    value: str
    ids: list[str]
    stats: DataFrame
    allocation: DataFrame
    sample: DataFrame

    def report(self) -> DataFrame:
        return sample_report(self.sample, self.allocation, self.by, self.value)

    def nested(self) -> DataFrame:
        return nested_report(self.sample, self.allocation, self.by, self.value)

    def lines(self, digits: int | None = None) -> DataFrame:
        return report_lines(self.sample, self.report(), self.by, self.value, self.ids, digits)


def stratified_sample(
    df: DataFrame,
    by: Iterable[str | int],
    value: str | int,
    budget: int,
    ids: Iterable[str | int] | None = None,
    keep: Iterable[str | int] = (),
    weights: DataFrame | Sequence[float] | None = None,
    seed: int = 0,
    method: str = "rank",
    hasher: str = "xxhash64",
    cv: str = "signed",
    on_bad: str = "drop",
    on_mismatch: str = "error",
    digits: int | None = None,
    stats: DataFrame | None = None,
) -> SampleRun:
    """Sample ``budget`` rows of ``df``, more from strata that vary more.

    Without ``ids`` the rows are tuples of group columns, value and ``keep`` columns, and
    equal tuples are numbered. ``stats`` are statistics stored earlier; otherwise they are computed.
    ``digits`` rounds them before the allocation.
    """
    groups = resolve_all(df, by)
    number = resolve(df, value)
    if ids is None:
        kept = [c for c in (resolve(df, k) for k in keep) if c not in (*groups, number)]
        tuples = [*groups, number, *kept]
        rows = number_copies(clean(df, groups, number, keep=kept, on_bad=on_bad), tuples)
        keys = [*tuples, "copy_no"]
    else:
        keys = resolve_all(df, ids)
        rows = clean(df, groups, number, keep=[*keys, *keep], on_bad=on_bad)
    if stats is None:
        stats = stratum_stats(df, groups, number, on_bad=on_bad)
        if digits is not None:
            stats = round_stats(stats, digits)
    sizes = materialize(allocate(stats, groups, budget, weights, cv, on_mismatch))
    drawn = draw_sample(rows, sizes, groups, keys, seed, method, hasher)
    return SampleRun(groups, number, keys, sizes.drop("si"), sizes, drawn)
