"""Variance-aware stratified sampling on Spark DataFrames."""

from stratasift.operators.allocate import allocate, shares, totals
from stratasift.operators.clean import clean, project, rejected
from stratasift.operators.copies import number_copies
from stratasift.operators.report import nested_report, report_lines, sample_report, sample_stats
from stratasift.operators.sample import draw_sample
from stratasift.operators.stats import (
    latest_stats,
    merge_stats,
    round_stats,
    sort_stats,
    stratum_stats,
)
from stratasift.plans.whole_run import SampleRun, stratified_sample

__all__ = [
    "SampleRun",
    "allocate",
    "clean",
    "draw_sample",
    "latest_stats",
    "merge_stats",
    "nested_report",
    "number_copies",
    "project",
    "rejected",
    "report_lines",
    "round_stats",
    "sample_report",
    "sample_stats",
    "shares",
    "sort_stats",
    "stratified_sample",
    "stratum_stats",
    "totals",
]
