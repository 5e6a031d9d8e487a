import statistics

import pytest
from fixed import RECORDS, STRATA
from pyspark.errors import PySparkException

from stratasift import (
    clean,
    latest_stats,
    merge_stats,
    project,
    rejected,
    round_stats,
    sort_stats,
    stratum_stats,
)

BY = ["country", "parameter", "unit"]


def records(spark):
    rows = [(*key, v) for key, values in RECORDS.items() for v in values]
    return spark.createDataFrame(rows, "country string, parameter string, unit string, value double")


def test_published_records(spark):
    got = {tuple(r[:3]): r for r in stratum_stats(records(spark), BY, "value").collect()}
    known = {tuple(s[0].split(",")): s for s in STRATA}
    assert set(got) == set(RECORDS)
    for key, row in got.items():
        assert row.n == known[key][3]
        assert row["mean"] == pytest.approx(known[key][1], rel=1e-12)
        assert row["std"] == pytest.approx(known[key][2], rel=1e-12)


def test_against_statistics_module(spark, tables):
    orders = tables("orders")
    got = stratum_stats(orders, ["o_orderpriority"], "o_totalprice").collect()
    values = {}
    for row in orders.select("o_orderpriority", "o_totalprice").collect():
        values.setdefault(row[0], []).append(row[1])
    assert {r[0] for r in got} == set(values)
    for r in got:
        assert r.n == len(values[r[0]])
        assert r["mean"] == pytest.approx(statistics.fmean(values[r[0]]))
        assert r["std"] == pytest.approx(statistics.pstdev(values[r[0]]))


def test_ordinals_and_incomplete_rows(spark):
    rows = [
        ("x", "a", "1.5"),
        ("x", "a", "4e2"),
        ("x", "", "1"),
        ("x", None, "1"),
        ("x", "a", ""),
        ("x", "a", None),
        ("x", "a", "ten"),
        ("x", "b", " 2 "),
    ]
    df = spark.createDataFrame(rows, "p string, g string, v string")
    assert project(df, [3, 1]).columns == ["v", "p"]
    got = {r.g: (r.n, r["mean"]) for r in stratum_stats(df, [2], 3).collect()}
    assert got == {"a": (2, 200.75), "b": (1, 2.0)}
    assert [tuple(r) for r in rejected(df, ["g"], "v").collect()] == [("x", "a", "ten")]
    with pytest.raises(PySparkException, match="v is not a number: ten"):
        stratum_stats(df, ["g"], "v", on_bad="fail").collect()
    with pytest.raises(ValueError):
        project(df, [4])
    with pytest.raises(ValueError):
        project(df, [0])


def test_nan_is_a_value(spark):
    df = spark.createDataFrame([("a", "NaN"), ("a", "1"), ("b", "2")], "g string, v string")
    got = {r.g: r for r in stratum_stats(df, ["g"], "v").collect()}
    assert got["a"].n == 2 and got["a"]["mean"] != got["a"]["mean"]


def test_composite_keys_stay_apart(spark):
    df = spark.createDataFrame([("a,b", "c", 1.0), ("a", "b,c", 3.0)], "g string, h string, v double")
    assert stratum_stats(df, ["g", "h"], "v").count() == 2


def test_value_as_group_is_refused(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    with pytest.raises(ValueError, match="v"):
        clean(df, ["g", "v"], "v")


def test_sorted_by_stratum_text(spark):
    rows = [(10, "z"), (9, "a"), (10, "a")]
    df = spark.createDataFrame(rows, "g int, h string").selectExpr("g", "h", "1.0D as v")
    got = [(r.g, r.h) for r in sort_stats(stratum_stats(df, ["g", "h"], "v"), ["g", "h"]).collect()]
    assert got == [(10, "a"), (10, "z"), (9, "a")]


def test_merge_equals_whole(spark, tables):
    lines = tables("lineitem")
    fine = stratum_stats(lines, ["l_returnflag", "l_linestatus", "l_suppkey"], "l_extendedprice")
    by = ["l_returnflag", "l_linestatus"]
    merged = round_stats(merge_stats(fine, by), 6)
    whole = round_stats(stratum_stats(lines, by, "l_extendedprice"), 6)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_merge_keeps_digits_and_skips_empty_parts(spark):
    base = 1e9
    parts = [("a", base + 1, 1.0, 2), ("a", base + 3, 1.0, 2), ("a", 0.0, 0.0, 0)]
    df = spark.createDataFrame(parts, "g string, mean double, std double, n bigint")
    row = merge_stats(df, ["g"]).first()
    assert (row.n, row["mean"]) == (4, base + 2)
    assert row["std"] == pytest.approx(2**0.5, rel=1e-9)


def test_latest(spark):
    rows = [("a", 1.0, 0.5, 3, 1), ("a", 2.0, 0.25, 4, 2), ("b", 9.0, 0.0, 1, 1)]
    df = spark.createDataFrame(rows, "g string, mean double, std double, n bigint, version bigint")
    got = sorted(map(tuple, latest_stats(df, ["g"], "version").collect()))
    assert got == [("a", 2.0, 0.25, 4, 2), ("b", 9.0, 0.0, 1, 1)]


def test_scan_reads_two_columns_and_filters(spark, tables):
    plan = stratum_stats(tables("orders"), ["o_orderpriority"], "o_totalprice")
    text = plan._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in text
    assert "IsNotNull(o_orderpriority)" in text
