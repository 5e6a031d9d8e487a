import math
import random
from decimal import Decimal

import pytest
from fixed import RECORDS

from stratasift import (
    nested_report,
    report_lines,
    sample_report,
    sample_stats,
    stratified_sample,
)
from stratasift.sources.text import write_lines

BY = ["country", "parameter", "unit"]


@pytest.fixture(scope="module")
def run(spark):
    rows = [(*key, v) for key, values in RECORDS.items() for v in values]
    df = spark.createDataFrame(rows, "country string, parameter string, unit string, value double")
    return stratified_sample(df, BY, "value", 9)


def test_samples_taken_whole(run):
    got = {tuple(r[:3]): r for r in run.report().collect()}
    for key, values in RECORDS.items():
        row = got[key]
        assert row.n == row.si == row.sample_n == len(values)
        assert row.sample_mean == pytest.approx(row["mean"])
        assert row.sample_std == pytest.approx(row["std"])
    assert got[("CO", "pm25", "µg/m³")].sample_std == 0.0


def test_nested(run):
    got = {tuple(r[:3]): [v.value for v in r["sample"]] for r in run.nested().collect()}
    assert got == {k: sorted(v) for k, v in RECORDS.items()}
    chunks = nested_report(run.sample, run.allocation, BY, "value", chunk_rows=2).collect()
    parts = {}
    for r in sorted(chunks, key=lambda r: r["chunk"]):
        assert 1 <= len(r["sample"]) <= 2
        parts.setdefault(tuple(r[:3]), []).extend(v.value for v in r["sample"])
    assert parts == {k: sorted(v) for k, v in RECORDS.items()}


def test_stratum_without_sample_is_absent(spark, run):
    one = run.sample.where("country = 'CO'")
    assert sample_report(one, run.allocation, BY, "value").count() == 1
    assert sample_stats(one, BY, "value").first().sample_n == 1


def test_text_layout(spark, run, tmp_path):
    lines = [r.line for r in report_lines(run.sample, run.report(), BY, "value", ["value"]).collect()]
    assert lines[lines.index("CO, pm25, µg/m³, 27.0") - 1] == (
        "CO,pm25,µg/m³, 27.0, 0.0, 1, 1, 1, 27.0, 0.0, "
    )
    assert lines[0].startswith("CL,pm25,µg/m³, 9.37") and lines[0].endswith(", ")
    assert lines[1:5] == [
        "CL, pm25, µg/m³, 2.62", "CL, pm25, µg/m³, 4.07", "CL, pm25, µg/m³, 21.42", "",
    ]
    write_lines(run.lines(2), str(tmp_path / "report"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert "CL,pm25,µg/m³, 9.37, 8.54, 3, 3, 3, 9.37, 8.54, \n" in text
    assert len(text.splitlines()) == 3 + 9 + 3


def test_columns_named_like_ours(spark):
    rows = [(f"s{i % 2}", i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "stratum string, part int, line double")
    run = stratified_sample(df, ["stratum", "part"], "line", 12)
    lines = run.lines().collect()
    assert len(lines) == 12 + 6 * 2
    assert sum(r.part == 1 for r in lines) == 12
    with pytest.raises(ValueError, match="rename the group columns"):
        stratified_sample(df.withColumnRenamed("part", "n"), ["n"], "line", 12)
    with pytest.raises(ValueError, match="rename the columns"):
        named = df.withColumnRenamed("part", "_n")
        stratified_sample(named, ["stratum"], "line", 12, ids=["line"], keep=["_n"])


def test_mean_of_amounts_in_any_order(spark):
    """Cents in several orders and partitions give one mean, which rounds as the exact one does."""
    rng = random.Random(3)
    amounts = [Decimal(rng.randrange(10**8)) / 100 for _ in range(32)]
    amounts[0] += Decimal(1 + 2 * 8) / 100 - sum(amounts) * 100 % 32 / 100  # the mean is a tie at 6 digits
    exact = sum(amounts) / 32
    assert str(exact).endswith("5") and -exact.as_tuple().exponent == 7
    for order in range(6):
        rng.shuffle(amounts)
        rows = spark.createDataFrame([("a", float(x)) for x in amounts], "g string, v double").repartition(order + 1)
        got = sample_stats(rows, ["g"], "v").first().sample_mean
        assert Decimal(repr(got)) == exact
    odd = spark.createDataFrame([("n", float("nan")), ("i", float("inf")), ("z", None), ("z", 2.0), ("e", None)], "g string, v double")
    means = {r.g: r.sample_mean for r in sample_stats(odd, ["g"], "v").collect()}
    assert math.isnan(means["n"]) and means["i"] == math.inf and means["z"] == 2.0 and means["e"] is None
