import random

import pytest
from pyspark.sql import functions as F

from stratasift.__main__ import main
from stratasift.sources.stats_table import read_stats

HEADER = "location,city,country,utc,local,parameter,value,unit,latitude,longitude,attribution"


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    rng = random.Random(1)
    lines = [HEADER]
    for i in range(436):
        country, kind = rng.choice(["CL", "IN", "LV"]), rng.choice(["co", "no2", "so2"])
        value = round(rng.lognormvariate(2, 1), 2)
        lines.append(f'L{i},"x, y",{country},t,t,{kind},{value},µg/m³,1,2,"[{{""n"":1}}]"')
    path = tmp_path_factory.mktemp("air") / "day.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_feed(spark, csv, tmp_path):
    main(["feed", "--file", csv, "--out", str(tmp_path / "records")])
    records = spark.read.parquet(str(tmp_path / "records"))
    per_partition = {r.partition: r["count"] for r in records.groupBy("partition").count().collect()}
    assert per_partition == {0: 109, 1: 109, 2: 109, 3: 109}


def test_stats_then_sample(spark, csv, tmp_path, capsys):
    stats, report = str(tmp_path / "stats"), str(tmp_path / "report")
    main(["stats", "--file", csv, "--out", stats])
    table = read_stats(spark, stats)
    assert table.columns == ["c3", "c6", "c8", "mean", "std", "n"]
    assert table.agg(F.count("*"), F.sum("n")).first()[:] == (9, 436)
    nine = "1,1,1,1,2,1,1,-1,0"
    main(["sample", "--file", csv, "--stats", stats, "--weights", nine, "--out", report])
    lines = [r.value for r in spark.read.text(report).where("value != ''").collect()]
    assert len(lines) == 150 + 9
    assert "sample_mean" in capsys.readouterr().out


def test_stream_of_files(spark, csv, tmp_path):
    once, stream = str(tmp_path / "once"), str(tmp_path / "stream")
    main(["stats", "--file", csv, "--out", once])
    folder = csv.rpartition("/")[0]
    main(["stats", "--file", folder, "--out", stream, "--stream", "--timeout", "500"])
    tables = [read_stats(spark, p).select("c3", "c6", "n") for p in (once, stream)]
    assert tables[0].exceptAll(tables[1]).count() == 0 and tables[1].count() == 9


def test_sample_of_a_stream_goes_on_after_a_restart(spark, csv, tmp_path):
    stats, data = str(tmp_path / "stats"), tmp_path / "data"
    main(["stats", "--file", csv, "--out", stats])
    lines = open(csv, encoding="utf-8").read().splitlines()
    data.mkdir()
    common = ["--file", str(data), "--stats", stats, "--stream", "--checkpoint", str(tmp_path / "state")]
    for i, part in enumerate((lines[1:200], lines[200:])):
        (data / f"{i}.csv").write_text("\n".join([lines[0], *part]) + "\n", encoding="utf-8")
        main(["sample", *common, "--timeout", "500", "--budget", "90", "--out", str(tmp_path / f"out{i}")])
    whole = spark.read.text(str(tmp_path / "out1")).where("value != ''").count()
    assert whole == 90 + 9
    assert spark.read.text(str(tmp_path / "out0")).where("value != ''").count() <= whole


def test_input_is_needed(spark, csv, tmp_path):
    with pytest.raises(SystemExit):
        main(["sample", "--file", csv])
    with pytest.raises(SystemExit):
        main(["stats", "--out", str(tmp_path / "x")])
