import pytest
from fixed import STRATA
from pyspark.sql import functions as F

from stratasift.operators.clean import clean, rejected
from stratasift.operators.stats import latest_stats
from stratasift.sources import lines, stats_table, topic
from stratasift.sources.csv import CORRUPT, parse_csv, read_csv, to_csv_line

# The columns of an air-quality file.
COLUMNS = [
    "location", "city", "country", "utc", "local", "parameter", "value", "unit",
    "latitude", "longitude", "attribution",
]


def line(country="CL", parameter="so2", value="6.0", unit="µg/m³", city="Santiago"):
    return f'P1,"{city}", {country} ,t,t,{parameter},{value},{unit},1,2,"[{{""name"":""x, y""}}]"'


CASES = {
    "plain": (line(), ("CL", "so2", "µg/m³", 6.0)),
    "exponent": (line(value="4e2"), ("CL", "so2", "µg/m³", 400.0)),
    "quoted comma": (line(city="a,b"), ("CL", "so2", "µg/m³", 6.0)),
    "doubled quote": (line(city='a""b'), ("CL", "so2", "µg/m³", 6.0)),
    "blanks around the value": (line(value="  7 "), ("CL", "so2", "µg/m³", 7.0)),
    "empty group": (line(parameter=""), None),
    "blank group": (line(parameter="  "), None),
    "quoted empty group": (line(parameter='""'), None),
    "empty value": (line(value=""), None),
    "not a number": (line(value="n/a"), None),
    "too few columns": ("P1,Santiago,CL", None),
    "empty line": ("", None),
}


@pytest.mark.parametrize("case", CASES)
def test_csv_values(spark, case):
    text, want = CASES[case]
    df = spark.createDataFrame([(text,)], "value string")
    got = clean(parse_csv(df, "value", COLUMNS), [3, 6, 8], 7).collect()
    assert [tuple(r) for r in got] == ([] if want is None else [want])


def test_csv_nan(spark):
    df = spark.createDataFrame([(line(value="NaN"),)], "value string")
    (row,) = clean(parse_csv(df, "value", COLUMNS), [3], 7).collect()
    assert row["value"] != row["value"]


def test_bad_lines_are_told_apart(spark):
    df = spark.createDataFrame([("P1,Santiago,CL",), (line(),), (line(value="n/a"),)], "value string")
    rows = parse_csv(df, 1, COLUMNS)
    assert [r[0] for r in rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT).collect()] == [
        "P1,Santiago,CL"
    ]
    assert [r["value"] for r in rejected(rows, [3], 7).collect()] == ["n/a"]


def test_csv_files(spark, tmp_path):
    header = ",".join(COLUMNS)
    for i in range(3):
        text = "\n".join([header, *[line(value=str(j)) for j in range(i + 1)]])
        (tmp_path / f"{i}.csv").write_text(text + "\n", encoding="utf-8")
    df = read_csv(spark, str(tmp_path), COLUMNS)
    assert df.count() == 6
    assert {(r.country, r[CORRUPT]) for r in df.collect()} == {("CL", None)}


def test_csv_lines_round_trip(spark):
    rows = [(1, 'a "b", c', "x"), (2, " lead\nbreak ", None), (3, "plain", "y")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    back = parse_csv(to_csv_line(df, ["a", "b"], "value"), "value", ["a", "b"])
    got = {r.id: (r.a, r.b) for r in back.collect()}
    assert got[1] == ('a "b", c', "x") and got[3] == ("plain", "y")
    assert got[2][0].strip() == "lead\nbreak" and got[2][1] is None


@pytest.mark.parametrize("header", [True, False])
def test_line_numbers(spark, tmp_path, header):
    want = []
    for name in ("a", "b", "c"):
        body = [f"{name}{i}" for i in range(700)] if name != "b" else []
        (tmp_path / f"{name}.csv").write_text("\n".join(["head", *body]) + "\n")
        want += body if header else ["head", *body]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        df = lines.read_lines(spark, str(tmp_path), header)
        assert df.rdd.getNumPartitions() > 3
        got = df.orderBy("key").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.key for r in got] == list(range(1, len(want) + 1))
    assert [r.value for r in got] == want


def test_records(spark):
    numbered = spark.createDataFrame([(i, f"v{i}") for i in range(1, 9)], "key bigint, value string")
    sent = topic.to_records(numbered, 4)
    rows = sent.orderBy("key").collect()
    assert [bytes(r.key) for r in rows] == [i.to_bytes(8, "big") for i in range(1, 9)]
    assert [r.partition for r in rows] == [1, 2, 3, 0, 1, 2, 3, 0]
    arrived = sent.select(
        "key", F.col("value").cast("binary").alias("value"), F.lit("t").alias("topic"),
        "partition", F.lit(0).cast("bigint").alias("offset"), F.lit(1).alias("timestampType"),
    )
    back = topic.from_records(arrived)
    assert back.columns == ["key", "value", "topic", "partition", "offset"]
    assert sorted((r.key, r.value) for r in back.collect()) == [(i, f"v{i}") for i in range(1, 9)]
    with pytest.raises(ValueError):
        topic.to_records(numbered, 0)


@pytest.mark.parametrize("number", [0, 1, -1, 2**63 - 1, -(2**63), 123456789])
def test_long_keys(spark, number):
    key = topic.long_key(F.lit(number))
    row = spark.range(1).select(key.alias("k"), topic.key_number(key).alias("n")).first()
    assert bytes(row.k) == number.to_bytes(8, "big", signed=True)
    assert row.n == number


def test_other_keys_have_no_number(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "k binary")
    assert [r[0] for r in df.select(topic.key_number(F.col("k"))).collect()] == [None, None]


def test_stats_records(spark):
    rows = [(*s[:4],) for s in STRATA] + [("x", float("nan"), float("nan"), 2)]
    stats = spark.createDataFrame(rows, topic.STATS_SCHEMA)
    back = topic.stats_from_records(topic.stats_to_records(stats))
    assert back.schema == stats.schema
    got = sorted(map(repr, map(tuple, back.collect())))
    assert got == sorted(map(repr, rows))


def test_stats_table(spark, tmp_path):
    path = str(tmp_path / "stats")
    stats = spark.createDataFrame([s[:4] for s in STRATA], topic.STATS_SCHEMA)
    stats_table.write_stats(stats, path)
    stats_table.write_stats(stats, path)
    assert stats_table.read_stats(spark, path).count() == 15
    versions = str(tmp_path / "versions")
    stats_table.write_stats(stats, versions, version=1)
    stats_table.write_stats(stats.withColumn("n", F.col("n") * 2), versions, version=2)
    newest = latest_stats(stats_table.read_stats(spark, versions), ["stratum"], "version")
    assert newest.agg(F.sum("n")).first()[0] == 872


def test_lines_are_numbered_when_the_splits_change(spark, tmp_path):
    from stratasift.sources.lines import read_lines

    path = str(tmp_path / "lines")
    spark.range(20_000).select(F.col("id").cast("string")).repartition(3).write.text(path)
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        lines = read_lines(spark, path, header=False)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        got = lines.agg(F.count("*"), F.countDistinct("key"), F.min("key"), F.max("key")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert tuple(got) == (20_000, 20_000, 1, 20_000)


def test_files_go_by_the_numbers_in_their_names(spark, tmp_path):
    from stratasift.sources.lines import read_lines

    for n in (9, 10, 100):
        (tmp_path / f"part-{n}.txt").write_text(f"h\n{n}\n")
    got = read_lines(spark, str(tmp_path)).orderBy("key").collect()
    assert [r["value"] for r in got] == ["9", "10", "100"]


def test_of_several_records_the_first_counts(spark):
    from stratasift.sources.csv import parse_csv

    rows = [("a,b\nc,d",), ('"x\ny",z\r\nq',), ("one",), (None,), ('a"b,c',), ("w," + "v" * 200_000,)]
    got = parse_csv(spark.createDataFrame(rows, "value string"), "value", ["x", "y"]).collect()
    assert [(r["x"], r["y"] and r["y"][:3]) for r in got] == [
        ("a", "b"), ("x\ny", "z"), ("one", None), (None, None), ('a"b', "c"), ("w", "vvv")
    ]
