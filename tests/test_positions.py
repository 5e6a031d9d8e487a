import pytest
from pyspark.sql import functions as F

from stratasift import draw_sample
from stratasift.operators.sample import P
from stratasift.functions.priority import priority
from stratasift.sources.csv import read_csv
from stratasift.sources.positions import FILE, POSITION, with_position
from stratasift.streaming.sample import read_sample, sample_writer

ROWS = 6000


@pytest.fixture(scope="module", params=["parquet", "csv"])
def equal_rows(request, spark, tmp_path_factory):
    """Files in which all rows of a stratum are equal."""
    path = str(tmp_path_factory.mktemp("equal") / request.param)
    rows = spark.range(0, ROWS, 1, 3).select((F.col("id") % 2).cast("string").alias("g"), F.lit("1").alias("v"))
    rows.write.format(request.param).save(path)
    if request.param == "csv":
        return path, lambda stream=False: read_csv(spark, path, ["g", "v"], header=False, stream=stream).select("g", "v")
    schema = "g string, v string"
    reader = lambda stream: spark.readStream if stream else spark.read
    return path, lambda stream=False: reader(stream).schema(schema).parquet(path)


def test_every_row_has_its_own_position(spark, equal_rows):
    df = with_position(equal_rows[1]())
    assert df.agg(F.count_distinct(*POSITION)).first()[0] == df.count() == ROWS
    plan = df.withColumn(P, priority(1, POSITION))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_equal_rows_are_drawn_one_by_one(spark, equal_rows):
    df = with_position(equal_rows[1]())
    sizes = spark.createDataFrame([("0", 1000, 3000), ("1", 50, 3000)], "g string, si long, n long")
    got = draw_sample(df, sizes, ["g"], POSITION, 2)
    assert sorted(got.groupBy("g").count().collect()) == [("0", 1000), ("1", 50)]
    assert got.select(*POSITION).distinct().count() == 1050


def test_equal_rows_of_a_file_have_equal_chances(spark, tmp_path):
    """Each of 12 equal rows is in about a quarter of 200 samples of 3."""
    path = str(tmp_path / "few")
    spark.range(12).select(F.lit("a").alias("g")).coalesce(1).write.parquet(path)
    seeds = F.explode(F.sequence(F.lit(0), F.lit(199))).alias("s")
    draws = with_position(spark.read.parquet(path)).select("*", seeds).select("s", "row_place", F.xxhash64("s", *POSITION).alias("p")).collect()
    hits = dict.fromkeys(range(12), 0)
    for s in range(200):
        for r in sorted((r for r in draws if r.s == s), key=lambda r: r.p)[:3]:
            hits[r.row_place] += 1
    assert sum(hits.values()) == 600 and 25 <= min(hits.values()) and max(hits.values()) <= 78


def test_parquet_positions_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 40_000, 1, 2).write.option("parquet.block.size", 20_000).parquet(path)
    usual = sorted(with_position(spark.read.parquet(path)).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cut = with_position(spark.read.parquet(path))
        assert cut.rdd.getNumPartitions() > 2
        assert sorted(cut.collect()) == usual
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream_of_equal_rows(spark, equal_rows, tmp_path):
    stream = with_position(equal_rows[1](stream=True))
    sizes = spark.createDataFrame([("0", 1000, 3000), ("1", 50, 3000)], "g string, si long, n long")
    ids, place = (POSITION, None) if "row_place" in stream.columns else ([FILE], "row_place")
    out = str(tmp_path / "out")
    sample_writer(stream, sizes, ["g"], ids, out, str(tmp_path / "state"), place=place).trigger(
        availableNow=True
    ).start().awaitTermination()
    got = read_sample(spark, out)
    assert sorted(got.groupBy("g").count().collect()) == [("0", 1000), ("1", 50)]
    assert got.select(*POSITION).distinct().count() == 1050


def test_names_must_be_free(spark):
    with pytest.raises(ValueError, match="row_file"):
        with_position(spark.range(1).withColumnRenamed("id", "row_file"))
