"""Global ordinals at a size where planners split and join partitions as they like."""

import pytest
from pyspark.sql import functions as F

from inkstone.operators import batch
from inkstone.operators.ordinals import numbered

N = 1_000_000


@pytest.fixture
def small_partitions(spark, request):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before[0])
    spark.conf.set("spark.sql.shuffle.partitions", before[1])


def paths(spark, wide):
    k = F.col("id") * 7919 % N
    path = F.concat(F.lit("x" * wide), F.md5(k.cast("string")), F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".PDF").otherwise(".txt"))
    return spark.range(N).select(path.alias("path"), k.alias("ins"))


@pytest.mark.parametrize(("small_partitions", "wide"), [("256k", 0), ("4m", 60), ("64m", 0)], indirect=["small_partitions"])
def test_a_million_paths(spark, small_partitions, wide):
    files = paths(spark, wide)
    for ordered in (batch.add_order(files), batch.drop_order(files)):
        got = ordered.agg(F.count("*"), F.countDistinct("position"), F.min("position"), F.max("position"), F.countDistinct("path")).first()
        assert tuple(got) == (N, N, 1, N, N)
    pdf = F.lower(F.right("path", F.lit(4))) == ".pdf"
    last = batch.add_order(files).join(files, "path").agg(F.max(F.when(~pdf, F.col("position"))).alias("texts"), F.min(F.when(pdf, F.col("position"))).alias("pdf"), F.corr(F.when(pdf, F.col("position")), F.when(pdf, F.col("ins"))).alias("r")).first()
    assert last.texts + 1 == last.pdf and last.r > 0.9999  # PDF in the order they came


def test_small_tables(spark):
    schema = "v int, part int, row string, key0 int, before int, position string"
    df = spark.createDataFrame([(v, 1, "r", 2, 3, "old") for v in (5, None, 3, 3, 9)], schema)
    got = numbered(df, [F.col("v")]).collect()
    assert sorted((r.position, r.v) for r in got) == [(1, None), (2, 3), (3, 3), (4, 5), (5, 9)]
    assert set(got[0].asDict()) == set(df.columns) and got[0].row == "r"
    assert numbered(df.limit(0), [F.col("v")]).count() == 0
