"""Dealing rows to tasks."""

from clickloom import session


def test_spread_by_rows(spark, tmp_path):
    spark.range(0, 1000, 1, 1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(df, 10).rdd.getNumPartitions() == 100
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
