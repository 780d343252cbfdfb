"""Permutations by formula, shuffles that use them, and counts from footers."""

import pytest
from pyspark.sql import functions as F

from clickloom.functions.permute import permute
from clickloom.operators import splits, stats

SIZES = [*range(1, 40), 97, 100, 101, 256, 257, 999, 1000, 4099]


def test_every_place_is_taken_once(spark):
    rows = [(n, i) for n in SIZES for i in range(n)]
    df = spark.createDataFrame(rows, "n long, i long").select("n", permute(F.col("i"), F.col("n"), 7).alias("p"))
    found = df.groupBy("n").agg(F.count_distinct("p").alias("d"), F.min("p").alias("low"), F.max("p").alias("high"))
    assert sorted(map(tuple, found.collect())) == [(n, n, 0, n - 1) for n in SIZES]


def test_places_are_spread(spark):
    """Neighbours part, few places stay, and another seed gives another order."""
    n = 20_000
    both = spark.range(n).select(
        "id", permute(F.col("id"), F.lit(n), 1).alias("a"), permute(F.col("id"), F.lit(n), 2).alias("b")
    ).orderBy("id").collect()
    a = [r["a"] for r in both]
    assert sum(r["a"] == r["id"] for r in both) < 12 and sum(r["a"] == r["b"] for r in both) < 12
    near = sum(abs(x - y) < n // 100 for x, y in zip(a, a[1:])) / n
    assert near < 0.04
    halves = [sum(x < n // 2 for x in a[i : i + 1000]) for i in range(0, n, 1000)]
    assert all(400 < h < 600 for h in halves)


def files(spark, tmp_path, rows):
    path = str(tmp_path / "f")
    spark.range(0, rows, 1, 3).withColumnRenamed("id", "k").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("last", [None, 0, 2, 4])
@pytest.mark.parametrize("rows", [101, 3])
def test_shuffled_files(spark, tmp_path, across, last, rows):
    out = splits.shuffle_files(files(spark, tmp_path, rows), 5, 3, across, last)
    found = sorted(tuple(r) for r in out.select("k", "split", "bucket", "slot").collect())
    starts = [*splits.block_starts(rows, 5), rows]
    sizes = [b - a for a, b in zip(starts, starts[1:])]
    assert [f[1] for f in found] == [b for b, n in enumerate(sizes) for _ in range(n)]
    assert sorted((b, s) for _, _, b, s in found) == [(b, s) for b, n in enumerate(sizes) for s in range(n)]
    for k, split, bucket, slot in found:
        if split == last:
            assert (bucket, slot) == (last, k - starts[last])
        assert across or bucket == split
    if rows > 100:
        assert any(split != bucket for _, split, bucket, _ in found) == across


def test_no_row_is_moved(spark, tmp_path):
    df = files(spark, tmp_path, 101)
    plan = splits.shuffle_files(df, 5, across=True, last=4)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_counts_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("day"))
    rows.write.partitionBy("day").parquet(path)
    assert stats.footer_counts(spark, path).first()["n"] == 100
    assert sorted(map(tuple, stats.footer_counts(spark, path, ["day"]).collect())) == [(0, 34), (1, 33), (2, 33)]
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    text = stats.footer_plan(spark, path, ["day"])
    assert "PushedAggregation: [COUNT(*)]" in text and "ReadSchema: struct<>" not in text
