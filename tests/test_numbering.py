"""Row numbers, positions, blocks and shuffles against plain Python."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickloom.operators import numbering, splits, stats


def skewed(spark, rows=3000):
    """A third of the rows in one group; the others in many small ones."""
    rng = random.Random(5)
    data = [(i, 0 if i % 3 == 0 else rng.randrange(1, 200)) for i in range(rows)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "id bigint, g int").repartition(8)


def test_ranged_equals_plain(spark):
    data, df = skewed(spark)
    order = [F.col("id").desc()]
    ranged = numbering.number_rows(df, order, within=["g"], start=2)
    plain = numbering.number_rows(df, order, within=["g"], start=2, rows=len(data))
    assert sorted(ranged.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("scale", [1, 2**50, -(2**50)])
def test_lead_does_not_change_the_numbers(spark, scale):
    data, df = skewed(spark)
    df = df.withColumn("id", F.col("id") * scale)
    lead = numbering.lead_of(F.col("g"), 200, F.col("id"))
    led = numbering.number_rows(df, [F.col("id")], within=["g"], lead=lead)
    plain = numbering.number_rows(df, [F.col("id")], within=["g"], rows=len(data))
    assert sorted(led.collect()) == sorted(plain.collect())


def test_ranged_is_consecutive(spark):
    data, df = skewed(spark)
    out = numbering.number_rows(df, [F.col("id")]).collect()
    assert sorted((r["id"], r["pos"]) for r in out) == [(i, i) for i in range(len(data))]


def test_one_group_spans_tasks(spark):
    data, df = skewed(spark)
    out = numbering.number_rows(df, [F.col("id")], within=["g"])
    ids = sorted(i for i, g in data if g == 0)
    found = sorted((r["id"], r["pos"]) for r in out.where("g = 0").collect())
    assert found == [(i, n) for n, i in enumerate(ids)]


def test_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "id bigint, g int")
    out = numbering.number_rows(df, [F.col("id")], within=["g"]).collect()
    assert sorted((r["id"], r["pos"]) for r in out) == [(1, 0), (2, 1), (3, 0)]


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint")
    assert numbering.number_rows(df, [F.col("id")]).count() == 0


def test_positions_in_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    out = numbering.positions_in_files(spark.read.parquet(path)).collect()
    assert sorted((r["id"], r["pos"]) for r in out) == [(i, i) for i in range(1000)]


@given(st.integers(0, 300), st.integers(1, 40))
def test_block_starts(rows, blocks):
    starts = [*splits.block_starts(rows, blocks), rows]
    sizes = [b - a for a, b in zip(starts, starts[1:])]
    assert sum(sizes) == rows and sizes == sorted(sizes, reverse=True)
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("rows,blocks,sizes", [(10, 4, [3, 3, 2, 2]), (3, 5, [1, 1, 1]), (64, 16, [4] * 16)])
def test_split_contiguous(spark, rows, blocks, sizes):
    out = splits.split_contiguous(spark.range(rows), "id", blocks).orderBy("id").collect()
    found = [r["split"] for r in out]
    assert found == sorted(found)
    assert [found.count(b) for b in sorted(set(found))] == sizes


def test_train_val_test(spark):
    df = spark.range(25).withColumn("split", F.when(F.col("id") < 18, 0).otherwise(1))
    roles = {r["id"]: r["role"] for r in splits.train_val_test(df, "split", "id", 1).collect()}
    assert [roles[i] for i in (0, 17, 18, 21, 22, 24)] == ["train", "train", "test", "test", "val", "val"]


@pytest.mark.parametrize("last", [None, 2])
def test_shuffle_into_splits(spark, last):
    sizes = {0: 50, 1: 7, 2: 30, 5: 13}
    rows = [(s,) for s, n in sizes.items() for _ in range(n)]
    rows = [(i, s) for i, (s,) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id bigint, split int").repartition(5)
    out = splits.shuffle_into_splits(df, "split", "id", last=last, seed=1).collect()
    assert sorted(r["id"] for r in out) == list(range(100))
    for s, n in sizes.items():
        bucket = [r for r in out if r["bucket"] == s]
        assert sorted(r["slot"] for r in bucket) == list(range(n))
    if last is not None:
        kept = sorted((r["slot"], r["id"]) for r in out if r["bucket"] == last)
        assert [i for _, i in kept] == [i for i, s in rows if s == last]
    assert any(r["bucket"] != r["split"] for r in out)


def test_shuffle_within_split_keeps_pinned(spark):
    df = spark.range(60).withColumn("split", (F.col("id") % 3).cast("int"))
    out = splits.shuffle_within_split(df, "split", "id", seed=2, pinned=1).collect()
    for s in range(3):
        order = [r["id"] for r in sorted((r for r in out if r["split"] == s), key=lambda r: r["slot"])]
        assert sorted(order) == list(range(s, 60, 3))
        assert (order == sorted(order)) == (s == 1)


def test_running_max(spark):
    words = ["of", "a", "the", "and", "", "seven", "six", "eleven", "twelve"]
    df = spark.createDataFrame(list(enumerate(words)), "idx bigint, word string")
    found = sorted((r["idx"], r["word"]) for r in stats.running_max_words(df).collect())
    assert found == [(0, "of"), (2, "the"), (5, "seven"), (7, "eleven")]


def test_check_split_sizes_passes_and_fails(spark):
    df = spark.range(10).withColumn("split", (F.col("id") % 2).cast("int"))
    assert stats.check_split_sizes(df, df, "split").count() == 0
    found = stats.check_split_sizes(df, df.where("id <> 4 and split = 0"), "split").collect()
    assert sorted(map(tuple, found)) == [(0, 5, 4), (1, 5, 0)]


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """A task's share of the counts and of the sort does not grow with the input."""
    from clickloom.operators import numbering
    from clickloom.operators import vocabulary as V

    monkeypatch.setattr(numbering, "RANGE_ROWS", 100)
    df = spark.range(3000).selectExpr("(id * 7) % 3000 AS k")
    out = numbering.number_rows(df, [F.col("k")], rows=3000, plain_rows=0)
    assert out.rdd.getNumPartitions() >= 1 and out.where("k <> pos").count() == 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        counts = V.value_counts(df.repartition(5), ["k"])
        assert "RepartitionByExpression" in counts._jdf.queryExecution().optimizedPlan().toString()
        assert counts.agg(F.sum("cnt"), F.count("*")).first()[:] == (3000, 3000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("block_rows", [1, 7, 100, 10**6])
def test_wide_rows_are_numbered_in_blocks(spark, block_rows):
    """The same numbers as by ranges, in groups of any size, one of them without a name."""
    rows = spark.range(-100, 400).selectExpr(
        "id * 37 % 1009 AS k", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 10 = 1 THEN -4 ELSE id % 3 END AS g", "id AS v"
    ).repartition(5)
    order = [F.col("k")]
    found = numbering.number_wide_rows(rows, order, "g", F.col("k"), rows.select("g", "k"), block_rows=block_rows)
    wanted = numbering.number_rows(rows, order, within=["g"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)
    assert numbering.number_wide_rows(rows.limit(0), order, "g", F.col("k"), rows.limit(0)).count() == 0
