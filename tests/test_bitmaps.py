"""Bitmap vocabularies against plain sets, and against the vocabularies of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import bitmaps as B
from clickloom.operators import vocabulary as V

BELOW = 2**29
EDGES = [0, 1, 63, 64, 32767, 32768, 32769, BELOW - 32769, BELOW - 32768, BELOW - 1]


def table(spark):
    draw = np.random.default_rng(3).integers(0, BELOW, 300).tolist()
    a = [*EDGES, *EDGES, *draw, None, *range(40000, 40100)]
    b = [5] * (len(a) - 2) + [None, 7]
    return spark.createDataFrame([(i, x, y, "t") for i, (x, y) in enumerate(zip(a, b))], "k long, a long, b int, s string").repartition(3)


def test_sorted_vocabulary(spark, monkeypatch):
    from clickloom.operators import bitmaps

    df = table(spark)
    wanted = sorted(tuple(r) for r in V.fit_vocabulary(df, ["a"], "sorted").select("feature", "value", "idx").collect())
    wanted += [("b", 5, 0), ("b", 7, 1)]
    for rows in (bitmaps.COUNTED_ROWS, 7):
        monkeypatch.setattr(bitmaps, "COUNTED_ROWS", rows)
        ranked = B.rank_bitmaps(B.value_bitmaps(df, ["a", "b"], BELOW))
        assert sorted(map(tuple, B.vocabulary_of(ranked).collect())) == wanted
    assert {r["feature"]: r["cardinality"] for r in B.cardinality(ranked).collect()} == {"a": len(wanted) - 2, "b": 2}


def test_parts_merge(spark):
    df = table(spark)
    whole = B.value_bitmaps(df, ["a", "b"], BELOW)
    parts = [B.value_bitmaps(df.where(F.col("k") % 3 == k), ["a", "b"], BELOW) for k in range(3)]
    assert sorted(map(tuple, B.merge_bitmaps(*parts).collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("limit", [2**40, 0])
@pytest.mark.parametrize("oov", [None, -1])
def test_apply(spark, monkeypatch, limit, oov):
    """From the broadcast bitmaps and, beyond the limit, as rows."""
    monkeypatch.setattr(B, "BROADCAST_BYTES", limit)
    df = table(spark)
    known = df.where("k % 2 = 0")
    out = B.apply_bitmaps(df, ["a", "b"], B.rank_bitmaps(B.value_bitmaps(known, ["a", "b"], BELOW)), oov, "k")
    wanted = V.apply_vocabulary(
        df, ["a", "b"], V.fit_vocabulary(known, ["a", "b"], "sorted"), "null" if oov is None else "oov", oov or 0
    )
    assert sorted(out.collect(), key=repr) == sorted(wanted.collect(), key=repr)
    assert out.dtypes == wanted.dtypes
    if limit:
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)[0]


def test_nothing_known(spark):
    df = table(spark)
    ranked = B.rank_bitmaps(B.value_bitmaps(df.where("false"), ["a"], BELOW))
    assert B.apply_bitmaps(df, ["a"], ranked).where("a IS NOT NULL").count() == 0
    assert B.vocabulary_of(ranked).count() == 0


def test_values_out_of_range(spark):
    for bad in (-1, 100):
        df = spark.createDataFrame([(bad,), (3,)], "a long")
        with pytest.raises(Exception, match="outside 0 to 99"):
            B.value_bitmaps(df, ["a"], 100).collect()


def test_ranks_hold_only_their_buckets():
    """A column with two far values takes two buckets, not all below the larger one."""
    bits = np.zeros((2, B.BITS // 8), np.uint8)
    bits[0, 0], bits[1, 0] = 1, 5  # unordered: the far bucket first
    ranks = B.Ranks(np.array([BELOW // B.BITS, 1]), bits)
    assert ranks.words.nbytes + ranks.before.nbytes + ranks.place.nbytes < 100_000
    ids, known = ranks.lookup(np.array([0, 1, 2, 40000, BELOW - B.BITS, BELOW, -1]))
    assert known.tolist() == [True, False, True, False, True, False, False]
    assert ids[known].tolist() == [0, 1, 2]
