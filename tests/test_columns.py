"""Edge rows of the column functions."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.plans import jobs
from clickloom.spec import FeatureSpec
from clickloom.functions import arrays as A
from clickloom.functions import dense as D
from clickloom.functions import sparse as S
from clickloom.functions.rows import row_to_tsv
from clickloom.plans.jobs import preprocess
from clickloom.spec import STANDARD, WIDE, FeatureSpec
from registry import base


def one(spark, expression, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(expression(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,expected", [("", "0"), ("\n", "0"), (None, "0"), ("7", "7"), (" ", " ")])
def test_fill_missing(spark, value, expected):
    assert one(spark, D.fill_missing, value) == expected


def test_neg_to_zero_keeps_null_and_nan(spark):
    assert one(spark, D.neg_to_zero, None, "double") is None
    assert math.isnan(one(spark, D.neg_to_zero, float("nan"), "double"))
    assert one(spark, D.neg_to_zero, -7.5, "double") == 0


@pytest.mark.parametrize("value,expected", [("-7", 0.0), ("0", 0.0), ("3", math.log(4)), ("3000000000", math.log(3000000001))])
def test_strict_log(spark, value, expected):
    assert one(spark, D.neg_to_zero_log, value) == pytest.approx(expected)


def test_strict_log_cuts_fractions_of_numbers(spark):
    assert one(spark, D.neg_to_zero_log, 3.7, "double") == pytest.approx(math.log(4))
    assert one(spark, D.neg_to_zero_log, -0.5, "double") == 0.0


@pytest.mark.parametrize("value", ["abc", "3.7", "", None])
def test_strict_log_fails(spark, value):
    with pytest.raises(Exception, match="dense value"):
        one(spark, D.neg_to_zero_log, value)


@pytest.mark.parametrize("value,expected", [("abc", 0.0), (None, 0.0), ("", 0.0), ("3.7", math.log(4.7)), ("-2", 0.0)])
def test_lenient_log(spark, value, expected):
    assert one(spark, D.neg_to_zero_log_lenient, value) == pytest.approx(expected)


@pytest.mark.parametrize("value,expected", [("FF", 255), ("ff", 255), ("ffffffff", 4294967295), ("0", 0), ("fffffffffffffff", 16**15 - 1)])
def test_hex_to_int(spark, value, expected):
    assert one(spark, S.hex_to_int, value) == expected


@pytest.mark.parametrize("value", ["zz", "1g", "g1", "", " 1", "-1", "0x1", "1.0", "1234567890abcdef1234g", None])
def test_bad_hex(spark, value):
    assert one(spark, lambda c: S.hex_mod_lenient(c, 8192), value) == 0
    with pytest.raises(Exception, match="not hexadecimal"):
        one(spark, S.hex_to_int, value)


LONG = ["0", "00000000000000ff", "ffffffffffffffff", "7fffffffffffffff", "0" * 40 + "1f", "123456789abcdef0123456789abcde", "f" * 61]


@pytest.mark.parametrize("value", LONG)
@pytest.mark.parametrize("m", [5, 8192, 2**29, 2**40])
def test_hex_of_any_length(spark, value, m):
    assert one(spark, lambda c: S.hex_mod(c, m), value) == int(value, 16) % m
    assert one(spark, lambda c: S.hex_mod_lenient(c, m), value) == int(value, 16) % m


@pytest.mark.parametrize("value", LONG)
def test_whole_hex(spark, value):
    wrapped = (int(value, 16) + 2**31) % 2**32 - 2**31
    assert one(spark, S.hex_wrap_int32, value) == wrapped
    if int(value, 16) < 2**63:
        assert one(spark, S.hex_to_int, value) == int(value, 16)
    else:
        with pytest.raises(Exception, match="too large"):
            one(spark, S.hex_to_int, value)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_without_ansi(spark, ansi):
    """Dense text and labels that cannot be read fail under both settings."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        spec = FeatureSpec.from_counts(1, 1)
        for row, what in ((("x", "1", "a"), "label"), (("1", "abc", "a"), "dense value"), (("1", "2", "g"), "hexadecimal")):
            df = spark.createDataFrame([row], "col_0 string, col_1 string, col_2 string")
            with pytest.raises(Exception, match=what):
                jobs.preprocess(df, spec, 8192).collect()
        df = spark.createDataFrame([(None, None, None)], "col_0 string, col_1 string, col_2 string")
        assert tuple(jobs.preprocess(df, spec, 8192).first()) == (None, 0.0, 0)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_integers_are_not_read_as_hex(spark):
    assert one(spark, lambda c: S.hex_mod(c, 8192, T.LongType()), 10000, "bigint") == 10000 % 8192


def test_modulus_is_never_negative(spark):
    assert one(spark, lambda c: S.modulus(c, 5), -7, "bigint") == -7 % 5


def test_hex_modulus_and_wrap(spark):
    assert one(spark, lambda c: S.hex_mod(c, 8192), "ffffffff") == 8191
    assert one(spark, S.hex_wrap_int32, "ffffffff") == -1
    assert one(spark, S.hex_wrap_int32, "7fffffff") == 2**31 - 1
    assert one(spark, S.hex_wrap_int32, "80000000") == -(2**31)


def test_int_mod_lenient(spark):
    assert one(spark, lambda c: S.int_mod_lenient(c, 100), "1234") == 34
    assert one(spark, lambda c: S.int_mod_lenient(c, 100), "ff") == 0


def test_hex_padding_and_printing(spark):
    assert one(spark, S.hex_zero_pad, "abc") == "00000abc"
    assert one(spark, S.int_to_hex, 3054198966, "bigint") == "B60B60B6"


def test_tsv_keeps_nulls_as_empty_fields(spark):
    df = spark.createDataFrame([("a", None, "", "d")], "w string, x string, y string, z string")
    assert df.select(row_to_tsv(df, df.columns)).first()[0] == "a\t\t\td"


def test_profiles():
    assert len(STANDARD.columns) == 40 and STANDARD.sparse[0] == "col_14"
    assert len(WIDE.columns) == 547 and WIDE.sparse[-1] == "col_546"
    assert FeatureSpec.dashed_names().sparse[-1] == "categorical-feature-39"


def test_preprocess_types(spark):
    spec = FeatureSpec.from_counts(1, 2)
    text = spark.createDataFrame([("1", "-3", "ff", ""), ("0", "", "FF", "10")], spec.struct())
    rows = [tuple(r) for r in preprocess(text, spec, 100).collect()]
    assert rows == [(1, 0.0, 55, 0), (0, 0.0, 55, 16)]
    numbers = spark.createDataFrame(
        [(1, 3.7, 255, None)],
        spec.struct(T.LongType(), T.FloatType(), T.LongType()),
    )
    label, dense, a, b = preprocess(numbers, spec, 100).first()
    assert (label, a, b) == (1, 55, 0) and dense == pytest.approx(math.log(4.7))


def test_preprocess_fails_on_bad_hex(spark):
    spec = FeatureSpec.from_counts(1, 1)
    df = spark.createDataFrame([("1", "1", "1g")], spec.struct())
    with pytest.raises(Exception, match="not hexadecimal"):
        preprocess(df, spec, 100).collect()


def test_wide_rows_are_made_once_a_cell(spark):
    """Rows beyond Spark's limit of compiled columns give what narrow ones give, each value made once."""
    spec = FeatureSpec.from_counts(90, 20)
    made = [F.when(F.col("id") % 7 == j % 7, "").otherwise((F.col("id") * j - 40).cast("string")).alias(c) for j, c in enumerate(spec.dense)]
    made += [F.when(F.col("id") % 5 == j % 5, None).otherwise(F.substring(F.md5(F.concat(F.lit(j), "id")), 1, 8)).alias(c) for j, c in enumerate(spec.sparse)]
    log = spark.range(20).select("id", F.lit("1").alias(spec.label), *made)
    wide = jobs.preprocess(log, spec, 64, ["id"])
    for dense, sparse in ((spec.dense[:45], ()), (spec.dense[45:], spec.sparse)):
        part = jobs.preprocess(log, FeatureSpec(spec.label, dense, sparse), 64, ["id"])
        assert wide.select(part.columns).schema == part.schema
        assert sorted(map(tuple, wide.select(part.columns).collect())) == sorted(map(tuple, part.collect()))
    assert wide.columns == ["id", *spec.columns]
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= len(spec.sparse)
    with pytest.raises(Exception, match="cannot be read"):
        jobs.preprocess(log.withColumn(spec.dense[3], F.lit("x")), spec, 64, ["id"]).collect()


def test_array_functions_give_the_same_bits(spark):
    """Functions of Arrow arrays against those of columns, on odd text and on numbers of every size."""
    texts = ["", "\n", None, "0", "1", "-1", "+1", " 1 ", "1.", "1.5e3", ".5", "-.5", "1d", "1F", "NaN", "nan", "-NaN", "inf", "-INF",
             "Infinity", "0x1p3", "0x1.8P-2d", "1e999", "1e-999", "007", "\x0b7", "4.9e-324", "1e39", "0.1", "9007199254740993"]
    df = spark.createDataFrame([(t,) for t in texts], "c string").coalesce(1)
    filled = A.fill_missing(pa.array(texts))
    assert filled.to_pylist() == [r[0] for r in df.select(D.fill_missing("c")).collect()]
    value = D.dense_double(D.fill_missing("c"))
    wanted = df.select(value.alias("v"), D.fill_missing("c").cast("float").alias("f")).toPandas()
    np.testing.assert_array_equal(A.dense_double(filled), wanted["v"])
    np.testing.assert_array_equal(A.to_float(filled), wanted["f"])
    for bad in ("x", "nan(1)", "-nan", "0x10", "1_0", "1e", "٣", " "):
        with pytest.raises(ValueError, match="dense value cannot be read"):
            A.dense_double(pa.array(["1", bad]))

    rng = np.random.default_rng(5)
    x = np.concatenate([np.arange(5000.0), rng.integers(0, 0x7FF << 52, 20000).view(np.float64), rng.random(5000), 2.0 ** np.arange(-80, 1023),
                        2.0 ** np.arange(60) - 1, rng.integers(0, 10**7, 9000) / 2e6, [-0.0, 5e-324, np.inf, np.nan, 1e-9]])
    numbers = spark.createDataFrame(pa.table({"i": np.arange(len(x)), "x": x}))
    out = numbers.select("i", F.log1p("x").alias("l"), F.round("x", 6).alias("r"), F.round(-F.col("x"), 6).alias("n")).toArrow().sort_by("i")
    for name, made in (("l", A.log1p(x)), ("r", A.round_half_up(x, 6)), ("n", A.round_half_up(-x, 6))):
        np.testing.assert_array_equal(made.view(np.int64)[~np.isnan(x)], out[name].to_numpy().view(np.int64)[~np.isnan(x)])
        assert np.isnan(made[np.isnan(x)]).all()
    np.testing.assert_array_equal(A.neg_to_zero(np.array([-2.0, 3.0, np.nan])), [0.0, 3.0, np.nan])


def test_array_hexadecimal_and_whole_numbers(spark):
    texts = ["0", "ff", "Ff", "f" * 15, "7" + "f" * 15, "0" * 30 + "ab", "a1b2c3d4"]
    df = spark.createDataFrame([(t,) for t in [*texts, "a" * 40]], "c string").coalesce(1)
    for m in (7, 8192, 2**57 + 3):
        assert A.hex_mod(pa.array([*texts, "a" * 40]), m).tolist() == [r[0] for r in df.select(S.hex_mod(F.col("c"), m)).collect()]
    assert A.hex_to_int(pa.array(texts)).tolist() == [int(t, 16) for t in texts]
    assert A.hex_to_int(pa.array([None, *texts]).slice(3)).tolist() == [int(t, 16) for t in texts[2:]]
    for bad in ("", "g", "1g", "-1", "0x1", " 1", "é"):
        with pytest.raises(ValueError, match="not hexadecimal"):
            A.hex_mod(pa.array(["1", bad]), 7)
    for bad in ("8" + "0" * 15, "f" * 16, "g"):
        with pytest.raises(ValueError, match="not hexadecimal, or too large"):
            A.hex_to_int(pa.array(["1", bad]))
    whole = ["7", "-7", "+7", " 7\t", "7\x7f", "-9223372036854775808", "007"]
    assert A.to_long(pa.array(whole)).tolist() == [r[0] for r in spark.createDataFrame([(t,) for t in whole], "c string").coalesce(1).select(F.col("c").cast("bigint")).collect()]
    for bad in ("0x1f", "1.", "", "9223372036854775808", "1d"):
        with pytest.raises(ValueError, match="whole number"):
            A.to_long(pa.array(["1", bad]))
    assert A.unsigned_32(np.array([-1, 5, -1000])).tolist() == [2**32 - 1, 5, 2**32 - 1000]


def test_wide_rows_meet_no_engine_between_steps(spark, tmp_path):
    """Making and preparing wide rows is one pass, and rounds as Spark does; the rows are those of narrow specs."""
    rows = [(i * 37 - 400 if i % 17 else None, i % 7 if i % 5 else None, ("click", "view", None)[i % 3]) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    spec = FeatureSpec.from_counts(80, 30)
    log = base.clicklog(spark, str(tmp_path), spec)
    prepared = jobs.preprocess(log, spec, 64, ["row_id"], places=6)
    plan = prepared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    key = lambda r: tuple((v is None, v) for v in r)
    for dense, sparse in ((80, 10), (80, 0)):
        part = FeatureSpec.from_counts(dense, sparse)
        narrow = base.clicklog(spark, str(tmp_path), part)
        names = [*base.ROW, *part.columns]
        assert sorted(map(tuple, log.select(names).collect()), key=key) == sorted(map(tuple, narrow.select(names).collect()), key=key)
        done = jobs.preprocess(narrow, part, 64, ["row_id"], places=6)
        assert sorted(map(tuple, prepared.select(done.columns).collect()), key=key) == sorted(map(tuple, done.collect()), key=key)
    at_most = spark.createDataFrame([(2**62, 1, "click")], "event_id long, user_id long, event_type string")
    at_most.write.parquet(str(tmp_path / "large" / "events.parquet"))
    with pytest.raises(Exception, match="too large"):
        base.clicklog(spark, str(tmp_path / "large"), spec).collect()
