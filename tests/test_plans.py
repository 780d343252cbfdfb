"""The plans we expect: what is pushed down, broadcast and shuffled."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickloom.operators import embeddings as E
from clickloom.operators import vocabulary as V
from clickloom.plans import jobs
from clickloom.sources import clicklog
from clickloom.sources.vector_store import Opened, write_vector_store
from clickloom.spec import FeatureSpec

SPEC = FeatureSpec.from_counts(2, 3)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, "1", "5", "-2", f"{i:x}", "ff", "0a") for i in range(200)]
    names = ", ".join(f"{c} string" for c in SPEC.columns)
    spark.createDataFrame(rows, f"row_id bigint, {names}").write.parquet(path)
    return path


def test_preparation_is_one_pass_without_shuffle(spark, tmp_path):
    out = jobs.preprocess(spark.read.parquet(log(spark, tmp_path)), SPEC, 8192)
    text = plan(out)
    assert "Exchange" not in text and "Python" not in text and "row_id" not in text


def test_only_wanted_columns_are_read(spark, tmp_path):
    text = plan(clicklog.read_columns(spark, log(spark, tmp_path), ["col_2"]))
    assert "ReadSchema: struct<col_2:string>" in text


def test_filters_reach_the_files(spark, tmp_path):
    df = spark.read.parquet(log(spark, tmp_path)).where(F.col("row_id") > 5)
    assert "GreaterThan(row_id,5)" in plan(df)


def test_counting_combines_before_the_shuffle(spark, tmp_path):
    text = plan(V.value_counts(spark.read.parquet(log(spark, tmp_path)), SPEC.sparse))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def test_small_vocabularies_are_broadcast(spark, tmp_path):
    df = spark.read.parquet(log(spark, tmp_path))
    vocabulary = V.fit_vocabulary(df, SPEC.sparse)
    text = plan(V.apply_vocabulary(df, SPEC.sparse, vocabulary))
    assert text.count("BroadcastHashJoin") == 3
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text
    # Each column reads only its own folder.
    assert text.count("PartitionFilters: [isnotnull(feature") == 3


def test_no_cross_joins(spark, tmp_path):
    df = spark.read.parquet(log(spark, tmp_path))
    vocabulary = V.fit_vocabulary(df, SPEC.sparse)
    out = V.apply_vocabulary(df, SPEC.sparse, vocabulary, row_key="row_id", broadcast_rows=0)
    text = plan(out)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


DOCS = [(1, "the odd cat " * 5), (2, None), (3, ""), (None, "cat, the. cat Rare words here"), (5, "!!")]
WORDS = [("the", 5, [1.0, 2.0]), ("cat", 2, [3.0, 4.0]), (None, 9, [5.0, 6.0]), ("unused", 3, [0.5, 0.25])]


def text_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    return docs, spark.createDataFrame(WORDS, "word string, idx bigint, vec array<float>")


def test_sequences_need_no_shuffle(spark, monkeypatch):
    """Vectors come from mapped files, in pieces when a document has more than a task holds."""
    docs, words = text_tables(spark)
    filled = jobs.text_to_vectors(docs, words, 2, seed=4)
    wanted = sorted(E.vector_batches(filled, 2).collect(), key=repr)
    for floats in (1 << 21, 6):
        monkeypatch.setattr(E, "TASK_FLOATS", floats)
        out = jobs.text_to_vector_batches(docs, words, 2, seed=4, size=2)
        assert "Exchange" not in plan(out)
        assert sorted(out.collect(), key=repr) == wanted


def test_large_word_tables_are_mapped(spark, monkeypatch):
    """Beyond the broadcast limit no exchange carries a vector."""
    docs, words = text_tables(spark)
    wanted = sorted(E.lookup_words(docs, words).collect(), key=repr)
    monkeypatch.setattr(E, "BROADCAST_BYTES", 0)
    out = E.lookup_words(docs, words)
    assert "Exchange" not in plan(out) and "Join" not in plan(out)
    assert sorted(out.collect(), key=repr) == wanted
    odd = words.unionByName(spark.createDataFrame([("odd", 7, [1.0])], words.schema))
    assert E.lookup_words(docs, odd).where("token = 'odd'").first()["idx"] == 7


def test_store_refuses_a_word_twice(spark):
    _, words = text_tables(spark)
    with pytest.raises(ValueError, match="twice"):
        write_vector_store(words.union(words), 2)


def test_store_of_many_batches(spark):
    """Hashes of words in other files, other batches, and before the first one."""
    words = spark.range(5000).select(
        F.concat(F.lit("w"), F.col("id")).alias("word"), F.col("id").alias("idx"),
        F.array(F.col("id").cast("float"), -F.col("id").cast("float")).alias("vec"),
    )
    kept = write_vector_store(words.repartition(5), 2)
    held = Opened(kept.path, 2)
    names = pa.array([f"w{i}" for i in range(-20, 5020)])
    keys = spark.createDataFrame([(n,) for n in names.to_pylist()], "word string")
    hashes = np.array([r[0] for r in keys.select(F.xxhash64(F.lit(kept.seed), "word")).collect()])
    known, idx, vectors = held.lookup(hashes, names)
    assert known.tolist() == [0 <= i < 5000 for i in range(-20, 5020)]
    assert idx[known].tolist() == list(range(5000)) and vectors[known][:, 1].tolist() == [-i for i in range(5000)]


def test_days_evaluate_their_input_three_times_at_most(spark, tmp_path):
    spec = FeatureSpec.from_counts(1, 2)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, str(i % 2), str(i), f"{i % 7:x}", f"{i % 50:x}") for i in range(300)]
    schema = "row_id bigint, col_0 string, col_1 string, col_2 string, col_3 string"
    df = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    # Rows from memory are known by their content, which reads them; a name for the source does not.
    kept = {"folder": str(tmp_path / "d"), "source": "300 rows"}
    out = jobs.prepare_days(df, spec, "row_id", 3, 8192, randomize="total", **kept)
    assert out.count() == 300 and seen.value <= 3 * 300
    before = seen.value
    again = jobs.prepare_days(df, spec, "row_id", 3, 8192, randomize="total", **kept)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert seen.value == before
    days = df.withColumn("day", F.col("row_id") % 3)
    by_day = jobs.prepare_days(days, spec, "row_id", 3, 8192, split="day").collect()
    assert all(r["split"] == r["row_id"] % 3 for r in by_day)
    assert sorted(r["slot"] for r in by_day if r["split"] == 1) == list(range(100))


@pytest.mark.parametrize("randomize", ["none", "day", "total"])
def test_days_move_wide_rows_once(spark, tmp_path, randomize):
    """Rows go straight to their block: one exchange, and nothing is joined to them."""
    df = spark.read.parquet(log(spark, tmp_path))
    text = plan(jobs.prepare_days(df, SPEC, "row_id", 3, 8192, randomize=randomize))
    assert "Join" not in text and text.count("Exchange") == 1


@pytest.mark.parametrize("randomize", ["none", "day", "total"])
def test_days_with_text_keys(spark, tmp_path, randomize):
    """Text keys are numbered beside the rows; places are a permutation of each day."""
    df = spark.read.parquet(log(spark, tmp_path)).selectExpr(
        "concat('r', row_id) AS row_id", "* EXCEPT (row_id)", "cast(row_id % 3 as int) AS day"
    )
    rows = jobs.prepare_days(df, SPEC, "row_id", 3, 8192, randomize=randomize, split="day").collect()
    for day, n in ((0, 67), (1, 67), (2, 66)):
        assert sorted(r["slot"] for r in rows if r["split"] == day) == list(range(n))
