"""Vocabularies and lookups, with skewed values, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickloom.operators import numbering
from clickloom.operators import vocabulary as V
from clickloom.sinks import files as sinks
from clickloom.operators.lookup import skewed_lookup, store_with_heavy

FEATURES = ["a", "b"]


def rows(n=900, seed=3):
    """A third of the cells of ``a`` hold one value; some cells are NULL."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = 77 if i % 3 == 0 else rng.randrange(300)
        b = None if i % 10 == 0 else rng.randrange(9, 12)
        out.append((i, a, b))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "id bigint, a bigint, b bigint").repartition(6)


def python_vocabulary(order):
    out = {}
    for j, f in enumerate(FEATURES, start=1):
        values = [r[j] for r in rows() if r[j] is not None]
        if order == "first_seen":
            ranked = list(dict.fromkeys(values))
        elif order == "sorted":
            ranked = sorted(set(values))
        else:
            counts = Counter(values)
            ranked = sorted(counts, key=str, reverse=True)
            ranked.sort(key=lambda v: -counts[v])
        out[f] = {v: i for i, v in enumerate(ranked)}
    return out


def as_dict(vocabulary):
    out = {f: {} for f in FEATURES}
    for r in vocabulary.collect():
        out[r["feature"]][r["value"]] = r["idx"]
    return out


@pytest.mark.parametrize("order", ["first_seen", "sorted", "frequency"])
@pytest.mark.parametrize("plain_rows", [10**6, 0])
def test_fit(spark, table, order, plain_rows, monkeypatch):
    monkeypatch.setattr(numbering, "PLAIN_ROWS", plain_rows)
    key = "id" if order == "first_seen" else None
    assert as_dict(V.fit_vocabulary(table, FEATURES, order, key)) == python_vocabulary(order)


def test_row_key_is_required_only_for_first_seen(table):
    with pytest.raises(ValueError):
        V.fit_vocabulary(table, FEATURES, "first_seen")
    with pytest.raises(ValueError):
        V.fit_vocabulary(table, FEATURES, "sorted", "id")


@pytest.mark.parametrize("budget", [10**6, 100, 0])
def test_apply_is_the_same_by_broadcast_and_by_shuffle(table, budget):
    known = python_vocabulary("sorted")
    vocabulary = V.fit_vocabulary(table, FEATURES, "sorted").where("value <> 77")
    out = V.apply_vocabulary(table, FEATURES, vocabulary, "oov", -1, "id", budget)
    assert out.columns == table.columns
    expected = [
        (i, -1 if a == 77 else known["a"][a], -1 if b is None else known["b"][b])
        for i, a, b in rows()
    ]
    assert sorted(map(tuple, out.collect())) == expected


def test_large_vocabulary_needs_no_row_key(table):
    known = python_vocabulary("sorted")
    vocabulary = V.fit_vocabulary(table, FEATURES, "sorted")
    doubled = table.unionByName(table)  # repeated rows stay repeated
    out = V.apply_vocabulary(doubled, FEATURES, vocabulary, "null", broadcast_rows=0)
    assert out.columns == table.columns
    expected = [(i, known["a"][a], None if b is None else known["b"][b]) for i, a, b in rows()]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected * 2))


def test_text_vocabulary_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([("x", "1"), ("y", "1"), ("x", None)], "a string, b string")
    fitted = V.fit_vocabulary(df, ["a", "b"])
    sinks.write_vocabulary(fitted, str(tmp_path / "v"))
    back = sinks.read_vocabulary(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, fitted.collect()))
    assert dict(back.dtypes)["value"] == "string"


def test_unseen(spark, table):
    vocabulary = V.fit_vocabulary(table, ["b"])
    fresh = spark.createDataFrame([(1, 10), (2, 99)], "id bigint, b bigint")
    by_null = V.apply_vocabulary(fresh, ["b"], vocabulary, "null").orderBy("id").collect()
    assert by_null[0]["b"] is not None and by_null[1]["b"] is None
    with pytest.raises(Exception, match="not in the vocabulary"):
        V.apply_vocabulary(fresh, ["b"], vocabulary, "error").collect()


def test_extend_keeps_old_ids(spark, table):
    first, later = table.where("id < 300"), table.where("id >= 300")
    old = V.fit_vocabulary(first, FEATURES, "first_seen", "id")
    assert as_dict(V.extend_vocabulary(old, later, FEATURES, "id")) == python_vocabulary("first_seen")


def test_extend_from_nothing(spark, table):
    old = V.fit_vocabulary(table.where("false"), FEATURES, "first_seen", "id")
    assert as_dict(V.extend_vocabulary(old, table, FEATURES, "id")) == python_vocabulary("first_seen")


def test_threshold_and_first_id(table):
    counts = Counter(r[1] for r in rows())
    fitted = as_dict(V.fit_vocabulary(table, ["a"], min_count=4, first_id=3))["a"]
    assert set(fitted) == {v for v, n in counts.items() if n >= 4}
    assert sorted(fitted.values()) == list(range(3, 3 + len(fitted)))
    assert fitted[77] == 3


def test_identity(spark):
    df = spark.createDataFrame([(-1,), (0,), (9,), (10,), (None,)], "v bigint")
    found = [r[0] for r in df.select(V.apply_identity(F.col("v"), 10)).collect()]
    assert found == [None, 0, 9, None, None]
    table = V.identity_vocabulary(spark, FEATURES, 10)
    by_table = V.apply_vocabulary(df.withColumnRenamed("v", "a"), ["a"], table, "null")
    assert sorted(r["a"] for r in by_table.collect() if r["a"] is not None) == [0, 9]


@pytest.mark.parametrize("sampled", ["all", "none"])
def test_skewed_lookup(spark, sampled):
    probe = [(i, "hot" if i % 3 else f"k{i % 40}") for i in range(900)]
    probe += [(900, None), (901, "unknown")]
    df = spark.createDataFrame(probe, "id bigint, k string").repartition(5)
    known = {"hot": 1} | {f"k{i}": i for i in range(0, 40, 2)}
    table = spark.createDataFrame(list(known.items()), "k string, v bigint")
    sample = df.where(F.lit(sampled == "all") & F.col("k").isNotNull())
    out = skewed_lookup(df, table, ["k"], ["id"], sample).collect()
    assert sorted(tuple(r) for r in out if r["k"]) == sorted(
        (i, k, known.get(k)) for i, k in probe if k
    )
    assert len(out) == len(probe)


def test_large_vocabularies_read_their_input_once(spark):
    """Frequent values come from a sketch taken while the rows are kept."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id) AS `a-b`", "if(id % 2 = 0, null, concat('t', id % 5)) AS s")
    for c in ("a-b", "s"):
        one = rows.select("id", F.col(f"`{c}`").alias(c))
        vocabulary = V.fit_vocabulary(one.where("id < 2000"), [c], "sorted")
        counted = one.mapInArrow(count, one.schema)
        before = seen.value
        out = V.apply_vocabulary(counted, [c], vocabulary, "oov", row_key="id", broadcast_rows=0)
        found = sorted(map(tuple, out.collect()))
        assert seen.value == before + 3000
        plain = V.apply_vocabulary(one, [c], vocabulary, "oov")
        assert found == sorted(map(tuple, plain.collect()))


def test_frequent_values_are_found(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id + 100) AS a", "cast(null as int) AS n", "'x' AS s")
    kept, heavy = store_with_heavy(rows.repartition(5), ["a", "n", "s"], "rows", keys=2)
    assert kept.count() == 20_000
    assert [h[:2] for h in heavy] == [("s", "x"), ("a", 7)]


def test_rows_of_frequent_keys_are_not_shuffled(spark):
    df = spark.range(2000).selectExpr("id", "if(id % 10 = 0, concat('k', id), 'hot') AS k")
    table = spark.createDataFrame([("hot", [1.0]), ("k10", [2.0])], "k string, vec array<float>")
    heavy = spark.createDataFrame([("hot",)], "k string")
    out = skewed_lookup(df, table, ["k"], heavy=heavy)
    assert out.where("vec[0] = 1").count() == 1800 and out.where("vec[0] = 2").count() == 1 and out.count() == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "_route" not in plan


def test_ids_come_back_as_narrow_rows(spark):
    """Cells are dealt by row before they are gathered, and unknown ones do not come back."""
    rows = spark.range(400).selectExpr("id", "if(id % 4 = 0, null, id) AS `a-b`", "if(id % 2 = 0, 7, id) AS b")
    fitted = V.fit_vocabulary(rows.where("id < 200"), ["a-b", "b"], "sorted")
    out = V.apply_vocabulary(rows, ["a-b", "b"], fitted, "oov", row_key="id", broadcast_rows=0)
    plain = V.apply_vocabulary(rows, ["a-b", "b"], fitted, "oov")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "LeftAnti" in plan
