"""Stages are reused only while arguments and input are the same."""

import json
import os

import pytest
from pyspark.sql import functions as F

from clickloom.plans import jobs
from clickloom.sinks import stages
from clickloom.spec import FeatureSpec

SPEC = FeatureSpec.from_counts(1, 2)
STAGES = ("prepared", "vocabulary", "days")
BASE = {"days": 3, "modulus": 64, "negatives_rate": 0.25, "randomize": "day", "seed": 5}


def log(spark, path, rows=120):
    data = [(i, i % 4, str(i % 2), str(i), f"{i % 7:x}", f"{i % 50:x}") for i in range(rows)]
    schema = "row_id bigint, file bigint, col_0 string, col_1 string, col_2 string, col_3 string"
    spark.createDataFrame(data, schema).repartition(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def job(spark, tmp_path):
    """Runs the job in one folder; says which stages it built, and checks its rows against a fresh run."""
    folder, times = str(tmp_path / "kept"), {}

    def run(df, **changes):
        arguments = {**BASE, **changes}
        fresh = {k: v for k, v in arguments.items() if k not in ("source", "recreate")}
        out = jobs.prepare_days(df, SPEC, "row_id", folder=folder, **arguments)
        built = []
        for s in STAGES:
            now = os.stat(f"{folder}/{s}/{stages.MANIFEST}").st_mtime_ns
            if times.get(s) != now:
                built.append(s)
            times[s] = now
        if built and changes:
            wanted = jobs.prepare_days(df, SPEC, "row_id", **fresh)
            assert sorted(map(tuple, out.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
        return built

    return run


@pytest.mark.parametrize(
    "changes, built",
    [
        ({}, []),
        ({"modulus": 32}, STAGES),
        ({"negatives_rate": 0.5}, STAGES),
        ({"seed": 6}, STAGES),
        ({"days": 4}, ("prepared", "days")),
        ({"split": "file", "days": 4}, ("prepared", "days")),
        ({"randomize": "total"}, ("days",)),
        ({"randomize": "none"}, ("days",)),
        ({"holdout": False}, ("days",)),
        ({"recreate": True}, STAGES),
    ],
)
def test_argument(spark, tmp_path, job, changes, built):
    df = log(spark, str(tmp_path / "log"))
    assert job(df) == list(STAGES)
    assert job(df, **changes) == list(built)
    changes.pop("recreate", None)
    assert job(df, **changes) == []


def test_arguments_that_do_not_matter(spark, tmp_path, job):
    """Without draws the seed changes nothing; without an order the held out day does not."""
    df = log(spark, str(tmp_path / "log"))
    job(df, negatives_rate=0.0, randomize="none")
    assert job(df, negatives_rate=0.0, randomize="none", seed=9, holdout=False) == []
    assert job(df, negatives_rate=0.0, randomize="day", seed=9) == ["days"]


def test_input_files(spark, tmp_path, job):
    path = str(tmp_path / "log")
    df = log(spark, path)
    job(df)
    assert job(spark.read.parquet(path)) == []
    assert job(log(spark, path, 121)) == list(STAGES)
    assert job(spark.read.parquet(path).where("row_id <> 7")) == list(STAGES)


def test_input_without_files(spark, job):
    def rows(last):
        data = [(i, str(i % 2), str(i), f"{i % 7:x}", f"{i % 50:x}") for i in [*range(30), last]]
        return spark.createDataFrame(data, "row_id bigint, col_0 string, col_1 string, col_2 string, col_3 string")

    job(rows(40))
    assert job(rows(40)) == []
    assert job(rows(41)) == list(STAGES)
    job(rows(41), source="first")
    assert job(rows(41), source="first") == []
    assert job(rows(41), source="second") == list(STAGES)


def test_fingerprints_of_rows(spark):
    schema = "a int, b int, m map<string,int>, l array<int>, v struct<x:int>"
    kinds = [(1, None, {"k": 1}, [1], (1,)), (None, 1, {"k": 1}, [1], (1,)), (1, None, {"k": 2}, [1], (1,)),
             (1, None, {"k": 1}, [1, None], (1,)), (1, None, None, [1], (None,)), (1, None, {}, [1], None)]
    prints = {stages.source_fingerprint(spark.createDataFrame([k], schema)) for k in kinds}
    assert len(prints) == len(kinds)
    both = [stages.source_fingerprint(spark.createDataFrame(k, schema)) for k in (kinds, kinds[::-1], kinds * 2)]
    assert both[0] == both[1] != both[2]
    plan = spark.createDataFrame([(i,) for i in range(9)], "a int").where(F.col("a") > 3)
    assert stages.source_fingerprint(plan) == stages.source_fingerprint(plan)


def test_plain_files_are_not_read(spark, tmp_path):
    """Unreadable files would fail if their rows were looked at."""
    path = str(tmp_path / "log")
    df = log(spark, path).select("row_id", F.col("col_1").cast("int"))
    before = stages.source_fingerprint(df)
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            with open(f"{path}/{name}", "r+b") as file:
                held = file.read()
                file.seek(0)
                file.write(b"x" * len(held))
            os.utime(f"{path}/{name}", (1, 1))
    assert stages.source_fingerprint(df) != before


def test_unfinished_and_damaged(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def build():
        calls.append(1)
        return spark.range(3)

    for spoil in (None, "rows", "manifest", "text"):
        if spoil == "rows":
            (tmp_path / "stage" / "_SUCCESS").unlink()
        if spoil == "manifest":
            (tmp_path / "stage" / stages.MANIFEST).unlink()
        if spoil == "text":
            (tmp_path / "stage" / stages.MANIFEST).write_text("{")
            (tmp_path / "stage" / f".{stages.MANIFEST}.crc").unlink(missing_ok=True)
        assert stages.write_if_changed(spark, path, build, {"a": 1}).count() == 3
    assert len(calls) == 4
    manifest = json.loads((tmp_path / "stage" / stages.MANIFEST).read_text())
    assert manifest["parameters"] == {"a": 1}
    stages.write_if_absent(spark, path, build)
    assert len(calls) == 4
    stages.write_if_absent(spark, path, build, recreate=True)
    assert len(calls) == 5 and stages.read_manifest(spark, path) is None
