import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """A table of documents from texts; ids count from 1 unless given as pairs."""

    def make(*texts, extra=""):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, start=1)]
        rows = [(i, t, "en", "hot", None if t is None else len(t)) for i, t in rows]
        schema = T.StructType.fromDDL(f"{DOCUMENTS}, {extra}" if extra else DOCUMENTS)
        rows = [(*r, *[7] * (len(schema) - 5)) for r in rows]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def small_batches(spark):
    """Arrow batches of 3 rows, so that operators meet every boundary."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)
