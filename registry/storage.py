"""Sources and sinks: data goes to files in the shared folder and comes back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions import arrays as A
from clickloom.functions.dense import fill_missing
from clickloom.functions.rows import map_as_arrays
from clickloom.functions.sparse import hex_mod, hex_to_int
from clickloom.session import new_path, spread
from clickloom.sinks import files as sinks
from clickloom.sinks import stages
from clickloom.sources import clicklog as tsv
from clickloom.sources import generate, records, tfrecord
from clickloom.sources.text import read_documents, write_documents
from clickloom.spec import STANDARD, WIDE
from registry.base import (
    DENSE, M, ROW, SPARSE, clicklog, fill, hexmod, hexv, listed, query, table, with_f1,
)

ALL = ", ".join(STANDARD.columns)
RAW = with_f1(f"SELECT row_id, split, {ALL} FROM f1")


def text_log(spark, sf) -> str:
    """The raw click log as tab-separated text: row id, split, 40 fields."""
    path = new_path(spark, "clicklog-text")
    sinks.write_tsv(clicklog(spark, sf), path)
    return path


# --- text and Parquet sources -----------------------------------------------


@query(
    "scan_clicklog_tsv",
    with_f1(
        "SELECT row_id, split, cast(col_0 as varchar) AS col_0, "
        + listed([*DENSE, *SPARSE], lambda c: f"nullif({c}, '')") + " FROM f1"
    ),
)
def scan_clicklog_tsv(spark, sf):
    return tsv.read_tsv(spark, text_log(spark, sf), STANDARD, "row_id BIGINT, split INT")


@query("scan_columns", "SELECT event_id, user_id FROM events")
def scan_columns(spark, sf):
    return tsv.read_columns(spark, f"{sf}/events.parquet", ["event_id", "user_id"])


@query("scan_parquet_glob", "SELECT * FROM supplier")
def scan_parquet_glob(spark, sf):
    return tsv.read_glob(spark, sf, "suppl*.parquet")


@query("scan_parquet_rows", "SELECT * FROM customer")
def scan_parquet_rows(spark, sf):
    return tsv.read_rows(spark, f"{sf}/customer.parquet")


@query(
    "scan_text_docs",
    "SELECT 'doc_id=' || cast(doc_id as varchar) AS folder, md5(text) AS text_md5, "
    "cast(length(text) as integer) AS n FROM documents",
)
def scan_text_docs(spark, sf):
    path = new_path(spark, "documents")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # The writer ends each file with a line break.
    write_documents(docs, path)
    text = F.regexp_replace(F.col("text"), r"\n\z", "")
    return read_documents(spark, path).select(
        F.substring_index("doc_id", "/", 1).alias("folder"),
        F.md5(text).alias("text_md5"),
        F.char_length(text).alias("n"),
    )


# --- binary records ---------------------------------------------------------


def record_log(spark, sf) -> str:
    """The click log as records: label, dense, two zeros, sparse, six zeros."""
    unsigned = lambda c: F.pmod(c.cast("bigint"), F.lit(2**32))
    zero = F.lit(0).cast("bigint")
    fields = [F.col("col_0").cast("bigint")]
    fields += [unsigned(fill_missing(c).cast("int")) for c in DENSE]
    fields += [zero] * (records.FIRST_SPARSE_FIELD - len(fields))
    fields += [hex_to_int(fill_missing(c)) for c in SPARSE]
    fields += [zero] * (records.RECORD_FIELDS - len(fields))
    path = new_path(spark, "records")
    rows = clicklog(spark, sf).select(*[c.alias(f"f_{i}") for i, c in enumerate(fields)])
    records.write_records(rows, path)
    return path


def _unsigned(c: str) -> str:
    v = f"cast({fill(c)} as bigint)"
    return f"case when {v} < 0 then {v} + 4294967296 else {v} end"


def _field_sql(i: int) -> str:
    if i == 0:
        return "cast(col_0 as bigint)"
    if i <= len(DENSE):
        return _unsigned(DENSE[i - 1])
    j = i - records.FIRST_SPARSE_FIELD
    return hexv(SPARSE[j]) if 0 <= j < len(SPARSE) else "0::bigint"


def _wrapped(v: str) -> str:
    return f"cast(case when {v} >= 2147483648 then {v} - 4294967296 else {v} end as integer)"


@query(
    "scan_binary_rows",
    with_f1("SELECT " + ", ".join(f"{_field_sql(i)} AS f_{i}" for i in range(48)) + " FROM f1"),
)
def scan_binary_rows(spark, sf):
    return records.read_records(spark, record_log(spark, sf))


@query(
    "scan_binary_dense40",
    with_f1("SELECT " + ", ".join(f"{_wrapped(_field_sql(i))} AS col_{i}" for i in range(40)) + " FROM f1"),
)
def scan_binary_dense40(spark, sf):
    return records.read_dense40(spark, record_log(spark, sf))


@query("scan_binary_column", with_f1(f"SELECT {_unsigned('col_3')} AS col_3, {hexv('col_20')} AS col_20 FROM f1"))
def scan_binary_column(spark, sf):
    return records.read_columns(spark, record_log(spark, sf), ["col_3", "col_20"])


@query(
    "scan_binary_ranges",
    with_f1(f"SELECT {_field_sql(0)} AS f_0, {_field_sql(5)} AS f_5, {_field_sql(41)} AS f_41 FROM f1"),
)
def scan_binary_ranges(spark, sf):
    """Ranges far smaller than a file, so that files are cut many times."""
    path = record_log(spark, sf)
    return records.read_records(spark, path, keep=[0, 5, 41], range_bytes=64 * 1024)


@query(
    "unpack_binary_fields",
    with_f1(
        f"SELECT col_0, {listed(DENSE, lambda c: f'cast({fill(c)} as integer)')}, "
        f"{listed(SPARSE, hexmod)} FROM f1"
    ),
)
def unpack_binary_fields(spark, sf):
    return records.unpack_fields(records.read_records(spark, record_log(spark, sf)), m=M)


def file_count(df) -> int:
    return df.select(F.col("_metadata.file_path").alias("f")).distinct().count()


@query("records_append", with_f1(f"SELECT {_field_sql(0)} AS f_0, {_field_sql(5)} AS f_5 FROM f1 UNION ALL "
       f"SELECT {_field_sql(0)} AS f_0, {_field_sql(5)} AS f_5 FROM f1"))
def records_append(spark, sf):
    """Two jobs write to one folder; the rows of both are there."""
    path = record_log(spark, sf)
    records.write_records(records.read_records(spark, path), target := new_path(spark, "records"))
    records.write_records(records.read_records(spark, path), target)
    return records.read_records(spark, target, keep=[0, 5])


WIDE_FIELDS = 547


@query(
    "scan_binary_column_wide",
    with_f1(f"SELECT {_unsigned('col_3')} AS col_3, cast({fill('col_7')} as float) AS col_7, {hexv('col_505')} AS col_505, "
            f"{_wrapped(hexv('col_546'))} AS col_546 FROM f1", WIDE),
)
def scan_binary_column_wide(spark, sf):
    """547 fields: an unsigned, a float, an unsigned and a signed one."""
    unsigned, whole = [A.fill_missing, A.to_long, A.unsigned_32], [A.fill_missing, A.hex_to_int]
    roles = [
        (WIDE.dense[:6], unsigned, T.LongType()),
        (["col_7"], [A.fill_missing, A.to_float], T.FloatType()),
        (WIDE.dense[7:], unsigned, T.LongType()),
        (WIDE.sparse, whole, T.LongType()),
    ]
    # Records hold the columns in order, whatever their names.
    fields = map_as_arrays(clicklog(spark, sf, WIDE), roles, [WIDE.label])
    path = new_path(spark, "wide-records")
    records.write_records(fields, path)
    kinds = {"col_7": "float32", "col_546": "int32"}
    columns = ["col_3", "col_7", "col_505", "col_546"]
    return records.read_columns(spark, path, columns, WIDE, WIDE_FIELDS, kinds)


# --- TFRecord ---------------------------------------------------------------

PAYLOADS = "SELECT md5(text) AS payload_md5, cast(strlen(text) as integer) AS n FROM documents"


def tfrecord_log(spark, sf) -> str:
    path = new_path(spark, "tfrecords")
    texts = spread(table(spark, sf, "documents").select("text"))
    payloads = texts.select(
        F.encode("text", "UTF-8").alias("payload"), F.lit(None).cast("bigint").alias("payload_crc")
    )
    tfrecord.write_tfrecords(payloads, path)
    return path


def payload_digests(df):
    return df.select(F.md5("payload").alias("payload_md5"), F.octet_length("payload").alias("n"))


@query("scan_tfrecord", PAYLOADS)
def scan_tfrecord(spark, sf):
    return payload_digests(tfrecord.read_tfrecords(spark, tfrecord_log(spark, sf)))


@query("scan_tfrecord_ranges", PAYLOADS)
def scan_tfrecord_ranges(spark, sf):
    """Files cut into ranges of 100,000 bytes, of which a task reads many."""
    return payload_digests(tfrecord.read_tfrecords(spark, tfrecord_log(spark, sf), range_bytes=100_000))


@query("reshard_tfrecord", PAYLOADS)
def reshard_tfrecord(spark, sf):
    target = new_path(spark, "tfrecords-resharded")
    sinks.reshard_tfrecords(spark, tfrecord_log(spark, sf), target, files=5)
    return payload_digests(tfrecord.read_tfrecords(spark, target, "part-*.tfrecord"))


@query(
    "reshard",
    with_f1("SELECT cast(row_id as varchar) || chr(9) || cast(split as varchar) || chr(9) || "
            "cast(col_0 as varchar) || chr(9) || " + " || chr(9) || ".join([*DENSE, *SPARSE])
            + " AS value, 5 AS files FROM f1"),
)
def reshard(spark, sf):
    target = new_path(spark, "text-resharded")
    sinks.reshard_text(spark, text_log(spark, sf), target, files=5)
    back = spark.read.text(target)
    return back.withColumn("files", F.lit(file_count(back)))


# --- generators -------------------------------------------------------------


def _word_sql(seed: int, j: int) -> str:
    return f"substr(md5(concat('{seed}|', cast(event_id as varchar), '|{j // 4}')), {1 + 8 * (j % 4)}, 8)"


def _num_sql(seed: int, j: int) -> str:
    return f"('0x' || {_word_sql(seed, j)})::bigint"


def _generated_sql(seed: int, sparse) -> str:
    dense = [
        f"cast(cast(cast({_num_sql(seed, j)} as double) / 4294967296.0::double * 2000.0::double - 1000.0::double as float) as double) AS {c}"
        for j, c in enumerate(DENSE, start=1)
    ]
    return (
        f"SELECT event_id, {_num_sql(seed, 0)} % 2 AS col_0, {', '.join(dense)}, "
        + ", ".join(f"{sparse(j)} AS {c}" for j, c in enumerate(SPARSE))
        + " FROM events"
    )


def _doubles(df):
    return df.withColumns({c: F.col(c).cast("double") for c in DENSE})


@query("gen_clicklog_hex", _generated_sql(21, lambda j: f"upper({_word_sql(21, 14 + j)})"))
def gen_clicklog_hex(spark, sf):
    ids = spread(table(spark, sf, "events").select("event_id"))
    return _doubles(generate.generate_clicklog(ids, STANDARD, "event_id", seed=21))


@query(
    "gen_clicklog_int64",
    _generated_sql(
        22,
        lambda j: f"({_num_sql(22, 14 + 2 * j)} & 2147483647) * 4294967296 + {_num_sql(22, 15 + 2 * j)}",
    ),
)
def gen_clicklog_int64(spark, sf):
    ids = spread(table(spark, sf, "events").select("event_id"))
    return _doubles(generate.generate_clicklog(ids, STANDARD, "event_id", seed=22, sparse="int64"))


@query(
    "gen_clicklog_files",
    "SELECT count(*) AS n, 6 AS files, count(*) * 268 AS estimated_bytes, count(distinct event_id) AS ids FROM events",
)
def gen_clicklog_files(spark, sf):
    path = new_path(spark, "generated")
    ids = table(spark, sf, "events").select("event_id").repartition(6)
    rows = generate.generate_clicklog(ids, STANDARD, "event_id", seed=23)
    sinks.write_row_groups(rows, path, 1000)
    return (
        spark.read.parquet(path)
        .select("event_id", F.col("_metadata.file_name").alias("f"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("f").cast("int").alias("files"),
            F.countDistinct("event_id").alias("ids"),
        )
        .withColumn("estimated_bytes", F.col("n") * generate.estimated_bytes(STANDARD, 1))
    )


# --- sinks ------------------------------------------------------------------


@query("write_parquet_snappy", RAW)
def write_parquet_snappy(spark, sf):
    path = new_path(spark, "snappy")
    sinks.write_snappy(clicklog(spark, sf), path)
    return spark.read.parquet(path)


@query("write_parquet_rowgroups", RAW)
def write_parquet_rowgroups(spark, sf):
    path = new_path(spark, "row-groups")
    sinks.write_row_groups(clicklog(spark, sf), path, 100)
    return spark.read.parquet(path)


SHARDS = 16


@query("split_parquet", with_f1(f"SELECT row_id, col_14, cast(ntile({SHARDS}) over (order by row_id) - 1 as integer) AS shard FROM f1"))
def split_parquet(spark, sf):
    path = new_path(spark, "shards")
    sinks.write_shards(clicklog(spark, sf).select("row_id", "col_14"), path, "row_id", SHARDS)
    return spark.read.parquet(path).withColumn("shard", F.col("shard").cast("int"))


@query("compact_parquet", with_f1(f"SELECT row_id, col_14, cast((ntile({SHARDS}) over (order by row_id) - 1) // 4 as integer) AS \"group\", 4 AS files FROM f1"))
def compact_parquet(spark, sf):
    source, target = new_path(spark, "shards"), new_path(spark, "compacted")
    sinks.write_shards(clicklog(spark, sf).select("row_id", "col_14"), source, "row_id", SHARDS)
    sinks.compact(spark, source, target, files_per_group=4, rows=1000, pattern=r"shard=(\d+)")
    back = spark.read.parquet(target)
    return back.select("row_id", "col_14", "group", F.lit(file_count(back)).alias("files"))


@query(
    "write_tsv",
    with_f1("SELECT cast(row_id as varchar) || chr(9) || cast(split as varchar) || chr(9) || "
            "cast(col_0 as varchar) || chr(9) || " + " || chr(9) || ".join([*DENSE, *SPARSE])
            + " AS value FROM f1"),
)
def write_tsv(spark, sf):
    return spark.read.text(text_log(spark, sf))


@query("write_splits", RAW)
def write_splits(spark, sf):
    path = new_path(spark, "splits")
    sinks.write_splits(clicklog(spark, sf), path)
    return spark.read.parquet(path)


@query("write_if_absent", with_f1(f"SELECT row_id, split, {listed(SPARSE, hexmod)} FROM f1"))
def write_if_absent(spark, sf):
    """The second call must find the first one's output and not build again."""
    path = new_path(spark, "stage")

    def build():
        return clicklog(spark, sf).select(
            *ROW, *[hex_mod(fill_missing(c), M).alias(c) for c in SPARSE]
        )

    def rebuilt():
        raise AssertionError("the stage was built twice")

    sinks.write_if_absent(spark, path, build)
    return sinks.write_if_absent(spark, path, rebuilt)


@query("write_if_changed", with_f1(f"SELECT row_id, split, {listed(SPARSE, hexmod)} FROM f1"))
def write_if_changed(spark, sf):
    """The output of another modulus is not reused; the same call again builds nothing."""
    path = new_path(spark, "stage")
    log = clicklog(spark, sf)
    origin = [stages.source_fingerprint(log)]

    def stage(m, build=None):
        def reduced():
            return log.select(*ROW, *[hex_mod(fill_missing(c), m).alias(c) for c in SPARSE])

        return stages.write_if_changed(spark, path, build or reduced, {"modulus": m}, origin)

    def rebuilt():
        raise AssertionError("the stage was built twice")

    stage(M // 2)
    stage(M)
    return stage(M, rebuilt)
