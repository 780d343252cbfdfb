"""Files: sources, sinks and the shared folder."""

import gzip
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clickloom import session
from clickloom.functions.rows import map_batches, row_to_tsv
from clickloom.plans import jobs
from clickloom.sinks import files as sinks
from clickloom.sources import clicklog, generate, records, tfrecord, text
from clickloom.spec import STANDARD, WIDE, FeatureSpec


class Session:
    """The parts of a session that decide where stored tables go."""

    def __init__(self, configured=None, checkpoints=None, master="local[2]"):
        self.settings = {"spark.checkpoint.dir": configured}
        self.conf, self.sparkContext = self, self
        self.master, self.checkpoints = master, checkpoints

    def get(self, key, default=None):
        return self.settings.get(key) or default

    def getCheckpointDir(self):
        return self.checkpoints

    def setCheckpointDir(self, folder):
        self.checkpoints = folder


def test_shared_folder():
    assert session.shared_folder(Session("hdfs://x/y/", "/z", "yarn")) == "hdfs://x/y"
    assert session.shared_folder(Session(None, "hdfs://z", "yarn")) == "hdfs://z"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(master="spark://host"))
    local = Session()
    assert session.shared_folder(local) == session.shared_folder(local) == local.checkpoints


def test_store_counts_its_rows(spark):
    stored, rows = session.store_counted(spark.range(5), "numbers")
    assert rows == 5 and stored.count() == 5


def test_tune_keeps_the_users_choice(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(key, "9000")
    assert session.tune(spark).conf.get(key) == "9000"
    spark.conf.unset(key)
    assert session.tune(spark).conf.get(key) == session.JIT_METHOD_BYTES


def test_tsv_keeps_trailing_empty_fields(spark, tmp_path):
    spec = FeatureSpec.from_counts(2, 2)
    (tmp_path / "log.tsv").write_text('1\t5\t\tff\t\n0\t\t-3\t"a\t1g\n')
    rows = clicklog.read_tsv(spark, str(tmp_path / "log.tsv"), spec).collect()
    assert [tuple(r) for r in rows] == [("1", "5", None, "ff", None), ("0", None, "-3", '"a', "1g")]


def test_tsv_with_a_short_row_fails(spark, tmp_path):
    (tmp_path / "log.tsv").write_text("1\t5\n")
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        clicklog.read_tsv(spark, str(tmp_path / "log.tsv"), FeatureSpec.from_counts(2, 2)).collect()


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (None, "b")], "x string, y string")
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["\tb", "a\t"]
    assert df.select(row_to_tsv(df, ["y", "x"])).first()[0] == "\ta"


def test_glob(spark, tmp_path):
    for name in ("day_0", "day_1", "other"):
        spark.range(3).write.parquet(str(tmp_path / name))
    both = spark.read.parquet(str(tmp_path / "day_*"))
    split = clicklog.with_split_from_file(both, r"day_(\d+)")
    assert sorted(r["split"] for r in split.collect()) == [0] * 3 + [1] * 3
    with pytest.raises(FileNotFoundError):
        clicklog.read_glob(spark, str(tmp_path / "day_0"), "*.orc")


def write_binary(path, rows, fields=48, tail=b""):
    table = np.arange(rows * fields, dtype="<u4").reshape(rows, fields) * 99_991
    path.write_bytes(table.tobytes() + tail)
    return table


@pytest.mark.parametrize("range_bytes", [192, 1000, 1 << 20])
def test_records_in_ranges(spark, tmp_path, range_bytes):
    table = write_binary(tmp_path / "a.bin", 50, tail=b"\x01" * 100)
    out = records.read_records(spark, str(tmp_path), keep=[16, 0], range_bytes=range_bytes)
    assert out.columns == ["f_16", "f_0"]
    expected = sorted((int(r[16]), int(r[0])) for r in table)
    assert sorted(map(tuple, out.collect())) == expected


def test_flat_layout_refuses_a_cut_file(spark, tmp_path):
    write_binary(tmp_path / "a.bin", 5, tail=b"\x01" * 4)
    with pytest.raises(Exception, match="do not divide"):
        records.read_dense40(spark, str(tmp_path)).collect()


def test_unpacked_fields(spark, tmp_path):
    table = write_binary(tmp_path / "a.bin", 4)
    row = records.unpack_fields(records.read_records(spark, str(tmp_path))).collect()[3]
    wrapped = table[3].astype("<i4")
    assert row["col_0"] == wrapped[0] and row["col_13"] == wrapped[13]
    assert row["col_14"] == wrapped[16] and row["col_39"] == wrapped[41]


def test_empty_binary_file(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"")
    assert records.read_records(spark, str(tmp_path)).count() == 0


def test_checksum_of_known_text():
    # "123456789" is the usual check text of CRC-32C; its sum is e3069283.
    crc = 0xE3069283
    assert tfrecord.masked_crc(b"123456789") == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) % 2**32


def test_tfrecord_round_trip(spark, tmp_path):
    payloads = [b"", b"a", bytes(range(256)) * 50]
    df = spark.createDataFrame([(p, None) for p in payloads], "payload binary, payload_crc bigint")
    tfrecord.write_tfrecords(df, str(tmp_path / "one"))
    sinks.reshard_tfrecords(spark, str(tmp_path / "one"), str(tmp_path / "two"), files=2)
    assert len(list((tmp_path / "two").glob("part-*.tfrecord"))) == 2
    back = tfrecord.read_tfrecords(spark, str(tmp_path / "two"))
    assert sorted(bytes(r["payload"]) for r in back.collect()) == sorted(payloads)


def test_jobs_append_and_unfinished_ones_are_no_data(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS f_0", "id * 2 AS f_1")
    for _ in range(2):
        records.write_records(rows, str(tmp_path))
    read = lambda: records.read_records(spark, str(tmp_path), fields=2)
    assert read().count() == 200
    parts = list(tmp_path.glob("part-*.bin"))
    # A retried task's first attempt, a job that never ended, and hidden files.
    job = parts[0].name.split("-")[1]
    (tmp_path / f"part-{job}-{'0' * 32}.bin").write_bytes(parts[0].read_bytes())
    (tmp_path / f"part-{'1' * 32}-{'2' * 32}.bin").write_bytes(parts[0].read_bytes())
    (tmp_path / "_staging-x").mkdir()
    (tmp_path / "_staging-x" / "data.bin").write_bytes(parts[0].read_bytes())
    (tmp_path / ".hidden.bin").write_bytes(parts[0].read_bytes())
    assert read().count() == 200
    (tmp_path / "foreign.bin").write_bytes(np.arange(4, dtype="<u4").tobytes())
    assert read().count() == 202


def test_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(100, numPartitions=4).selectExpr("id AS f_0", "if(id = 99, raise_error('no'), id) AS f_1")
    with pytest.raises(Exception, match="no"):
        records.write_records(bad, str(tmp_path / "x"))
    assert not list((tmp_path / "x").glob("part-*")) if (tmp_path / "x").exists() else True


def test_wide_records(spark, tmp_path):
    write_binary(tmp_path / "a.bin", 5, fields=8)
    spec = FeatureSpec.from_counts(4, 3)
    with pytest.raises(ValueError, match="do not fit"):
        records.read_columns(spark, str(tmp_path), ["col_1"], spec, 8)
    with pytest.raises(ValueError, match="do not fit"):
        records.read_columns(spark, str(tmp_path), ["col_1"], WIDE)


def test_damaged_payload_fails(spark, tmp_path):
    df = spark.createDataFrame([(b"x" * 500, None)], "payload binary, payload_crc bigint")
    tfrecord.write_tfrecords(df.coalesce(1), str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("part-*")
    raw = bytearray(part.read_bytes())
    raw[200] ^= 1
    part.write_bytes(raw)
    for work in (lambda: tfrecord.read_tfrecords(spark, str(tmp_path / "t")).collect(),
                 lambda: sinks.reshard_tfrecords(spark, str(tmp_path / "t"), str(tmp_path / "u"), 1)):
        with pytest.raises(Exception, match="does not have its checksum"):
            work()


def test_broken_tfrecord_fails(spark, tmp_path):
    (tmp_path / "x.tfrecord").write_bytes(struct.pack("<QI", 5, 1) + b"12345" + b"0000")
    with pytest.raises(Exception, match="broken record length"):
        tfrecord.read_tfrecords(spark, str(tmp_path)).collect()


def test_row_groups(spark, tmp_path):
    sinks.write_row_groups(spark.range(0, 1000, 1, 1), str(tmp_path / "g"), 100)
    (file,) = (tmp_path / "g").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [100] * 10
    assert meta.row_group(0).column(0).compression == "UNCOMPRESSED"


def test_shards_and_compaction(spark, tmp_path):
    df = spark.range(103).repartition(4)
    sinks.write_shards(df, str(tmp_path / "s"), "id", 10)
    shards = sorted((tmp_path / "s").glob("shard=*"))
    assert [p.name for p in shards] == [f"shard={i:04d}" for i in range(10)]
    sizes = [sum(pq.read_metadata(f).num_rows for f in p.glob("*.parquet")) for p in shards]
    assert sizes == [11] * 3 + [10] * 7
    sinks.compact(spark, str(tmp_path / "s"), str(tmp_path / "c"), 4, pattern=r"shard=(\d+)")
    groups = sorted((tmp_path / "c").glob("group=*"))
    assert [p.name for p in groups] == ["group=0", "group=1", "group=2"]
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in groups)
    assert spark.read.parquet(str(tmp_path / "c")).select("id").distinct().count() == 103


def test_reshard_text(spark, tmp_path):
    spark.range(50).selectExpr("cast(id as string)").write.text(str(tmp_path / "a"))
    sinks.reshard_text(spark, str(tmp_path / "a"), str(tmp_path / "b"), files=3)
    assert len(list((tmp_path / "b").glob("part-*"))) == 3
    assert spark.read.text(str(tmp_path / "b")).distinct().count() == 50


def test_dealt_to_files(spark):
    """Every row once, in files of equal size, whether runs are of one batch or of all."""
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(0, 1000, 1, 3).selectExpr("id", "IF(id % 7 = 0, NULL, repeat('x\\ny', id % 5)) AS t", "array(id) AS a")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
        for held in (1, 1 << 26):
            dealt = sinks.dealt_to_files(rows, 7, held)
            assert sorted(dealt.collect()) == sorted(rows.collect()) and dealt.schema == rows.schema
            sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) == 7 and max(sizes) - min(sizes) <= 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert sinks.dealt_to_files(rows.limit(0), 7).count() == 0


def test_resharding_moves_compressed_runs(spark, tmp_path):
    spark.range(20_000).selectExpr("concat(md5(cast(id % 50 as string)), id) AS value").write.text(str(tmp_path / "a"))
    scanned = spark.read.text(str(tmp_path / "a"))
    text = sinks.dealt_to_files(scanned, 5)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "RoundRobin" not in text and text.count("MapInArrow") == 2
    sinks.reshard_text(spark, str(tmp_path / "a"), str(tmp_path / "b"), files=5)
    assert len(list((tmp_path / "b").glob("part-*"))) == 5
    assert sorted(spark.read.text(str(tmp_path / "b")).collect()) == sorted(scanned.collect())


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("é", encoding="utf-8")
    (tmp_path / "c.md").write_text("no", encoding="utf-8")
    (tmp_path / "x y" / "k=1").mkdir(parents=True)
    (tmp_path / "x y" / "k=1" / "a.txt").write_text("other", encoding="utf-8")
    found = {r["doc_id"]: r["text"] for r in text.read_documents(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": "line one\nline two\n", "b.txt": "é", "x y/k=1/a.txt": "other"}


@pytest.mark.parametrize("sparse", ["hex", "int64"])
def test_generated(spark, sparse):
    df = generate.generate_clicklog(spark.range(500), STANDARD, seed=1, sparse=sparse)
    rows = df.collect()
    assert df.columns == ["id", *STANDARD.columns]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, df.repartition(3).collect()))
    assert {r["col_0"] for r in rows} == {0, 1}
    assert all(-1000 <= r[c] < 1000 for r in rows for c in STANDARD.dense)
    assert len({r["col_20"] for r in rows}) == 500
    if sparse == "hex":
        assert all(len(r[c]) == 8 and r[c] == r[c].upper() and int(r[c], 16) >= 0 for r in rows for c in STANDARD.sparse)
    else:
        assert all(0 <= r[c] < 2**63 for r in rows for c in STANDARD.sparse)
    assert generate.estimated_bytes(STANDARD, 10) == 10 * (8 + 52 + 208)


def test_two_pass_job(spark, tmp_path):
    spec = FeatureSpec.from_counts(1, 1)
    (tmp_path / "in.tsv").write_text("1\t3\tff\n0\t-1\tff\n0\t\t0a\n")
    paths = [str(tmp_path / n) for n in ("in.tsv", "vocabulary", "out")]
    jobs.two_pass_vocabulary(spark, paths[0], paths[1], spec, 8192)
    jobs.two_pass_apply(spark, *paths, spec, 8192)
    lines = sorted(r[0] for r in spark.read.text(paths[2]).collect())
    assert [line.split("\t")[2] for line in lines] == ["0", "1", "0"]
    assert lines[0].split("\t")[1] == "0.0"
    rows = spark.read.csv(paths[0], sep="\t", schema="col_0 string, col_1 string, col_2 string")
    jobs.two_pass_vocabulary(spark, rows, paths[1] + "-2", spec, 8192)
    jobs.two_pass_apply(spark, rows, paths[1] + "-2", paths[2] + "-2", spec, 8192, kind="parquet", broadcast_rows=0)
    assert sorted(r["col_2"] for r in spark.read.parquet(paths[2] + "-2").collect()) == [0, 0, 1]


def test_small_ranges_share_tasks(spark, tmp_path):
    """A thousand ranges of a file are read by one task, in order and whole."""
    path = str(tmp_path / "records")
    records.write_records(spark.range(0, 1000, 1, 1).select("id", "id"), path)
    found = records.read_records(spark, path, fields=2, range_bytes=8)
    assert found.rdd.getNumPartitions() == 1
    assert [r["f_0"] for r in found.collect()] == list(range(1000))


def test_documents_are_written_whole(spark, tmp_path):
    """One file a row, also for empty texts and for rows that repeat a key or a whole document."""
    from clickloom.sources import text

    rows = [("a", "one\ntwo\n"), ("a", "other"), ("b", ""), ("b", None), ("c/d e", "é"), ("z", "same"), ("z", "same")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    path = str(tmp_path / "docs")
    text.write_documents(docs, path)
    found = [(r["doc_id"].split("/")[0], r["text"]) for r in text.read_documents(spark, path).collect()]
    names = {"c/d e": "c%2Fd e"}
    assert sorted(found) == sorted((f"doc_id={names.get(k, k)}", f"{t or ''}\n") for k, t in rows)


def test_records_of_worker_batches(spark, tmp_path):
    """Batches made by workers are written by them; a job that fails leaves no data, and jobs append."""
    def doubled(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"a": pc.multiply(b.column(0), 2), "b": b.column(0).cast(pa.float32())})

    def broken(batches):
        for b in batches:
            if 7 in b.column(0).to_pylist():
                raise ValueError("broken batch")
            yield b

    path = str(tmp_path / "records")
    df = spark.range(0, 20, 1, 3)
    records.write_records(map_batches(df, doubled, "a long, b float"), path)
    records.write_records(map_batches(df, doubled, "a long, b float"), path)
    with pytest.raises(Exception, match="broken batch"):
        records.write_records(map_batches(df, broken, "a long"), path)
    found = records.read_records(spark, path, fields=2, kinds=["uint32", "float32"]).collect()
    assert sorted(map(tuple, found)) == sorted((2 * i, float(i)) for i in range(20) for _ in range(2))


def test_documents_are_listed_by_tasks(spark, tmp_path):
    """What tasks list and read is what Spark's reader finds, and the driver holds no file's name."""
    files = {
        "a.txt": b"x\ny\n", "empty.txt": b"", "_hidden.txt": b"h", ".hidden.txt": b"h", "_k=1/a.txt": b"k", "_z/a.txt": b"z",
        ".q/a.txt": b"q", "x y/a+b%20c.txt": b"p", "x y/é {a},b.txt": b"\xff\xfe no text", "n/o/p/a.md": b"m", "n/o/p/b.txt._COPYING_": b"c",
        "n/b.txt": b"\xef\xbb\xbfmark", "n/c.txt.gz": gzip.compress(b"packed"), "n/[d].txt": b"d", "_metadata/a.txt": b"m", "n/_metadata.txt": b"m",
    }
    files |= {f"many/{i}/{i}.txt": f"{i}\n".encode() for i in range(100)}
    for name, content in files.items():
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_bytes(content)
    root = str(tmp_path / "docs")
    for pattern in ("*.txt", "*", "*.{md,txt}", "?.t[xy]t", "[^a]*.txt", "*.gz", r"\[d].txt", "none"):
        reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
        wanted = reader.text(root, wholetext=True).select(F.substring_index(path, f"{root}/", -1), F.hex("value"))
        found = text.read_documents(spark, root, pattern)
        assert found.columns == ["doc_id", "text"]
        assert sorted(map(tuple, found.select("doc_id", F.hex("text")).collect())) == sorted(map(tuple, wanted.collect()))
    found = text.read_documents(spark, root)
    assert not [f for f in found.inputFiles() if f.endswith(".txt")]
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    listed, many, size = text.list_documents(spark, root, "*.txt")
    assert many == listed.count() == text.read_documents(spark, root).count()
    assert size == listed.agg(F.sum("size")).first()[0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.read_documents(spark, str(tmp_path / "absent"))
