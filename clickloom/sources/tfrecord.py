"""TFRecord files as opaque records.

A record is its length (8 bytes), the length's checksum, the payload and the
payload's checksum. Both are verified on reading. The payload checksum travels
with the payload, so moved records need no new one.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from clickloom.operators.chains import reached
from clickloom.session import store
from clickloom.sources.files import TASK_BYTES, FileRange, JobParts, list_files, open_fs

# Fixed values of the file format: the reflected CRC-32C polynomial and the
# constant added to a rotated checksum.
_POLYNOMIAL = 0x82F63B78
_MASK_DELTA = 0xA282EAD8

_BATCH_BYTES = 8 * 1024 * 1024
_HEAD = 12
_MOST_TASKS = 20_000
_FEW_TASKS = 128  # up to so many, every range has its own task
RANGE_BYTES = 128 * 1024 * 1024


_ROW = 64  # bytes whose checksum one table lookup after another gives


def _crc_table() -> np.ndarray:
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (_POLYNOMIAL if byte & 1 else 0)
        table.append(byte)
    return np.array(table, np.uint32)


_TABLE = _crc_table()
# The same for two bytes at once.
_PAIRS = np.arange(1 << 16, dtype=np.uint32)
for _ in range(2):
    _PAIRS = _TABLE[_PAIRS & 0xFF] ^ (_PAIRS >> 8)


@functools.cache
def _shift(power: int) -> np.ndarray:
    """Four tables, one per byte of a checksum, for ``2**power`` zero bytes behind it."""
    start = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    if power == 0:
        return _TABLE[start & 0xFF] ^ (start >> 8)
    return _shifted(_shifted(start, power - 1), power - 1)


def _shifted(crc: np.ndarray, power: int) -> np.ndarray:
    t = _shift(power)
    return t[0][crc & 0xFF] ^ t[1][crc >> 8 & 0xFF] ^ t[2][crc >> 16 & 0xFF] ^ t[3][crc >> 24]


def masked_crcs(payloads: Sequence[bytes]) -> np.ndarray:
    """Masked checksums of all payloads at once.

    Payloads are cut into rows, zeros in front: those change no checksum that
    starts at zero. All rows advance byte by byte together, then neighbouring
    rows of a payload are joined until one is left.
    """
    sizes = np.array([len(p) for p in payloads], np.int64)
    out = np.zeros(len(payloads), np.uint32)
    rows = np.maximum(1, -(-sizes // _ROW))
    levels = np.ceil(np.log2(rows)).astype(np.int64)
    for level in np.unique(levels):
        own = np.flatnonzero(levels == level)
        width = _ROW << int(level)
        data = np.frombuffer(b"".join(payloads[i].rjust(width, b"\0") for i in own), "<u2")
        crc = np.zeros(2 * len(data) // _ROW, np.uint32)
        for column in data.reshape(-1, _ROW // 2).T.copy():
            crc = _PAIRS.take((crc ^ column) & 0xFFFF) ^ (crc >> 16)
        for step in range(int(level)):
            crc = _shifted(crc[::2], (_ROW.bit_length() - 1) + step) ^ crc[1::2]
        out[own] = crc
    start = np.full(len(payloads), 0xFFFFFFFF, np.uint32)
    for power in range(int(sizes.max(initial=0)).bit_length()):
        bit = (sizes >> power & 1).astype(bool)
        start[bit] = _shifted(start[bit], power)
    crc = (out ^ start ^ np.uint32(0xFFFFFFFF)).astype(np.uint64)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def masked_crc(data: bytes) -> int:
    return int(masked_crcs([data])[0])


class TfRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecords"

    def schema(self) -> str:
        return "payload BINARY, payload_crc BIGINT"

    def reader(self, schema) -> TfRecordReader:
        return TfRecordReader(self.options["path"], self.options.get("pattern", "*"))

    def writer(self, schema, overwrite: bool) -> TfRecordWriter:
        return TfRecordWriter(self.options["path"])


def read_batches(source: pa.NativeFile, path: str, start: int, stop: int, size: int) -> Iterator[pa.RecordBatch]:
    """The records that start at ``start`` and on, up to ``stop``, of a file of ``size`` bytes."""
    source.seek(start)
    stream = pa.BufferedInputStream(source, 1 << 20)
    payloads, crcs, heads, head_crcs, held, at = [], [], [], [], 0, start

    def batch() -> pa.RecordBatch:
        if (masked_crcs(heads) != np.array(head_crcs)).any():
            raise ValueError(f"{path}: broken record length")
        if (masked_crcs(payloads) != np.array(crcs)).any():
            raise ValueError(f"{path}: a payload does not have its checksum")
        columns = [pa.array(payloads, pa.binary()), pa.array(crcs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["payload", "payload_crc"])

    while at < stop and (head := stream.read(12)):
        if len(head) < 12:
            raise ValueError(f"{path}: the last record is cut off")
        length, length_crc = struct.unpack("<QI", head)
        # A damaged length would have the rest of the file read as one record.
        if length > size and masked_crc(head[:8]) != length_crc:
            raise ValueError(f"{path}: broken record length")
        heads.append(head[:8])
        head_crcs.append(length_crc)
        body = stream.read(length + 4)
        if len(body) != length + 4:
            if masked_crc(head[:8]) != length_crc:
                raise ValueError(f"{path}: broken record length")
            raise ValueError(f"{path}: the last record is cut off")
        payloads.append(body[:length])
        crcs.append(int.from_bytes(body[length:], "little"))
        held += length
        at += length + 16
        if held >= _BATCH_BYTES:
            yield batch()
            payloads, crcs, heads, head_crcs, held = [], [], [], [], 0
    if payloads:
        yield batch()


class TfRecordReader(DataSourceReader):
    """One partition per file; ``read_tfrecords`` cuts files that are large for that."""

    def __init__(self, path: str, pattern: str):
        self.path = path
        self.pattern = pattern

    def partitions(self) -> Sequence[FileRange]:
        return [FileRange(path, 0, size) for path, size in list_files(self.path, self.pattern)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        with fs.open_input_file(partition.path) as source:
            yield from read_batches(source, partition.path, 0, partition.stop, partition.stop)


class TfRecordWriter(DataSourceArrowWriter):
    """Keeps ``payload_crc`` where it is given and computes it where it is NULL."""

    def __init__(self, path: str):
        self.parts = JobParts(path, ".tfrecord")

    def write(self, iterator: Iterator[pa.RecordBatch]):
        def chunks() -> Iterator[bytes]:
            for batch in iterator:
                payloads = batch.column("payload").to_pylist()
                crcs = batch.column("payload_crc").to_pylist()
                missing = [i for i, c in enumerate(crcs) if c is None]
                for i, crc in zip(missing, masked_crcs([payloads[i] for i in missing])):
                    crcs[i] = int(crc)
                heads = [struct.pack("<Q", len(p)) for p in payloads]
                for head, check, data, crc in zip(heads, masked_crcs(heads), payloads, crcs):
                    yield b"".join([head, struct.pack("<I", int(check)), data, struct.pack("<I", crc)])

        return self.parts.write(chunks())

    def commit(self, messages) -> None:
        self.parts.commit(messages)

    def abort(self, messages) -> None:
        self.parts.abort()


def record_starts(data: bytes, offset: int, size: int) -> list[tuple[int, int]]:
    """Places in ``data`` that a record may start at, with the end that its length gives.

    A start has a length that the file has room for, and the length's checksum. ``data`` lies at
    ``offset`` of a file of ``size`` bytes and has ``_HEAD`` bytes more than are looked at.
    """
    b = np.frombuffer(data, np.uint8)
    n = max(0, len(b) - _HEAD + 1)
    high = (size.bit_length() + 7) // 8  # bytes of a length from this one on are zero
    free = np.ones(n, bool)
    for k in range(high, 8):
        free &= b[k : k + n] == 0
    at = np.flatnonzero(free)
    bytes_of = b[at[:, None] + np.arange(_HEAD)].astype(np.uint64)
    length = (bytes_of[:, :8] << np.arange(0, 64, 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    fits = length <= np.maximum(0, size - offset - at - 16).astype(np.uint64)
    fits &= at + offset + 16 <= size
    at, length, bytes_of = at[fits], length[fits].astype(np.int64), bytes_of[fits].astype(np.uint32)
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(0, 8, 2):
        crc = _PAIRS.take((crc ^ (bytes_of[:, k] | bytes_of[:, k + 1] << 8)) & 0xFFFF) ^ (crc >> 16)
    crc = (crc ^ np.uint32(0xFFFFFFFF)).astype(np.uint64)
    masked = (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF
    told = (bytes_of[:, 8:].astype(np.uint64) << np.arange(0, 32, 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    right = masked == told
    return list(zip((at[right] + offset).tolist(), (at[right] + offset + length[right] + 16).tolist()))


def _links(cut: DataFrame, uri: str) -> DataFrame:
    """Possible starts of each range, each with the first place of its chain outside the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path, size, start, stop = row["path"], row["size"], row["start"], row["stop"]
                found: list[tuple[int, int]] = []
                with open_fs(uri)[0].open_input_file(path) as source:
                    for at in range(start, stop, _BATCH_BYTES):
                        end = min(at + _BATCH_BYTES, stop)
                        found += record_starts(source.read_at(end - at + _HEAD - 1, at), at, size)
                ends: dict[int, int] = {}
                for offset, end in reversed(found):
                    ends[offset] = ends.get(end, end)
                columns = [pa.array([path] * len(ends), pa.string()), pa.array(list(ends), pa.int64())]
                columns.append(pa.array(list(ends.values()), pa.int64()))
                yield pa.record_batch(columns, ["path", "offset", "successor"])

    return cut.mapInArrow(run, "path string, offset long, successor long")


def _read_cut(
    spark: SparkSession, uri: str, files: Sequence[tuple[str, int]], range_bytes: int
) -> DataFrame:
    """Records of files that are read in byte ranges; small ranges share a task.

    A payload may hold records itself, so a length with a right checksum is only a possible start.
    Starts count if the chain of records from the file's beginning reaches them.
    """
    sized = spark.createDataFrame([(p, s) for p, s in files if s], "path string, size long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    cut = sized.select("path", "size", F.explode(starts).alias("start"))
    cut = cut.select("*", F.least(F.col("start") + range_bytes, "size").alias("stop"))
    # A number is given: rows are few bytes, and Spark would merge their partitions. Beyond
    # ``_FEW_TASKS``, small ranges share tasks of ``TASK_BYTES``.
    ranges = sum(-(-s // range_bytes) for _, s in files) or 1
    cores = spark.sparkContext.defaultParallelism
    tasks = min(ranges, max(_FEW_TASKS, 4 * cores, sum(s for _, s in files) // TASK_BYTES))
    cut = store(cut.repartition(min(tasks, _MOST_TASKS), "path", "start"), "byte-ranges")
    links = store(_links(cut.repartition(min(tasks, _MOST_TASKS), "path", "start"), uri), "record-starts")
    begin = sized.select("path", F.lit(0).cast("long").alias("offset"))
    entered = reached(links, begin).join(sized, "path").where("offset <> size")
    if broken := entered.join(links, ["path", "offset"], "left_anti").limit(1).collect():
        raise ValueError(f"{broken[0]['path']}: broken or cut off record at byte {broken[0]['offset']}")
    start = (F.floor(F.col("offset") / range_bytes) * range_bytes).cast("long")
    entries = entered.select("path", start.alias("start"), F.col("offset").alias("entry"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_fs(uri)[0].open_input_file(row["path"]) as source:
                    yield from read_batches(source, row["path"], row["entry"], row["stop"], row["size"])

    wanted = cut.join(entries, ["path", "start"]).repartition(min(tasks, _MOST_TASKS), "path", "start")
    return wanted.mapInArrow(run, "payload binary, payload_crc long")


def read_tfrecords(
    spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``(payload, payload_crc)`` of every record; files beyond ``range_bytes`` are read by many tasks."""
    files = list_files(path, pattern)
    if max(size for _, size in files) > range_bytes:
        return _read_cut(spark, path, files, range_bytes)
    spark.dataSource.register(TfRecords)
    return spark.read.format("tfrecords").option("pattern", pattern).load(path)


def write_tfrecords(df: DataFrame, path: str) -> None:
    """Write ``(payload, payload_crc)``, one file per partition."""
    df.sparkSession.dataSource.register(TfRecords)
    df.select("payload", "payload_crc").write.format("tfrecords").mode("append").save(path)
