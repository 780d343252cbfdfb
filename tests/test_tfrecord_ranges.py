"""TFRecord files in byte ranges: the same records as from the start, whatever payloads hold."""

import struct

import numpy as np
import pytest

from clickloom.sources import tfrecord as R


def record(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", R.masked_crc(head)) + payload + struct.pack("<I", R.masked_crc(payload))


def payloads():
    rng = np.random.default_rng(5)
    plain = [rng.bytes(int(n)) for n in rng.integers(0, 300, 60)]
    inner = b"".join(map(record, plain[:12]))
    # Whole records inside a payload, a lone head that ends beyond it, zeros, and one long payload.
    head = struct.pack("<Q", 400)
    fake = head + struct.pack("<I", R.masked_crc(head))
    return [*plain[:20], inner, fake, b"x" + fake + inner, b"", bytes(500), record(record(b"deep")), *plain[20:],
            inner * 9, *plain[:5]]


@pytest.mark.parametrize("ranges", [1, 7, 100])
def test_ranges(spark, tmp_path, ranges):
    wanted = payloads()
    data = b"".join(map(record, wanted))
    (tmp_path / "a.tfrecord").write_bytes(data)
    (tmp_path / "b.tfrecord").write_bytes(b"")
    (tmp_path / "c.tfrecord").write_bytes(record(b"only one"))
    found = R.read_tfrecords(spark, str(tmp_path), range_bytes=-(-len(data) // ranges))
    assert sorted(bytes(r.payload) for r in found.collect()) == sorted([*wanted, b"only one"])
    if ranges > 1:
        assert found.rdd.getNumPartitions() >= ranges


def test_starts_against_plain_search():
    data = b"".join(map(record, payloads()))
    size = len(data)
    wanted = []
    for at in range(size - 11):
        length, crc = struct.unpack_from("<QI", data, at)
        if length <= size - at - 16 and R.masked_crc(data[at : at + 8]) == crc:
            wanted.append((at, at + 16 + length))
    assert R.record_starts(data, 0, size) == wanted
    parts = [s for at in range(0, size, 1000) for s in R.record_starts(data[at : at + 1000 + 11], at, size)]
    assert sorted(set(parts)) == wanted


@pytest.mark.parametrize("spoil", ["length", "payload", "end"])
def test_damage(spark, tmp_path, spoil):
    parts = [record(bytes([i]) * 50) for i in range(20)]
    if spoil == "length":
        parts[9] = bytes([parts[9][0] ^ 1]) + parts[9][1:]
    if spoil == "payload":
        parts[9] = parts[9][:20] + b"!" + parts[9][21:]
    data = b"".join(parts)
    (tmp_path / "a").write_bytes(data[:-3] if spoil == "end" else data)
    with pytest.raises(Exception, match="broken|checksum"):
        R.read_tfrecords(spark, str(tmp_path), range_bytes=200).collect()


def test_many_ranges_share_tasks(spark, tmp_path):
    wanted = payloads()
    (tmp_path / "a.tfrecord").write_bytes(b"".join(map(record, wanted)))
    found = R.read_tfrecords(spark, str(tmp_path), range_bytes=20)
    assert found.rdd.getNumPartitions() <= R._FEW_TASKS
    assert sorted(bytes(r.payload) for r in found.collect()) == sorted(wanted)
