"""Archives: what is written is read back, whatever payloads hold and however files are cut."""

import hashlib

import pytest

from clickloom.llm import warc
from clickloom.session import new_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"


def written(spark, rows, extra="", files=3):
    schema = f"page_id long, url string, html string{extra}"
    rows = [(*r, *[7] * extra.count(",")) for r in rows]
    path = new_path(spark, "warc")
    frame = spark.createDataFrame(rows, schema).repartition(files)
    warc.write(warc.with_revisits(frame), path)
    return path


def expected(rows):
    last = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 1000 and page_id is not None:
            last[html] = max(page_id, last.get(html, page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        target = last.get(html, page_id) if len(data) >= 1000 else page_id
        kind = "response" if target == page_id else "revisit"
        sha1 = hashlib.sha1(data).hexdigest()
        out.append((page_id, len(data), sha1, kind, target if kind == "revisit" else None))
    return sorted(out, key=repr)


def found(spark, path, range_bytes):
    rows = warc.pages(warc.records(spark, path, range_bytes, payloads=False)).collect()
    return sorted(map(tuple, rows), key=repr)


NESTED = "x\r\n\r\n" + "".join(FAKE.format(n, "y" * n) for n in (0, 5, 700)) + FAKE.format(10**9, "z") + "tail"
ROWS = [
    (1, "http://a/1", "small"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/\r\n\r\nWARC/1.1", "é" * 600),
    (5, "http://b", "é" * 600), (9, "http://c", "é" * 600), (None, "http://d", "é" * 600), (9, "http://c", "é" * 600),
    (6, "http://e", NESTED), (7, "http://e", NESTED), (8, "http://" + "u" * 9000, "\r\n\r\n"), (10, "", FAKE.format(3, "abc")),
    (11, "http://f", "long " * 300_000), (None, "http://g", "n" * 2000), (None, "http://g", "n" * 2000),
    (12, "http://h", "s" * 999), (13, "http://h", "s" * 999), (14, "http://h", "t" * 1000), (15, "http://h", "t" * 1000),
]


@pytest.mark.parametrize("range_bytes", [700, 4096, 1 << 20])
def test_round_trip(spark, range_bytes):
    """Ranges smaller than headers and payloads, odd rows, records inside payloads."""
    path = written(spark, ROWS)
    assert found(spark, path, range_bytes) == expected(ROWS)


def test_payloads_come_back(spark):
    path = written(spark, ROWS, extra=", offset long, payload long")
    rows = warc.records(spark, path, 2000).where("fields['warc-type'] = 'response'").collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted(
        (html or "").encode() for (_, _, html), e in zip(ROWS, map(lambda r: expected_kind(r), ROWS)) if e == "response"
    )
    assert {r.fields["content-type"] for r in rows} == {"text/html"}


def expected_kind(row):
    page_id, _, html = row
    same = [r[0] for r in ROWS if r[2] == html and r[0] is not None]
    return "response" if len((html or "").encode()) < 1000 or page_id == max(same, default=None) else "revisit"


def test_one_payload_holds_most_rows(spark):
    rows = [(i, "http://x", "p" * 1500 if i % 3 else f"{i} " * 800) for i in range(60)]
    assert found(spark, written(spark, rows), 5000) == expected(rows)


def test_crowded_payloads_match_others(spark, monkeypatch):
    """A bound of two crowded payloads sends the others through the join."""
    monkeypatch.setattr(warc, "HOT_PAYLOADS", 2)
    rows = [(i, None, f"{i % 7 % 5} " * 800) for i in range(70)]
    assert found(spark, written(spark, rows), 5000) == expected(rows)


def test_empty(spark):
    path = written(spark, [])
    assert found(spark, path, 5000) == []


def test_damage_is_an_error(spark, tmp_path):
    good = FAKE.format(4, "abcd")
    (tmp_path / "a.warc").write_bytes((good + "junk" + good).encode())
    with pytest.raises(ValueError, match="no record at byte"):
        warc.records(spark, str(tmp_path), 50)
    (tmp_path / "a.warc").write_bytes((good * 3)[:-6].encode())
    with pytest.raises(ValueError, match="no record at byte"):
        warc.records(spark, str(tmp_path), 50)


def test_only_reachable_candidates(spark, tmp_path):
    """A fake record that would run past the next true one is a candidate, and is left out."""
    inner = "a\r\n\r\nWARC/1.1\r\nContent-Length: 40\r\n\r\nb"
    data = FAKE.format(len(inner), inner) + FAKE.format(3, "abc")
    (tmp_path / "a.warc").write_bytes(data.encode())
    cut = warc.ranges(spark, str(tmp_path), 64)
    assert warc.links(cut).count() == 3
    assert [bytes(r.payload) for r in warc.records(spark, str(tmp_path), 64).orderBy("offset").collect()] == [
        inner.encode(), b"abc",
    ]
