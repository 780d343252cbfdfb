"""WARC archives: write records, revisits for repeated payloads, and read them back by byte range.

A payload may hold whole records of its own, so the magic words alone do not tell where a record
starts. Tasks emit each candidate of their byte range with the offset at which the record it would
be ends; pointer jumping from the start of the file finds which candidates the chain of records
reaches, and only those are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import keep
from clickloom.sources.files import open_fs

MIN_REVISIT_BYTES = 1000
HOT_PAYLOADS = 4096  # payloads that may each have this share of the repeated rows
RANGE_BYTES = 16 * 1024 * 1024
RANGES_PER_TASK = 8
BATCH_BYTES = 4 * 1024 * 1024

# Fixed values of the format.
MAGIC = b"WARC/1."
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", re.IGNORECASE)


# --- writing ---------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, smallest: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload``, its ``digest`` and ``n_bytes``, ``type`` and ``target``.

    Of equal payloads of at least ``smallest`` bytes, rows with the largest ``page_id`` are responses
    and the others revisits of it (``target``); null ids are below all others. Payloads are compared
    by SHA-256. Only digests are grouped; counts combine before the shuffle. Payloads that hold a
    ``HOT_PAYLOADS``-th of the repeated rows are at most that many and come from a broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select(
        "page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(payload.cast("binary"), 256)).alias("same"),
    )
    large = F.col("n_bytes") >= smallest
    groups = sized.where(large).groupBy("same").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = keep(groups.where("n > 1"), "repeated-payloads")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    crowded = F.col("n") * HOT_PAYLOADS >= total
    hot = groups.where(crowded).select("same", F.struct("last").alias("hot"))
    rest = groups.where(~crowded).select(F.col("same").alias("route"), F.struct("last").alias("found"))
    # 16 bytes never equal a digest of 32: rows that need no lookup are spread by their id.
    away = F.unhex(F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "digest")))
    routed = sized.join(F.broadcast(hot), "same", "left")
    routed = routed.withColumn("route", F.when(large & F.col("hot").isNull(), F.col("same")).otherwise(away))
    last = F.coalesce("hot", "found")
    again = last.isNotNull() & ~F.col("page_id").eqNullSafe(last["last"])
    return routed.join(rest, "route", "left").select(
        "page_id", "url", "payload", "digest", "n_bytes",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("type"),
        F.when(again, last["last"]).alias("target"),
    )


def record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def write(records: DataFrame, path: str) -> None:
    """One archive per task from the rows of ``with_revisits``, by Spark's own text writer.

    A record is its header, an empty line, its block and two line ends. A revisit has no block; its
    header names the payload's digest, length and response. Line ends inside a URL are escaped.
    """
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.col("type") == "revisit"

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    block = F.when(again, F.lit("")).otherwise(F.col("payload"))
    lines = [
        F.lit(f"{MAGIC.decode()}1"),
        field("WARC-Type", F.col("type")),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        field("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), field("WARC-Target-URI", url)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, field("WARC-Profile", F.lit(PROFILE))),
        F.when(again, field("WARC-Refers-To", record_id(F.col("target"), F.col("digest")))),
        F.when(again, field("Payload-Length", F.col("n_bytes").cast("string"))),
        field("Content-Type", F.lit("text/html")),
        field("Content-Length", F.octet_length(block).cast("string")),
    ]
    value = F.concat(*[F.coalesce(line, F.lit("")) for line in lines], F.lit(END.decode()), block)
    records.select(value.alias("value")).write.option("lineSep", END.decode()).text(path)


# --- reading ---------------------------------------------------------------------------------


class _Bytes:
    """Bytes of a file from ``start``, read on as far as they are asked for."""

    def __init__(self, source, size: int, start: int, stop: int):
        self.source, self.size, self.start = source, size, start
        self.data = source.read_at(max(0, min(stop, size) - start), start)

    def until(self, stop: int) -> bool:
        """Have the bytes up to ``stop``, or all there are; whether they reach it."""
        held = self.start + len(self.data)
        if stop > held and held < self.size:
            self.data += self.source.read_at(min(stop, self.size) - held, held)
        return self.start + len(self.data) >= stop

    def header(self, offset: int) -> tuple[bytes, int, int] | None:
        """Header of the record at ``offset``, where its block starts, and its length; if it is one."""
        at, reach = offset - self.start, 4096
        if not self.data.startswith(MAGIC, at) and not (
            self.until(offset + len(MAGIC)) and self.data.startswith(MAGIC, at)
        ):
            return None
        searched = at
        while (end := self.data.find(END, searched)) < 0:
            if self.start + len(self.data) >= self.size:
                return None
            searched = max(at, len(self.data) - len(END))
            self.until(self.start + len(self.data) + reach)
            reach *= 2
        head = self.data[at:end]
        length = _LENGTH.search(head)
        if length is None:
            return None
        return head, self.start + end + len(END), int(length[1])


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path``, ``size``, ``start`` and ``stop`` of all byte ranges of all files, spread over tasks."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    cut = files.select("path", F.col("length").alias("size"), starts.alias("start"))
    stop = F.least(F.col("start") + range_bytes, "size").alias("stop")
    return dealt(cut.select("*", stop))


def dealt(cut: DataFrame) -> DataFrame:
    """Ranges spread over tasks of up to ``RANGES_PER_TASK``, all cores at least.

    The number is given: the rows are few bytes, and without it they would be merged into one task.
    """
    cores, rows = cut.sparkSession.sparkContext.defaultParallelism, cut.count()
    tasks = max(1, min(rows, max(cores, -(-rows // RANGES_PER_TASK))))
    return cut.repartition(tasks, "path", "start")


def links(cut: DataFrame) -> DataFrame:
    """Candidates of every range: ``path``, ``offset``, and ``successor`` outside the range.

    A candidate stands at the start of a file or behind two line ends and has a header with a length.
    Chains inside a range are followed here, so each candidate comes with the first offset of its
    chain that lies beyond the range, or that is no candidate. Later steps need no other link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                before = max(0, row["start"] - len(END))
                with open_fs(row["path"])[0].open_input_file(open_fs(row["path"])[1]) as source:
                    held = _Bytes(source, row["size"], before, row["stop"])
                    offsets, at = ([0] if row["start"] == 0 else []), -1
                    held.until(row["stop"] + len(MAGIC))
                    while (at := held.data.find(END + MAGIC, at + 1)) >= 0:
                        offsets.append(before + at + len(END))
                    ends: dict[int, int] = {}
                    for offset in reversed([o for o in offsets if row["start"] <= o < row["stop"]]):
                        if found := held.header(offset):
                            end = found[1] + found[2] + len(END)
                            ends[offset] = ends.get(end, end)
                yield pa.record_batch(
                    [
                        pa.array([row["path"]] * len(ends), pa.string()),
                        pa.array(list(ends), pa.int64()),
                        pa.array(list(ends.values()), pa.int64()),
                    ],
                    ["path", "offset", "successor"],
                )

    return cut.mapInArrow(run, "path string, offset long, successor long")


def reached(found: DataFrame, cut: DataFrame) -> DataFrame:
    """Offsets that the chain from each file's start reaches: ``path``, ``offset``, one per range entered.

    Pointer jumping: each round doubles how far a link reaches, so a file of n ranges takes about
    log2(n) rounds. Only candidates that some link ends at are jumped from. A chain that does not end
    with its file fails.
    """
    begin = cut.where("start = 0").select("path", F.lit(0).cast("long").alias("offset"))
    ended = found.select("path", F.col("successor").alias("offset")).unionByName(begin).distinct()
    jumps = keep(found.join(ended, ["path", "offset"], "left_semi"), "warc-links")
    seen, known = keep(begin, "warc-reached"), 0
    while (now := seen.count()) > known:
        known = now
        step = seen.join(jumps, ["path", "offset"]).select("path", F.col("successor").alias("offset"))
        seen = keep(seen.unionByName(step).distinct(), "warc-reached")
        far = jumps.select("path", F.col("offset").alias("successor"), F.col("successor").alias("next"))
        jumps = keep(
            jumps.join(far, ["path", "successor"], "left").select(
                "path", "offset", F.coalesce("next", "successor").alias("successor")
            ),
            "warc-links",
        )
    sized = seen.join(cut.where("start = 0").select("path", "size"), "path").where("offset <> size")
    if broken := sized.join(found, ["path", "offset"], "left_anti").limit(1).collect():
        raise ValueError(f"{broken[0]['path']}: no record at byte {broken[0]['offset']}")
    return sized.select("path", "offset")


def records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``path``.

    ``path``, ``offset``, header ``fields`` by lower-case name, ``n_bytes`` and ``sha1`` of the block,
    and the block itself as ``payload`` unless ``payloads`` is false. Records are found by their chain
    from the start of each file, so records inside payloads are none. A damaged chain fails. Blocks of
    any length and headers of any length are read whole; empty files have no records.
    """
    cut = keep(ranges(spark, path, range_bytes), "warc-ranges")
    entered = reached(keep(links(cut), "warc-candidates"), cut)
    start = (F.floor(F.col("offset") / range_bytes) * range_bytes).cast("long").alias("start")
    entries = entered.select("path", F.col("offset").alias("entry"), start)
    wanted = dealt(cut.join(entries, ["path", "start"]))
    names = ["path", "offset", "fields", "n_bytes", "sha1", *["payload"][: int(payloads)]]
    kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]

    def fields(head: bytes) -> list[tuple[str, str]]:
        lines = [line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]]
        return list({name.strip().lower(): value.strip() for name, _, value in lines}.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for row in batch.to_pylist():
                rows, held_bytes = [], 0
                with open_fs(row["path"])[0].open_input_file(open_fs(row["path"])[1]) as source:
                    held, at = _Bytes(source, row["size"], row["entry"], row["stop"]), row["entry"]
                    while at < row["stop"]:
                        head, body, length = held.header(at) or (None, 0, 0)
                        if head is None or not held.until(body + length + len(END)):
                            raise ValueError(f"{row['path']}: broken record at byte {at}")
                        block = held.data[body - held.start : body - held.start + length]
                        sha1 = hashlib.sha1(block, usedforsecurity=False).hexdigest()
                        rows.append((row["path"], at, fields(head), length, sha1, block)[: len(names)])
                        held_bytes += length
                        at = body + length + len(END)
                        if held_bytes >= BATCH_BYTES:
                            yield made(rows)
                            rows, held_bytes = [], 0
                if rows:
                    yield made(rows)

    schema = "path string, offset long, fields map<string,string>, n_bytes long, sha1 string"
    return wanted.mapInArrow(run, schema + ", payload binary" * payloads)


def _page(identifier: Column) -> Column:
    return F.regexp_extract(identifier, "^<urn:page:(-?[0-9]*):", 1).try_cast("long")


def pages(found: DataFrame) -> DataFrame:
    """Per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A response whose block does not have the digest of its header fails, and so does a revisit without
    a response of the same id, digest and length. Revisits are made distinct before they are joined.
    """
    named = F.substring_index(F.col("fields")["warc-payload-digest"], ":", -1)
    again = F.col("fields")["warc-type"] == "revisit"
    wrong = F.raise_error(F.concat(F.col("path"), F.lit(": a payload does not have its digest")))
    digest = F.when(again | (named == F.col("sha1")), named).otherwise(wrong.cast("string"))
    length = F.when(again, F.col("fields")["payload-length"].cast("long")).otherwise(F.col("n_bytes"))
    listed = keep(
        found.select(
            _page(F.col("fields")["warc-record-id"]).alias("page_id"),
            length.alias("payload_bytes"),
            digest.alias("payload_digest"),
            F.col("fields")["warc-type"].alias("record_type"),
            _page(F.col("fields")["warc-refers-to"]).alias("refers_to"),
        ),
        "warc-records",
    )
    same = ["payload_digest", "payload_bytes"]
    asked = listed.where("record_type = 'revisit'").select("refers_to", *same).distinct()
    there = listed.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *same)
    if missing := asked.join(there, ["refers_to", *same], "left_anti").limit(1).collect():
        raise ValueError(f"no response for revisits of page {missing[0]['refers_to']}")
    return listed
