"""Exact removal of repeated 100-byte strings by prefix-free parsing.

*Triggers.* The trigger of a 100-byte string is the 32-byte window inside it whose rolling hash is
least (the leftmost of equals). Equal strings have their trigger at the same place.

*Phrases.* Neighbouring starts with the same trigger make one phrase: the text that all their
strings cover. Phrases overlap by 99 bytes, so every string lies in one phrase, and equal strings
lie in phrases of equal triggers. The parse of the corpus is the sequence of its phrases.

*Dictionary.* The distinct phrases, each with its first place in corpus order. A phrase that
occurred before repeats all its strings. A trigger with a single distinct phrase needs no more.

*Suffixes.* Where a trigger has several distinct phrases, only their first occurrences are
compared further: the suffixes of these dictionary phrases of 100 bytes or more are sorted by the
fingerprint of their first 100 bytes and then by corpus order. In each class the first stays; the
others are repeats. Only equality of 100 bytes is asked for, so the order of fingerprints serves as
well as the alphabetical one. The phrases of one trigger meet in one task, as text. A trigger with
very many of them deals its suffixes by class instead.

Sorts work in two steps: each task sorts what it has and sends on the first of each class; then
Spark deals these by class. So a class that holds a third of all rows sends one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import keep, mixed, texts_of
from clickloom.llm.pii import with_text

LENGTH = 100
TRIGGER = 32
SEGMENT = 1 << 19  # starts handled at once: bounds memory, whatever a text's length
BLOCK = 1 << 19  # phrases or suffixes that one task sorts at once

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that powers have inverses
_U = np.uint64
_CANDIDATE, _KNOWN, _REPEAT, _CONFLICT = range(4)


class Rolling:
    """Hashes of any window of a buffer, by prefix sums of bytes times powers modulo 2^64."""

    _powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, buffer: np.ndarray, base: int):
        size = SEGMENT + LENGTH
        if (base, size) not in self._powers:
            inverse = pow(base, -1, 1 << 64)
            one = np.ones(1, np.uint64)
            self._powers[base, size] = tuple(
                np.concatenate([one, np.cumprod(np.full(size, b, np.uint64))]) for b in (base, inverse)
            )
        up, self.down = self._powers[base, size]
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + _U(1)) * up[: len(buffer)], out=self.sums[1:])

    def windows(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return (self.sums[stops] - self.sums[starts]) * self.down[starts]

    def every(self, size: int) -> np.ndarray:
        count = len(self.sums) - size
        return (self.sums[size:] - self.sums[:count]) * self.down[:count]


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of whole texts, or of parts of one long text with all their strings.

    Gives (buffer, text number, place in the buffer, place in the text) per part.
    """
    parts: list[bytes] = []
    rows: list[int] = []
    at: list[int] = []
    offset: list[int] = []
    filled = 0

    def flush():
        return (
            np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(at), np.array(offset)
        )

    for row, text in enumerate(texts):
        for start in range(0, len(text) - LENGTH + 1, SEGMENT):
            part = text[start : start + SEGMENT + LENGTH - 1]
            if filled and filled + len(part) > SEGMENT + LENGTH - 1:
                yield flush()
                parts, rows, at, offset, filled = [], [], [], [], 0
            parts.append(part)
            rows.append(row)
            at.append(filled)
            offset.append(start)
            filled += len(part)
    if parts:
        yield flush()


def parse(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases as arrays: text number, first start, number of starts, trigger and phrase hash."""
    for buffer, rows, at, offset in segments(texts):
        short = Rolling(buffer, _BASES[0])
        grams = mixed(short.every(TRIGGER))
        value = (grams >> _U(32) << _U(32)) | np.arange(len(grams), dtype=np.uint64)
        width, size = LENGTH - TRIGGER + 1, 1
        while 2 * size <= width:
            value = np.minimum(value[:-size], value[size:])
            size *= 2
        if size < width:
            value = np.minimum(value[: len(value) - (width - size)], value[width - size :])
        trigger = (value & _U(0xFFFFFFFF)).astype(np.int64)

        stops = np.append(at[1:], len(buffer))
        inside = np.zeros(len(buffer) + 1, np.int32)
        np.add.at(inside, at, 1)
        np.add.at(inside, stops - LENGTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside[: len(trigger)]) > 0)
        chosen = trigger[starts]
        first = np.ones(len(starts), bool)
        first[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(first)
        # Texts that touch in the buffer can share neither starts nor strings.
        count = np.diff(np.append(begin, len(starts)))
        low, chosen = starts[begin], chosen[begin]
        part = np.searchsorted(at, low, "right") - 1
        whole = Rolling(buffer, _BASES[1]).windows(low, low + count - 1 + LENGTH)
        place = (count.astype(np.uint64) << _U(32)) | (chosen - low).astype(np.uint64)
        yield rows[part], low - at[part] + offset[part], count, grams[chosen], mixed(whole + mixed(place))


def _first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by ``keys``; which begin a class of the first two; which begin one of the first."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    outer = np.ones(len(order), bool)
    outer[1:] = a[1:] != a[:-1]
    inner = outer.copy()
    inner[1:] |= b[1:] != b[:-1]
    return order, inner, outer


def _batch(names, *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], list(names))


PHRASE = ("a", "b", "doc", "uid", "packed")
_PHRASE_DDL = ", ".join(f"{c} long" for c in PHRASE)


def _packed(low, count, kind) -> np.ndarray:
    return (low.astype(np.int64) << 9) | (np.asarray(kind, np.int64) << 7) | count


def _sorted_phrases(parts: list[tuple]) -> pa.RecordBatch:
    """What a task sends on for a block of phrases.

    Of equal phrases the first is sent; the others are repeats already. Of different phrases with
    one trigger the first stands for the trigger, the others are conflicts already. What is settled
    is dealt at random, and has its trigger in ``b``.
    """
    trigger, whole, doc, uid, low, count = (np.concatenate(p) for p in zip(*parts, strict=True))
    order, inner, outer = _first_of_each(trigger, whole, doc, uid, low)
    run = np.cumsum(outer) - 1
    several = np.bincount(run, inner)[run] > 1
    kind = np.where(inner, np.where(several, np.where(outer, _KNOWN, _CONFLICT), _CANDIDATE), _REPEAT)
    doc, uid, low, count = doc[order], uid[order], low[order], count[order]
    settled = kind >= _REPEAT
    trigger = trigger[order]
    a = np.where(settled, mixed(mixed(uid.view(np.uint64)) + low.astype(np.uint64)), trigger)
    b = np.where(settled, trigger, whole[order])
    return _batch(PHRASE, a.view(np.int64), b.view(np.int64), doc, uid, _packed(low, count, kind))


def phrases(stored: DataFrame) -> DataFrame:
    """The phrases of ``stored`` (``uid, doc, text``) that other tasks must see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch, texts in texts_of(batches):
            uid = batch.column(0).to_numpy()
            doc = batch.column(1).to_numpy()
            coded = [t.encode() if t else b"" for t in texts]
            for row, low, count, trigger, whole in parse(coded):
                parts.append((trigger, whole, doc[row], uid[row], low, count))
                held += len(low)
                if held >= BLOCK:
                    yield _sorted_phrases(parts)
                    parts, held = [], 0
        if parts:
            yield _sorted_phrases(parts)

    return stored.select("uid", "doc", "text").mapInArrow(run, _PHRASE_DDL)


MARK = ("uid", "low", "count", "conflict")
_MARK_DDL = "uid long, low long, count long, conflict long"


def _marked(uid, low, count, trigger, repeat) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(c)) for c in (uid, low, count)]
    return pa.record_batch([*columns, pa.array(trigger, mask=repeat)], list(MARK))


def marks(dealt: DataFrame) -> DataFrame:
    """Repeats and conflicts of the dictionary: runs of starts ``low`` to ``low + count - 1``.

    ``conflict`` is the trigger of a conflict and null in a repeat.

    Rows come in order of trigger, phrase and corpus; only the last row of a batch can wait for
    the next one, so memory does not depend on the size of a class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_a = last_b = None
        torn = False  # the trigger that the last batch ended in has a conflict
        waiting = None  # first phrase of that trigger, as long as there is none
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, doc, uid, packed = (c.to_numpy() for c in batch.columns)
            kind = (packed >> 7) & 3
            low, count = packed >> 9, packed & 127
            outer = np.ones(len(a), bool)
            outer[1:] = a[1:] != a[:-1]
            outer[0] = last_a is None or a[0] != last_a
            inner = outer.copy()
            inner[1:] |= b[1:] != b[:-1]
            inner[0] |= last_b is None or b[0] != last_b
            run = np.cumsum(outer) - (0 if not outer[0] else 1)  # 0: goes on from the last batch
            runs = int(run[-1]) + 1
            goes_on = not outer[0]
            distinct = np.bincount(run, inner, runs)
            known = np.bincount(run, kind == _KNOWN, runs) > 0
            conflict = known | (distinct > 1)
            if goes_on:
                conflict[0] |= torn or distinct[0] > 0
            settled = kind >= _REPEAT
            live = inner & conflict[run] & ~settled
            repeat = (~inner & ~settled) | (kind == _REPEAT)
            live |= kind == _CONFLICT
            take = live | repeat
            trigger = np.where(kind == _CONFLICT, b, a)
            yield _marked(uid[take], low[take], count[take], trigger[take], ~live[take])
            if waiting is not None:
                if goes_on and conflict[0]:
                    yield _marked(*waiting)
                    waiting = None
                elif not goes_on or runs > 1:
                    waiting = None
            final = runs - 1
            torn = bool(conflict[final])
            if not torn and (final > 0 or not goes_on):
                i = int(np.flatnonzero(run == final)[0])
                if not settled[i]:
                    here = slice(i, i + 1)
                    waiting = uid[here], low[here], count[here], a[here], np.zeros(1, bool)
            last_a, last_b = a[-1], b[-1]

    ordered = dealt.repartition("a").sortWithinPartitions(*PHRASE)
    return ordered.mapInArrow(run, _MARK_DDL)


SUFFIX = ("a", "b", "doc", "uid", "low")
_SUFFIX_DDL = ", ".join(f"{c} long" for c in SUFFIX) + ", phrase binary"
#: Conflicts of one trigger that one task compares; more are dealt suffix by suffix.
TOGETHER = 256
SALTS = 512  # parts in which the conflicts of one trigger are counted


def _sorted_suffixes(parts: list[tuple]) -> pa.RecordBatch:
    """A block of suffixes in order: the first of each class; repeats get ``low`` below zero."""
    a, b, doc, uid, low = (np.concatenate(p) for p in zip(*parts, strict=True))
    order, inner, _ = _first_of_each(a, b, doc, uid, low)
    doc, uid, low = doc[order], uid[order], low[order]
    spread = mixed(mixed(uid.view(np.uint64)) + low.astype(np.uint64))
    a = np.where(inner, a[order], spread)
    columns = (a.view(np.int64), b[order].view(np.int64), doc, uid, np.where(inner, low, ~low))
    columns = [pa.array(np.ascontiguousarray(c)) for c in columns]
    return pa.record_batch([*columns, pa.nulls(len(a), pa.binary())], [*SUFFIX, "phrase"])


def suffixes(texts: DataFrame) -> DataFrame:
    """Conflicts to compare, from ``uid, doc, text`` and lists ``lows, counts, triggers, many``.

    A conflict goes whole to where its trigger's others go. Of triggers with ``many`` conflicts,
    each suffix goes to where its equals go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch, found in texts_of(batches):
            uid = batch.column(0).to_numpy()
            doc = batch.column(1).to_numpy()
            whole: list[tuple] = []
            for i, text in enumerate(found):
                coded = text.encode()
                low, count, trigger, many = (
                    batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(3, 7)
                )
                for at, n, t in zip(low[~many].tolist(), count[~many].tolist(), trigger[~many].tolist(), strict=True):
                    whole.append((t, 0, int(doc[i]), int(uid[i]), at, coded[at : at + n - 1 + LENGTH]))
                low, count = low[many], count[many]
                if not len(low):
                    continue
                stop = np.cumsum(count)
                starts = np.repeat(low - np.append(0, stop[:-1]), count) + np.arange(stop[-1])
                starts.sort()
                for at in range(0, len(coded), SEGMENT):
                    own = starts[(starts >= at) & (starts < at + SEGMENT)] - at
                    if not len(own):
                        continue
                    buffer = np.frombuffer(coded[at : at + SEGMENT + LENGTH], np.uint8)
                    a, b = (mixed(Rolling(buffer, x).windows(own, own + LENGTH)) for x in _BASES)
                    parts.append((a, b, np.full(len(own), doc[i]), np.full(len(own), uid[i]), own + at))
                    held += len(own)
                if held >= BLOCK:
                    yield _sorted_suffixes(parts)
                    parts, held = [], 0
            if whole:
                columns = [pa.array(c, pa.int64()) for c in list(zip(*whole, strict=True))[:5]]
                phrase = pa.array([w[5] for w in whole], pa.binary())
                yield pa.record_batch([*columns, phrase], [*SUFFIX, "phrase"])
        if parts:
            yield _sorted_suffixes(parts)

    columns = ("uid", "doc", "text", "lows", "counts", "triggers", "many")
    return texts.select(*columns).mapInArrow(run, _SUFFIX_DDL)


def repeats_inside(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, start) of every 100-byte string that starts earlier in the list."""
    texts = [np.frombuffer(p, np.uint8) for p in phrases]
    row, start, one, two = [], [], [], []
    at = 0
    while at < len(texts):  # buffers of at most a segment
        stop, filled = at, 0
        while stop < len(texts) and (stop == at or filled + len(texts[stop]) <= SEGMENT):
            filled += len(texts[stop])
            stop += 1
        sizes = np.array([len(t) for t in texts[at:stop]])
        begin = np.cumsum(sizes) - sizes
        counts = sizes - LENGTH + 1
        own = np.repeat(np.arange(len(sizes)), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        buffer = np.concatenate(texts[at:stop])
        low = begin[own] + place
        row.append(own + at)
        start.append(place)
        one.append(Rolling(buffer, _BASES[0]).windows(low, low + LENGTH))
        two.append(Rolling(buffer, _BASES[1]).windows(low, low + LENGTH))
        at = stop
    row, start, one, two = (np.concatenate(c) for c in (row, start, one, two))
    order, inner, _ = _first_of_each(one, two, row, start)
    again = np.sort(order[~inner])
    return row[again], start[again]


def repeated_suffixes(dealt: DataFrame) -> DataFrame:
    """``uid, low, count``: the suffixes whose class has an earlier one.

    Rows come by trigger or class, then in corpus order. The phrases of the last trigger of a batch
    wait for the next batch: there are few of them, or they would have come suffix by suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        waiting: list[tuple] = []  # trigger, uid, low, phrase

        def compared(rows: list[tuple]) -> pa.RecordBatch:
            at, start = repeats_inside([r[3] for r in rows])
            uid = np.array([r[1] for r in rows], np.int64)[at]
            low = np.array([r[2] for r in rows], np.int64)[at] + start
            # Neighbouring starts become one run.
            first = np.ones(len(uid), bool)
            first[1:] = (uid[1:] != uid[:-1]) | (low[1:] != low[:-1] + 1)
            begin = np.flatnonzero(first)
            count = np.diff(np.append(begin, len(uid)))
            return _batch(("uid", "low", "count"), uid[begin], low[begin], count)

        for batch in batches:
            if not batch.num_rows:
                continue
            phrase = batch.column(5)
            whole = phrase.is_valid().to_numpy(zero_copy_only=False)
            a, b, _, uid, low = (c.to_numpy() for c in batch.columns[:5])
            if whole.any():
                rows = phrase.filter(pa.array(whole)).to_pylist()
                waiting += zip(a[whole].tolist(), uid[whole].tolist(), low[whole].tolist(), rows, strict=True)
                ready = len(waiting)
                while ready and waiting[ready - 1][0] == waiting[-1][0]:
                    ready -= 1
                if ready:
                    yield compared(waiting[:ready])
                    waiting = waiting[ready:]
            a, b, uid, low = (c[~whole] for c in (a, b, uid, low))
            if not len(a):
                continue
            again = np.zeros(len(a), bool)
            again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            again[0] = last == (a[0], b[0])
            again |= low < 0
            place = np.where(low < 0, ~low, low)
            yield _batch(("uid", "low", "count"), uid[again], place[again], np.ones(again.sum(), np.int64))
            last = (a[-1], b[-1])
        if waiting:
            yield compared(waiting)

    ordered = dealt.repartition("a", "b").sortWithinPartitions(*SUFFIX)
    return ordered.mapInArrow(run, "uid long, low long, count long")


def _torn(found: DataFrame) -> DataFrame:
    """The conflicts of each row as lists, with whether their trigger has many."""
    conflicts = found.where("conflict is not null").withColumn("salt", F.pmod(F.xxhash64("uid", "low"), F.lit(SALTS)))
    # Counted by part, so that a trigger with a third of all conflicts is no task's alone.
    parts = conflicts.groupBy("conflict", "salt").agg(F.count(F.lit(1)).alias("n"))
    often = parts.groupBy("conflict").agg(F.sum("n").alias("n")).where(F.col("n") > TOGETHER)
    crowded = parts.select("conflict", "salt").join(often, "conflict")
    marked = conflicts.join(crowded, ["conflict", "salt"], "left")
    item = F.struct("low", "count", F.col("conflict").alias("trigger"), F.col("n").isNotNull().alias("many"))
    lists = marked.groupBy("uid").agg(F.collect_list(item).alias("c"))
    return lists.select(
        "uid", F.col("c.low").alias("lows"), F.col("c.count").alias("counts"),
        F.col("c.trigger").alias("triggers"), F.col("c.many").alias("many"),
    )


def _gathered(runs: DataFrame) -> DataFrame:
    return runs.groupBy("uid").agg(
        F.collect_list(F.struct("low", "count")).alias("runs")
    ).select("uid", F.col("runs.low").alias("lows"), F.col("runs.count").alias("counts"))


def merged(lows: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal byte ranges that the strings of the runs cover."""
    order = np.argsort(lows)
    start, stop = lows[order], (lows + counts - 1 + LENGTH)[order]
    reach = np.maximum.accumulate(stop)
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > reach[:-1]
    last = np.append(first[1:], True)
    return list(zip(start[first].tolist(), reach[last].tolist(), strict=True))


def deduplicated(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """``docs`` as struct ``row``, with ``spans`` (byte ranges to remove) and the ``left`` bytes.

    Also ``n_bytes``, ``n_removed``. With ``as_text``, ``left`` is text: a character that a cut
    runs through goes too, and null stays null. Corpus order is by ``doc_id`` (null first), then by the order
    in which Spark reads the rows, so of repeated rows all but one are repeats. Null texts are
    empty. Texts of fewer than 100 bytes lose nothing. Texts meet their runs by a join on the row.
    """
    stored = keep(
        docs.select(F.struct("*").alias("row")).select(
            F.monotonically_increasing_id().alias("uid"),
            F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63))).alias("doc"),
            "row",
        ),
        "rows",
    )
    texts = stored.select("uid", "doc", F.col("row.text").alias("text"))
    found = keep(marks(phrases(texts)), "phrase-marks")
    suffixed = keep(repeated_suffixes(suffixes(texts.join(_torn(found), "uid"))), "suffix-marks")
    runs = found.where("conflict is null").select("uid", "low", "count").unionByName(suffixed)
    joined = stored.join(_gathered(runs), "uid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch, found in texts_of(batches):
            lows, counts = batch.column(2), batch.column(3)
            spans, left, size, gone = [], [], [], []
            for i, text in enumerate(found):
                coded = text.encode() if text else b""
                cut = []
                if lows[i].is_valid:
                    cut = merged(
                        lows[i].values.to_numpy(zero_copy_only=False),
                        counts[i].values.to_numpy(zero_copy_only=False),
                    )
                kept, at = [], 0
                for start, stop in cut:
                    kept.append(coded[at:start])
                    at = stop
                kept.append(coded[at:])
                rest = b"".join(kept)
                spans.append([{"start": s, "stop": e} for s, e in cut])
                size.append(len(coded))
                gone.append(len(coded) - len(rest))
                if as_text:
                    rest = None if text is None else rest.decode(errors="ignore")
                left.append(rest)
            columns = [
                batch.column(0), pa.array(spans, span), pa.array(left, pa.string() if as_text else pa.binary()),
                pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
            ]
            yield pa.record_batch(columns, ["row", "spans", "left", "n_bytes", "n_removed"])

    framed = joined.select("row", F.col("row.text").alias("text"), "lows", "counts")
    added = T.StructType.fromDDL(
        "spans array<struct<start:long,stop:long>>, "
        f"left {'string' if as_text else 'binary'}, n_bytes long, n_removed long"
    )
    return framed.mapInArrow(run, T.StructType([framed.schema["row"], *added.fields]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; ``n_chars`` is counted anew.

    A character that a cut runs through goes too. Null texts stay null.
    """
    done = deduplicated(docs, as_text=True).select("row", F.col("left").alias("text"))
    return with_text(done, docs)
